"""What every match of a pattern must hold: a cheaper pattern to ask for first, derived from the pattern's parse tree.

A contiguous part of a concatenation is in every match. Of the parts that stand for a few plain words the one with the longest
shortest word is taken, with the simple parts behind it, so that a key is asked for together with the sign that assigns to it. Where the
pattern itself begins with a word, its next word counts if it stands at a fixed distance; otherwise nothing is cheaper than the pattern.
"""

from __future__ import annotations

from functools import lru_cache
from re import _constants as C
from re import _parser

from . import regex

#: Words that one part may stand for, and characters of the shortest of them.
WORDS, SHORTEST = 64, 3
#: Simple parts that are taken behind the words.
BEHIND = 4
_ESCAPED = frozenset(rb"\.^$|?*+()[]{}-&~#/ ")
_CLASSES = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W"}


class Open(Exception):
    """A part that this derivation does not take in."""


def _char(code: int) -> str:
    return ("\\" if code in _ESCAPED else "") + chr(code) if 0x20 <= code < 0x7F else f"\\x{code:02X}"


def _flat(tree) -> list[tuple]:
    """The parts of a concatenation, with groups that always match taken apart and what has no width left out."""
    out = []
    for op, av in tree:
        if op is C.SUBPATTERN:
            if av[1] or av[2]:
                raise Open("flags of a group")
            out += _flat(av[3])
        elif op is not C.AT:
            out.append((op, av))
    return out


def _one_char(op, av) -> str:
    """A part that is one character, as a pattern."""
    if op is C.LITERAL:
        return _char(av)
    if op is C.NOT_LITERAL:
        return f"[^{_char(av)}]"
    if op is C.IN:
        out = ""
        for kind, x in av:
            if kind is C.NEGATE:
                out += "^"
            elif kind is C.LITERAL:
                out += _char(x)
            elif kind is C.RANGE:
                out += f"{_char(x[0])}-{_char(x[1])}"
            elif kind is C.CATEGORY and x in _CLASSES:
                out += _CLASSES[x]
            else:
                raise Open("a class")
        return f"[{out}]"
    raise Open("no single character")


def _words(parts: list[tuple]) -> list[str]:
    """All strings that parts stand for, if they are few; else Open."""
    out = [""]
    for op, av in parts:
        if op is C.LITERAL:
            own = [chr(av)]
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in av):
            own = [chr(x) for _, x in av]
        elif op is C.BRANCH:
            own = [w for branch in av[1] for w in _words(_flat(branch))]
        elif op is C.MAX_REPEAT and av[1] == 1:
            own = ["", *_words(_flat(av[2]))] if av[0] == 0 else _words(_flat(av[2]))
        else:
            raise Open("not a few words")
        out = [a + b for a in out for b in own]
        if len(out) > WORDS:
            raise Open("too many words")
    return out


def _width(op, av) -> int:
    """The width of a part that always has the same."""
    if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
        return 1
    if op is C.MAX_REPEAT and av[0] == av[1]:
        return av[0] * sum(_width(*p) for p in _flat(av[2]))
    if op is C.BRANCH:
        found = {sum(_width(*p) for p in _flat(b)) for b in av[1]}
        if len(found) == 1:
            return found.pop()
    raise Open("no fixed width")


def _alternatives(words: list[str]) -> str:
    return "(?:" + "|".join("".join(_char(ord(c)) for c in w) for w in dict.fromkeys(words)) + ")"


def _behind(parts: list[tuple]) -> str:
    """The simple parts that parts begin with, as a pattern; what is optional at its end is left out."""
    taken = []
    for op, av in parts[:BEHIND]:
        try:
            if op is C.MAX_REPEAT:
                (inner,) = _flat(av[2])
                most = "" if av[1] is C.MAXREPEAT else av[1]
                taken.append((f"{_one_char(*inner)}{{{av[0]},{most}}}", av[0] > 0))
            else:
                taken.append((_one_char(op, av), True))
        except (Open, ValueError):
            break
    while taken and not taken[-1][1]:
        taken.pop()
    return "".join(t for t, _ in taken)


def _runs(parts: list[tuple]) -> list[tuple[int, int, list[str]]]:
    """(first part, part behind, words) of the longest runs of parts that stand for a few words."""
    out, i = [], 0
    while i < len(parts):
        j, words = i, None
        while j < len(parts) and not (parts[j][0] is C.MAX_REPEAT and parts[j][1][0] == 0):  # what may be absent only makes more words
            try:
                words = _words(parts[i : j + 1])
            except Open:
                break
            j += 1
        if words is not None:
            out.append((i, j, words))
        i = max(j, i + 1)
    return out


def _ends(words: list[str]) -> list[str]:
    """Few ends of the words, as long as they are no more than the fewest."""
    lengths = range(SHORTEST, max(map(len, words)) + 1)
    best = min(lengths, key=lambda n: (len({w[-n:] for w in words}), -n))
    return list(dict.fromkeys(w[-best:] for w in words))


@lru_cache(maxsize=4096)
def required(pattern: str) -> str | None:
    """A pattern, in the same dialect, that is found wherever this one is; None if none is cheaper."""
    try:
        tree = _parser.parse(regex.to_python(pattern).decode("latin-1"))
        fold = "(?i)" if tree.state.flags & C.SRE_FLAG_IGNORECASE else ""
        parts = _flat(tree)
    except (Open, regex.Unsupported, Exception):  # whatever cannot be taken apart has no shortcut
        return None
    runs = [r for r in _runs(parts) if min(map(len, r[2])) >= SHORTEST]
    if not runs:
        return None
    first, end, words = runs[0]
    if first == 0:
        for low, high, more in _runs(parts)[1:]:
            if len(more) == 1 and more[0]:
                try:
                    gap = sum(_width(*p) for p in parts[end:low])
                except Open:
                    return None
                return f"{fold}{_alternatives(words)}[\\x00-\\xFF]{{{gap}}}{_alternatives(more)}"
        return None
    first, end, words = max(runs, key=lambda r: min(map(len, r[2])))
    return fold + _alternatives(_ends(words)) + _behind(parts[end:])
