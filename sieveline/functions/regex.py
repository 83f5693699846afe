"""From byte-regex patterns to Java patterns over a Latin-1 view (one character per byte).

Content is matched as bytes: word boundaries and classes are ASCII, only \\n ends a line. ``translate`` rewrites the parts of a pattern
whose meaning differs in Java; constructs that it cannot carry over raise ``Unsupported``.
"""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
_POSIX = {
    "alnum": "A-Za-z0-9", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
    "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "word": "A-Za-z0-9_", "punct": r"!-/:-@\[-`{-~",
}


class Unsupported(ValueError):
    """A pattern that needs something this translation does not carry over."""


def tokens(pattern: str):
    """The pattern cut into escapes, character classes, group openings, and single characters, with their places."""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            m = re.compile(r"\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|[pP]\{\w+\}|.)", re.S).match(pattern, i)
            if not m:
                raise Unsupported("a lone backslash ends the pattern")
            kind, text = "escape", m[0]
        elif c == "[":
            j = i + 1 + pattern.startswith("[^", i)
            j += pattern.startswith("]", j)
            while j < len(pattern) and pattern[j] != "]":
                if pattern.startswith("[:", j):
                    j = pattern.index(":]", j) + 2
                elif pattern[j] == "[":
                    raise Unsupported("a class inside a class")
                else:
                    j += 2 if pattern[j] == "\\" else 1
            if j >= len(pattern):
                raise Unsupported("a class that does not end")
            kind, text = "class", pattern[i : j + 1]
        elif c == "(":
            m = re.compile(r"\((?:\?(?:P?<\w+>|[A-Za-z-]*[:)]))?").match(pattern, i)
            kind, text = "open", m[0]
        else:
            kind, text = ("close", c) if c == ")" else ("char", c)
        yield kind, text, i
        i += len(text)


def _class(text: str) -> str:
    body = text[1:-1]
    if any(x in body for x in ("&&", "--", "~~")):
        raise Unsupported("set operations in a class")
    body = re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]] if m[1] in _POSIX else _reject(f"class {m[1]}"), body)
    body = body.replace("\\s", r"\t\n\x0B\f\r ")
    return "[" + _ascii(body) + "]"


def _reject(what: str):
    raise Unsupported(what)


def _ascii(text: str) -> str:
    if not text.isascii():
        raise Unsupported("characters beyond ASCII")
    return text


def translate(pattern: str) -> str:
    """The Java pattern with the same matches over the Latin-1 view."""
    out, multiline = [], False
    for kind, text, _ in tokens(pattern):
        if kind == "open" and text.startswith("(?"):
            flags = text[2:-1]
            if text[-1] in ":)" and flags:
                if set(flags) - set("imsx-"):
                    raise Unsupported(f"flags {flags}")
                multiline = multiline or "m" in flags.split("-")[0]
            text = text.replace("(?P<", "(?<").replace("_", "") if "<" in text else text
        elif kind == "class":
            text = _class(text)
        elif kind == "escape":
            if text in (r"\b", r"\B"):
                same = text == r"\B"
                a, b = f"(?<={_WORD})", f"(?={_WORD})"
                na, nb = a.replace("(?<=", "(?<!"), b.replace("(?=", "(?!")
                # What follows is asked for first: a look ahead costs less than one behind.
                text = f"(?:{b}{a}|{nb}{na})" if same else f"(?:{b}{na}|{nb}{a})"
            elif text == r"\z":
                pass
            elif text == r"\s":
                text = r"[\t\n\x0B\f\r ]"
            elif text == r"\S":
                text = r"[^\t\n\x0B\f\r ]"
            elif text[1] in "pPuUXGQEkZ" or text[1].isdigit():
                raise Unsupported(f"escape {text}")
        elif text == "$" and not multiline:
            text = r"\z"
        out.append(_ascii(text))
    return "(?d)" + "".join(out)


def to_python(pattern: str) -> bytes:
    """The pattern for Python's byte regular expressions, which has what Java's translation refuses."""
    out, multiline = [], False
    for kind, text, _ in tokens(pattern):
        if kind == "open" and text.startswith("(?") and text[-1] in ":)":
            multiline = multiline or "m" in text[2:-1].split("-")[0]
        elif kind == "class":
            text = re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]].replace(r"\x0B", r"\x0b") if m[1] in _POSIX else _reject(f"class {m[1]}"), text)
        elif text == r"\z" or (text == "$" and not multiline):
            text = r"\Z"
        elif kind == "escape" and text[1] in "pPuUXGQEkZ":
            raise Unsupported(f"escape {text}")
        out.append(text)
    return "".join(out).encode()


def groups(pattern: str) -> list[tuple[int, int, int]]:
    """Capture groups: (place of the opening, place after the closing, how many groups it is inside of)."""
    found, stack = [], []
    for kind, text, at in tokens(pattern):
        if kind == "open" and not re.fullmatch(r"\(\?[A-Za-z-]*\)", text):
            capture = text == "(" or "<" in text
            if capture:
                found.append([at, None, len(stack)])
            stack.append(len(found) - 1 if capture else None)
        elif kind == "close":
            if not stack:
                raise Unsupported("unbalanced groups")
            if (g := stack.pop()) is not None:
                found[g][1] = at + 1
    if stack:
        raise Unsupported("unbalanced groups")
    return [tuple(g) for g in found]


def with_lead(pattern: str, group: int) -> tuple[str, int]:
    """The pattern with all that stands before a top-level group captured as group 1, and the new number of the group.

    So the length of group 1 is where the secret starts in a match. A group inside another one, or one of several alternatives,
    has no fixed lead.
    """
    found = groups(pattern)
    open_, close, depth = found[group - 1]
    if depth or any(k == "char" and x == "|" for k, x, d in _at_depth(pattern) if d == 0):
        raise Unsupported("the secret's group is not part of the pattern's top level")
    if close < len(pattern) and pattern[close] in "?*+{":
        raise Unsupported("the secret's group is repeated or optional")
    flags = re.match(r"(?:\(\?[a-z-]+\))*", pattern)[0]
    inner = sum(1 for g in found if g[0] < open_)
    return f"{flags}({pattern[len(flags):open_]}){pattern[open_:]}", inner + 2


def _at_depth(pattern: str):
    depth = 0
    for kind, text, _ in tokens(pattern):
        if kind == "open" and not re.fullmatch(r"\(\?[A-Za-z-]*\)", text):
            depth += 1
        elif kind == "close":
            depth -= 1
        yield kind, text, depth
