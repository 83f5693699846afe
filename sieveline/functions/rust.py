"""Public fields in Rust sources: where a colon introduces a type and no value.

A source is cut into tokens once. A name is a public field if the tokens right before it are ``pub``, or ``pub`` and a valid restriction in
parentheses, and it stands in plain code: not in a comment or literal, and not in what a macro is given or made of. Where the nesting is
broken or deeper than DEPTH, nothing counts as plain code, so a doubtful place keeps its findings.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Open delimiters that are followed, and bytes from ``pub`` to the field's name, at most.
DEPTH, REACH = 8192, 4096
# Words that no name may be, in the language's first edition (later ones add more).
RESERVED = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while "
    "abstract become box do final macro override priv typeof unsized virtual yield".split()
)
#: Reserved words that may begin a path or, before an exclamation mark, name a macro.
ANCHORS = frozenset(("crate", "self", "super"))
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>[bc]?r(?P<hashes>\#*)")|(?P<text>[bc]?"(?:\\.|[^"\\])*(?:"|\Z))"""
    r"""|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])')|(?P<life>'\w+)|(?P<name>(?:r\#)?[^\W\d]\w*)|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<mark>.)""",
    re.DOTALL,
)
_EDGE = re.compile(r"/\*|\*/")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def tokens(source: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): name, mark, doc (a documentation comment), other. Blanks and plain comments are left out."""
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "line":
            text = m[0]
            kind = "doc" if text.startswith("//!") or (text.startswith("///") and not text.startswith("////")) else "space"
        elif kind == "block":
            depth = 1
            while depth:
                edge = _EDGE.search(source, end)
                if not edge:
                    end = len(source)
                    break
                depth, end = depth + (1 if edge[0] == "/*" else -1), edge.end()
            text = source[at : at + 4]
            kind = "doc" if text.startswith("/*!") or (text.startswith("/**") and text not in ("/***", "/**/")) else "space"
        elif m["raw"]:
            close = source.find('"' + m["hashes"], end)
            kind, end = "other", len(source) if close < 0 else close + 1 + len(m["hashes"])
        elif kind not in ("name", "mark", "space"):
            kind = "other"
        if kind != "space":
            yield kind, at, end
        at = end


def _restriction(words: list[tuple[str, int, int]], source: str) -> bool:
    """Whether the tokens between the parentheses behind ``pub`` are crate, self, super, or ``in`` and a path that may stand there."""
    text = [source[a:b] for _, a, b in words]
    if len(text) == 1:
        return text[0] in ANCHORS
    if not text or text[0] != "in":
        return False
    path, i, first, supers = [], 1, True, True
    rooted = text[1] == ":"
    while i < len(text):
        if not first or rooted:  # two colons side by side
            if text[i : i + 2] != [":", ":"] or words[i][2] != words[i + 1][1]:
                return False
            i += 2
        if i >= len(text) or words[i][0] != "name":
            return False
        path.append(text[i])
        i, first, rooted = i + 1, False, False
    rooted = text[1] == ":"
    for n, name in enumerate(path):
        bare = name.removeprefix("r#")
        if name == "super":
            fits = supers and not rooted
        elif name in ("crate", "self"):
            fits = n == 0 and not rooted
        elif bare != name:
            fits = bare not in ANCHORS and bare != "Self"
        else:
            fits = name not in RESERVED and name != "_"
        if not fits:
            return False
        supers = supers and (name == "super" or (n == 0 and name == "self"))
    return bool(path)


class _Nesting:
    """Which delimiters are open, and whether what stands inside of them is plain code."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []
        self.plain, self.lost, self.item = True, False, None

    def see(self, text: str, before: list[str]) -> None:
        """Take a token; before: the last three tokens in front of it."""
        if text in "([{":
            if len(self.open) == DEPTH:
                self.lost = True
                return
            given = self._given(before)
            defined = self.item == len(self.open)
            if defined and text == "{":
                self.item = None
            self.open.append((text, self.plain))
            self.plain = self.plain and not (given or defined)
        elif text in ")]}":
            if self.open and self.open[-1][0] == _PAIRS[text]:
                self.plain = self.open.pop()[1]
            else:
                self.plain = False
        elif text == ";" and self.item == len(self.open):
            self.item = None
        elif text == "macro" and self.plain:
            self.item = len(self.open)

    @staticmethod
    def _given(before: list[str]) -> bool:
        """Whether a delimiter behind these tokens opens an attribute, a macro's input, or the rules of one."""
        last = before[-1] if before else ""
        if last == "#" or before[-2:] == ["#", "!"]:
            return True
        if last == "!":
            name = before[-2] if len(before) > 1 else ""
            return name.removeprefix("r#").isidentifier() and (name not in RESERVED)
        return before[-3:-1] == ["macro_rules", "!"]


def public_fields(source: str, until: int | None = None) -> list[int]:
    """Where the names of public fields begin, in characters, up to a place; a raw name also where its bare form begins."""
    out, nest = [], _Nesting()
    seen: list[tuple[str, int, int]] = []  # tokens since the last that ends what may lead to a field
    before: list[str] = []
    for token in tokens(source):
        kind, start, end = token
        if until is not None and start > until:
            break
        text = source[start:end] if kind in ("name", "mark") else ""
        if kind == "mark" or text == "macro":
            nest.see(text, before)
        if nest.lost:
            break
        if kind == "name" and nest.plain:
            if text == "pub":
                seen = []
            elif seen and _leads(seen, source) and start - seen[0][1] <= REACH:
                out += [start, start + 2] if text.startswith("r#") else [start]
        if text == "pub" and nest.plain:
            seen = [token]
        elif seen:
            seen = [*seen, token] if len(seen) < 64 else []
        before = [*before[-2:], text]
    return out


def _leads(seen: list[tuple[str, int, int]], source: str) -> bool:
    """Whether tokens that begin with ``pub`` are a whole visibility."""
    if len(seen) == 1:
        return True
    first, last = (source[t[1] : t[2]] for t in (seen[1], seen[-1]))
    return first == "(" and last == ")" and _restriction(seen[2:-1], source)


def _in_bytes(source: str, places: list[int]) -> list[int]:
    if source.isascii():
        return places
    out, at, size = [], 0, 0
    for p in places:
        size += len(source[at:p].encode())
        out.append(size)
        at = p
    return out


def _fields(views: pa.Array, wanted: pa.Array) -> pa.Array:
    out = []
    for view, own in zip(views, wanted, strict=True):
        asked = [] if not own.is_valid else own.as_py()
        if not asked or not view.is_valid:
            out.append([])
            continue
        try:
            source = view.as_py().encode("latin-1").decode()
        except UnicodeDecodeError:
            out.append([])
            continue
        found = _in_bytes(source, public_fields(source, max(asked)))  # a place in bytes is none before that in characters
        out.append([x for x in asked if (i := bisect.bisect_left(found, x)) < len(found) and found[i] == x])
    return pa.array(out, pa.list_(pa.int64()))


def fields():
    """A function of (view, places): those places, in bytes, at which the name of a public field begins."""
    return F.arrow_udf(_fields, "array<bigint>")
