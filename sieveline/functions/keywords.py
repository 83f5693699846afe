"""Which keywords of many a view holds: one Aho-Corasick automaton for all of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Shorter keywords are looked for one by one: they occur so often that naming every place of them would cost more.
SHORT = 3


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]):
    """Maps each place of a word to the word's number; made once in each Python process."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def finder(keywords: list[tuple[str, ...]]):
    """A function of a column of arrays of views: for each view the numbers, in order, of the entries of ``keywords`` of which it holds a word.

    Views have one character for each byte, and words are compared as bytes, A-Z as a-z. An entry without words always counts.
    """
    owners: dict[str, list[int]] = {}
    for i, words in enumerate(keywords):
        for w in words:
            owners.setdefault(w.encode().lower().decode("latin-1"), []).append(i)
    always = frozenset(i for i, words in enumerate(keywords) if not words)
    short = [(w, frozenset(own)) for w, own in owners.items() if len(w) < SHORT]
    long = tuple(w for w in owners if len(w) >= SHORT)
    of = [frozenset(owners[w]) for w in long]

    def one(view: str | None) -> list[int]:
        if view is None:
            return []
        text = view.encode("latin-1").lower().decode("latin-1")
        seen, met = set(always), set()
        for w, own in short:
            if not own <= seen and w in text:
                seen |= own
        if long:
            for _, i in _automaton(long).iter(text):
                if i not in met:
                    met.add(i)
                    seen |= of[i]
        return sorted(seen)

    def run(views: pa.Array) -> pa.Array:
        found = [one(v) for v in views.flatten().to_pylist()]
        ends = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array([i for x in found for i in x], pa.int32()))
        counts = views.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), own)

    return F.arrow_udf(run, "array<array<int>>")
