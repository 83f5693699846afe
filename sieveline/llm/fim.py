"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders and written in one of two orders.

Units are the matches of a regular expression, found by the tokenizers library's Split pre-tokenizer with every match isolated;
nothing is trained. The offsets it gives count code points. The length of the array of offsets is n, the number of units; two
borders ranked by size slice the text. All choices come from a hash of the seed and doc_id, so a row always gets the same
form. Restoring needs the output and its form only.

Null texts are empty and so plain; a null doc_id is hashed as no digits. Repeated rows are each written. A text with a sentinel
in it stays plain. A very long text goes through the library in pieces that end with a unit, so only its longest unit and its array of
offsets (8 bytes a unit) have to fit beside it. Extra columns are kept; a column that has the name of one to be added is
refused with ValueError. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import runs, texts_of
from .store import staying

#: Lines with their ends, the last one with or without.
LINES = r"[^\n]*\n|[^\n]+"
#: Code points that go through the library at a time, about.
PIECE = 1 << 18
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Units:
    """The ends of a text's units, in code points. ``end``: a string that always ends a unit, where long texts may be cut."""

    def __init__(self, pattern: str = LINES, end: str = "\n"):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.find = Split(Regex(pattern), "isolated").pre_tokenize_str
        self.end = end

    def _pieces(self, text: str) -> Iterator[tuple[int, str]]:
        at = 0
        while len(text) - at > PIECE:
            cut = text.find(self.end, at + PIECE)
            if cut < 0:
                break
            yield at, text[at : cut + len(self.end)]
            at = cut + len(self.end)
        yield at, text[at:]

    def ends(self, text: str) -> np.ndarray:
        return np.concatenate([np.array([b for _, (_, b) in self.find(part)], np.int64) + at for at, part in self._pieces(text)])


class Sentinels:
    """The strings that mark prefix, suffix and middle. The first character of each occurs nowhere else in them, so no text that
    lacks them can form one together with a neighbour."""

    def __init__(self, prefix: str = "<P>", suffix: str = "<S>", middle: str = "<M>"):
        self.prefix, self.suffix, self.middle = self.all = prefix, suffix, middle
        if len({*self.all}) < 3 or not all(self.all) or any(a[0] in b[1:] for a in self.all for b in self.all):
            raise ValueError("sentinels must differ, and their first characters may stand at their starts only")


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: Sentinels | None = None, pattern: str = LINES) -> DataFrame:
    """docs with ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` in place of ``text``.

    rate: the percentage of texts that are rearranged; spm: the percentage of those that begin with the suffix.
    """
    marks = sentinels or Sentinels()
    kept = staying(docs, ADDED, ("text",))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True)])
    width = len(kept)

    def one(units: Units, text: str, draw: str) -> tuple[int, str, int | None, int | None, str]:
        if not text:
            return 0, "plain", None, None, text
        ends = units.ends(text)
        n = len(ends)
        h = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
        if h[2] % 100 >= rate or any(s in text for s in marks.all):
            return n, "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(ends[i - 1]) if i else 0 for i in (low, high))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm:
            return n, "spm", a, b - a, "".join((marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle))
        return n, "psm", a, b - a, "".join((marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle))

    def run(batches):
        units = Units(pattern)
        for b in (part for whole in batches for part in runs(whole, width)):
            rows = [one(units, t, d) for t, d in zip(texts_of(b.column(width)), b.column(width + 1).to_pylist(), strict=True)]
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *added], names=[*kept, *ADDED])

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    named = (F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))
    return docs.select(*named, F.col("text").cast("string").alias("text"), draw.alias("draw")).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output was made from."""
    marks = sentinels or Sentinels()

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head, rest = F.substring_index(output, second, 1), F.substring_index(output, second, -1)
        return F.substring(head, len(first) + 1, F.length(head)), F.substring_index(rest, marks.middle, 1), F.substring_index(rest, marks.middle, -1)

    prefix, suffix, middle = between(marks.prefix, marks.suffix)
    spm_suffix, spm_prefix, spm_middle = between(marks.suffix, marks.prefix)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix))
        .otherwise(output)
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its units, form and lengths, and digests of the output and of the text restored from it."""
    done = transform(docs.select("doc_id", "text"))
    again = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, CASE WHEN a > 0 THEN array_to_string(u[1:a], '') ELSE '' END AS p,
         CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS m, CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
