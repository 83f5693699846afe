"""Suffix-array dedup: bytes that a long string which also starts earlier covers are removed.

Texts are UTF-8 bytes. A string of ``length`` bytes that also starts in a document of a smaller doc_id, or earlier in the same
one, is a later copy, and every byte that a later copy covers is removed; strings are judged on the input.

Strings with one anchor (see ``repeats``) form runs. Of identical runs all but the first are later copies as they stand. Where an
anchor has different runs, one text of each goes to the shard of its anchor. A shard sorts the suffixes of its texts and takes their
Burrows-Wheeler transform; breadth-first backward extension then finds where neighbours in the suffix array have a common
prefix of 0, 1, 2, ... bytes, by increasing value, and stops at ``length``: the places never reached lie between suffixes that
agree on ``length`` bytes or more. In each such interval the earliest source stays.

Null texts are empty. Each row of the input gives a row; rows that share a doc_id are separate documents, ordered by text.
Extra columns are ignored by ``report`` and kept by ``remove``; it refuses those with the names of its own results. An empty table
gives an empty one. A very long text is handled in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .seq import slices
from .store import Scratch, held, staying

LENGTH, ANCHOR = 100, 40
#: Bytes of runs in a shard, about, and the most that one anchor may bring into one.
SHARD, MOST = 1 << 20, 4 << 20


def byte_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of strings of bytes (see repeats.RUNS) of docs (row, text)."""

    def run(batches):
        for b in batches:
            rows, found = b.column(0).to_numpy(zero_copy_only=False), []
            for first, _, data, offsets in slices(b.column(1)):
                a, seg, doc, s, n = repeats.minimizer_runs(data, offsets, length, k)
                found.append((a, seg, rows[first + doc], s, n))
            if found:
                yield repeats.pack(found)

    return docs.select("row", F.col("text").cast("string")).mapInArrow(run, repeats.RUNS)


def run_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs, read from their first source: a, seg, row, s, n, bytes."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("a", "seg", "n", "s")).alias("asked"))
    pairs = docs.select("row", F.col("text").cast("string").alias("text")).join(asked, "row")

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                lists = b.column(2)
                flat, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                texts = b.column(1).cast(pa.large_binary()).to_pylist()
                owner = np.repeat(np.arange(b.num_rows), counts)
                n, s = (flat.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                parts = [texts[o][i : i + m + length - 1] for o, i, m in zip(owner.tolist(), s.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0), flat.field(1), b.column(0).take(pa.array(owner)), flat.field(3), flat.field(2), pa.array(parts, pa.binary())], names=["a", "seg", "row", "s", "n", "bytes"]
                )

    return pairs.select("row", "text", "asked").mapInArrow(run, "a long, seg long, row long, s int, n int, bytes binary")


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling. codes: numbers from 0 to 511; no string between two zeros is over ``longest``."""
    n = len(codes)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    width = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64)))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        if width > longest or int(fresh.sum()) == n - 1:
            return order
        ahead = np.zeros(n, np.uint64)
        ahead[: n - width] = rank[width:] + np.uint64(1)
        # behind a zero nothing is compared: suffixes that agree up to it stay in the order of their places
        key = (rank << np.uint64(32)) | ahead
        width *= 2


def common_prefix_edges(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Flags: the suffix at this place of the order and the one before it have a common prefix of fewer than ``length`` codes.

    Breadth-first backward extension on the Burrows-Wheeler transform. An interval of the suffix array holds the suffixes that start with
    some string w; the suffixes that start with cw are found through the rows of the transform that hold c. Where an interval of a string of d
    codes ends, and nothing shorter ended before, the common prefix is d - 1 codes. Intervals that end where one has ended already
    bring nothing new and are not extended.
    """
    n = len(order)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    before = codes[order - 1]  # the transform; the first suffix follows the last code, which is a zero
    turned = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[turned] = np.arange(n)  # the row of each suffix with the code before it put in front
    # strings of one code
    first = codes[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    edge[cuts] = True
    low, high = np.append(0, cuts), np.append(cuts, n)
    for _ in range(length - 1):
        size = high - low
        single = low[size == 1]
        single = single[before[single] != 0]
        a, b = step[single], step[single] + 1
        many = size > 1
        if many.any():
            count = size[many]
            which = np.repeat(np.arange(len(count)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[many], count)
            kept = before[rows] != 0
            which, rows = which[kept], rows[kept]
            if len(rows):
                key = which * 512 + before[rows]
                by = np.argsort(key, kind="stable")
                key, rows = key[by], rows[by]
                opens = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                a = np.concatenate((a, step[rows[opens]]))
                b = np.concatenate((b, step[rows[np.append(opens[1:], len(rows)) - 1]] + 1))
        new = ~edge[b] | ~edge[a]
        if not new.any():
            break
        low, high = a[new], b[new]
        edge[low] = edge[high] = True
    return edge[:n]


def later_copies(texts: list[bytes], row: np.ndarray, start: np.ndarray, length: int) -> list[int]:
    """For each text, taken from (row, start): bits of the offsets at which a string starts that another text has from an earlier source."""
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.zeros(int(ends[-1]), np.int64)
    filled = np.ones(len(codes), bool)
    filled[ends - 1] = False
    codes[filled] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    order = suffix_array(codes, int(sizes.max()) + 1)
    edge = common_prefix_edges(codes, order, length)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(codes)) - (ends - sizes - 1)[owner]
    whole = (sizes[owner] - offset >= length)[order]
    group = np.cumsum(edge)[whole]
    own, off = owner[order][whole], offset[order][whole]
    source = np.lexsort((start[own] + off, row[own], group))
    group, own, off = group[source], own[source], off[source]
    later = np.concatenate(([False], group[1:] == group[:-1]))
    bits = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(bits, own[later], np.uint64(1) << off[later].astype(np.uint64))
    return bits.view(np.int64)


def mixed_runs(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """(row, start, end, mask): the later copies in one text of each different run (a, seg, row, s, n, bytes)."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        row, s = pdf["row"].to_numpy(np.int64), pdf["s"].to_numpy(np.int64)
        bits = later_copies(pdf["bytes"].tolist(), row, s, length)
        hit = bits != 0
        return pd.DataFrame({"row": row[hit], "start": s[hit], "end": s[hit], "mask": bits[hit]})

    sharded = texts.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(search, "row long, start int, end int, mask long")


def hot_runs(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors whose runs are too many for one task: every string is looked up by two hashes, and earliest sources combine before they travel."""
    at = texts.select("a", "seg", "row", "s", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    string = F.substring(F.col("bytes"), F.col("o") + 1, F.lit(length))
    at = at.select("a", "seg", "row", "s", "o", F.struct("row", (F.col("s") + F.col("o")).alias("pos")).alias("source"), F.xxhash64(string).alias("h"), F.xxhash64(F.reverse(F.hex(string)), F.lit(1)).alias("g"))
    first = at.groupBy("a", "h", "g").agg(F.min("source").alias("first"))
    later = at.join(first, ["a", "h", "g"]).where("source <> first")
    masks = later.groupBy("a", "seg", "row", "s").agg(F.expr("bit_or(shiftleft(1L, o))").alias("mask"))
    return masks.select("row", F.col("s").alias("start"), F.col("s").alias("end"), "mask")


def marks(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """What later copies cover in docs (row, text): marks (row, start, end, mask; see repeats.covered)."""
    packed = repeats.repeated(byte_runs(docs, length, k), scratch)
    leaders = packed.where("leader and mixed").select("a", "seg", "n", "row", "s").dropDuplicates(["a", "seg"])
    texts = scratch.table(run_texts(docs, leaders, length), "texts")
    total = texts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    hot = texts.groupBy("a").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > MOST).select("a")
    if hot.limit(1).count():
        mixed = mixed_runs(texts.join(hot, "a", "left_anti"), length, shards).unionByName(hot_runs(texts.join(hot, "a", "left_semi"), length))
    else:
        mixed = mixed_runs(texts, length, shards)
    at = repeats.places(packed.select("n", "row", "s", "more", "first")).where("not (row = first.row and s = first.s)")
    copies = at.select("row", F.col("s").alias("start"), F.expr(f"s + n - 1 + {length}").cast("int").alias("end"), F.lit(None).cast("long").alias("mask"))
    return mixed.unionByName(copies)


def remove(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, keep_text: bool = True) -> DataFrame:
    """docs with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``; all other columns stay, the text if asked for."""
    scratch = Scratch(spark, "suffixes")
    added = ["kept", "n_bytes", "n_removed", "n_spans"]
    own = staying(docs, tuple(added), () if keep_text else ("text",))
    plain, back = held(docs)
    rows = repeats.keyed(plain, scratch)
    per_row = scratch.table(repeats.marks_by_row(marks(rows.select("row", "text"), scratch, length, k)), "marks")
    joined = rows.select("row", "held", "text").join(per_row, "row", "left").select("held", "text", "marks")

    def run(batches):
        for whole in batches:
            for first, end, data, offsets in slices(whole.column(1)):
                b = whole.slice(first, end - first)
                gone = repeats.covered(b.column(2), np.diff(offsets), length)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                opens[edges] = gone[edges]
                ends = offsets[1:] - np.append(0, np.cumsum(gone))[offsets[1:]]
                removed = np.diff(np.append(0, np.cumsum(gone))[offsets])
                spans = np.diff(np.append(0, np.cumsum(opens))[offsets])
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[~gone].tobytes())])
                before = [b.column(1)] if keep_text else []
                yield pa.RecordBatch.from_arrays([b.column(0), *before, kept.cast(pa.binary()), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64))], names=schema.names)

    schema = T.StructType([joined.schema["held"], *([T.StructField("text", T.StringType())] if keep_text else []), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in added[1:])])
    out = joined.mapInArrow(run, schema)
    return out.select(*(b for b, c in zip(back, docs.columns, strict=True) if c in own), *added)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove(spark, docs.select("doc_id", "text"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT r, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100),
strings AS (SELECT r, i, md5(array_slice(b, i, i + 99)) AS s FROM places),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS n FROM strings) WHERE n > 1),
steps AS (SELECT r, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM later WINDOW w AS (PARTITION BY r ORDER BY i)),
sums AS (SELECT r, sum(least(100, coalesce(after - i, 100))) AS n_removed, count(*) FILTER (WHERE after IS NULL OR after > i + 100) AS n_spans FROM steps GROUP BY r),
gaps AS (
  SELECT r, coalesce(before + 100, 1) AS a, i - 1 AS z FROM steps WHERE before IS NULL OR before + 100 < i
  UNION ALL SELECT r, i + 100, NULL FROM steps WHERE after IS NULL),
parts AS (SELECT r, string_agg(hex(array_slice(b, a, coalesce(z, octet_length(b)))), '' ORDER BY a) AS kept FROM gaps JOIN d USING (r) WHERE a <= coalesce(z, octet_length(b)) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN parts USING (r)
"""
