"""Repeated windows of a sequence across documents: the search that both duplicate-text operators share.

A window of ``length`` elements (words or bytes) is represented by its minimizer, the ``anchor``: the run of ``k`` elements in it
with the least hash, the leftmost of equals. Equal windows have equal anchors at equal places, so windows can only be equal
within one anchor. Consecutive windows of a document with one anchor occurrence make up a *run*; there is about one run for
every (length - k) / 2 elements, and only runs travel. A run whose anchor occurs once anywhere holds no repeated window and is
dropped by the first shuffle; identical runs of one task travel as one row.

Of the runs that are left, identical ones need no further look at their text. Only an anchor with several different runs does
(copies that differ nearby, ends of shared passages): there one copy of each different run is read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seq import BASES, Prefix
from .store import Scratch

_INDEX_BITS = 24
#: Elements of one text handled at a time; longer ones are cut into overlapping pieces.
PIECE = 1 << 20
#: Characters of a text that ranges of rows are drawn by.
RANGE_CHARS = 256
#: Windows in a run, at most, as many as a mask has bits.
MOST_WINDOWS = 64


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a unique ``row`` that follows the order of doc_id.

    That is doc_id itself where it is unique and never null. Otherwise rows are ordered by doc_id (null first) and text, and
    written out with their place. Ranges are drawn by doc_id and the text's beginning (``RANGE_CHARS``), which agrees with that order and parts the
    rows of one doc_id, or of none, as well; what is sampled to draw them stays small.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    return scratch.table(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")


def minimizer_runs(codes: np.ndarray, ranges: np.ndarray, length: int, k: int):
    """Runs of windows by anchor: arrays (anchor hash, hash of the run's elements, text number, start in the text, windows).

    ranges: where each text's elements start in codes, and the end.
    """
    sizes = np.diff(ranges)
    if len(codes) > PIECE:  # one very long text: pieces that overlap by a window less one element
        out = []
        for d in np.flatnonzero(sizes >= length):
            for at in range(0, int(sizes[d]) - length + 1, PIECE):
                end = min(int(sizes[d]), at + PIECE + length - 1)
                part = codes[ranges[d] + at : ranges[d] + end]
                a, seg, _, s, n = _runs(part, np.array([0, len(part)]), length, k)
                out.append((a, seg, np.full(len(a), d), s + at, n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _runs(codes[:0], np.array([0, 0]), length, k)
    return _runs(codes, ranges, length, k)


def _runs(codes, ranges, length, k):
    count = len(codes) - length + 1
    if count <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    grams = Prefix(codes, BASES[1]).windows(k)
    low = np.uint64((1 << _INDEX_BITS) - 1)
    now = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - k + 1
    while width * 2 <= span:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    if width < span:
        now = np.minimum(now[:count], now[span - width : span - width + count])
    place = (now & low).astype(np.int64)
    edges = np.zeros(count + 1, np.int64)
    has = np.diff(ranges) >= length
    np.add.at(edges, ranges[:-1][has], 1)
    np.add.at(edges, ranges[1:][has] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    if not len(at):
        return _runs(codes[:0], ranges, length, k)
    p = place[at]
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(p) != 0))))
    n = np.diff(np.append(fresh, len(at)))
    if len(n) and int(n.max()) > MOST_WINDOWS:  # cut long runs
        parts = -(-n // MOST_WINDOWS)
        fresh = np.repeat(fresh, parts) + MOST_WINDOWS * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.diff(np.append(fresh, len(at)))
        n = np.minimum(n, MOST_WINDOWS)
    starts = at[fresh]
    doc = np.searchsorted(ranges, starts, "right") - 1
    whole = Prefix(codes, BASES[2]).spans(starts, starts + n + length - 1)
    return grams[p[fresh]], whole, doc, starts - ranges[doc], n


RUNS = "a long, seg long, n int, row long, s int, more array<struct<row: bigint, s: int>>"


def pack(runs: list[tuple], ) -> pa.RecordBatch:
    """Runs of one batch, (anchor, run hash, row, start, windows) each, as rows of RUNS; identical runs share a row."""
    a, seg, row, s, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((s, row, seg, a))
    a, seg, row, s, n = (x[order] for x in (a, seg, row, s, n))
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (seg[1:] != seg[:-1]))) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a)))
    rest = np.flatnonzero(~new)
    entry = pa.StructArray.from_arrays([pa.array(row[rest].astype(np.int64)), pa.array(s[rest].astype(np.int32))], ["row", "s"])
    ends = np.concatenate(([0], np.cumsum(size - 1))).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(size == 1, False)), entry)
    columns = [pa.array(a[first].view(np.int64)), pa.array(seg[first].view(np.int64)), pa.array(n[first].astype(np.int32)), pa.array(row[first].astype(np.int64)), pa.array(s[first].astype(np.int32)), more]
    return pa.RecordBatch.from_arrays(columns, names=["a", "seg", "n", "row", "s", "more"])


def repeated(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The runs whose anchor occurs more than once, still packed and written out, with

    ``first`` the earliest place of identical runs, ``copies`` their number, ``mixed`` whether the anchor has other runs too, and
    ``leader`` on one row of the identical ones. Counts combine before they are shuffled, and rows meet them in joins, which
    Spark can split where an anchor has very many.
    """
    size = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    anchors = runs.groupBy("a").agg(F.sum(size).alias("total"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("total > 1")
    several = scratch.table(runs.join(anchors.select("a", (F.col("low") != F.col("high")).alias("mixed")), "a"), "several")
    same = several.groupBy("a", "seg").agg(F.min(F.struct("row", "s")).alias("first"), F.sum(size).alias("copies"))
    out = several.join(same, ["a", "seg"]).withColumn("leader", F.struct("row", "s") == F.col("first"))
    out = scratch.table(out.select("a", "seg", "n", "row", "s", "more", "first", "copies", "mixed", "leader"), "runs")
    scratch.drop(several)
    return out


def places(packed: DataFrame) -> DataFrame:
    """Packed rows as one row per place: row and s as single values."""
    all_ = F.when(F.col("more").isNull(), F.array(F.struct("row", "s"))).otherwise(F.concat(F.array(F.struct("row", "s")), "more"))
    kept = [c for c in packed.columns if c not in ("row", "s", "more")]
    return packed.select(*kept, F.explode(all_).alias("at")).select(*kept, F.col("at.row").alias("row"), F.col("at.s").alias("s"))


def marks_by_row(marks: DataFrame) -> DataFrame:
    """(row, start, end, mask, ...) gathered per row as ``marks``; a document holds few more of them than it has runs."""
    return marks.groupBy("row").agg(F.collect_list(F.struct(*(c for c in marks.columns if c != "row"))).alias("marks"))


def covered(marks: pa.Array, sizes: np.ndarray, length: int) -> np.ndarray:
    """Flags over the elements of several texts (``sizes`` elements each, one behind the other) that marks cover.

    A mark without a mask covers start to end; one with a mask covers the windows that start at start + i for its bits i.
    """
    total = int(sizes.sum())
    steps = np.zeros(total + 1, np.int32)
    flat = marks.flatten()
    if len(flat):
        counts = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + base
        end = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + base
        mask, plain = flat.field(2).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(2).is_null().to_numpy(zero_copy_only=False)
        np.add.at(steps, start[plain], 1)
        np.add.at(steps, end[plain], -1)
        begin, bits = start[~plain], mask[~plain]
        for i in range(64):
            on = begin[(bits >> np.uint64(i)) & np.uint64(1) > 0] + i
            if len(on):
                np.add.at(steps, on, 1)
                np.add.at(steps, on + length, -1)
    return np.cumsum(steps[:-1]) > 0
