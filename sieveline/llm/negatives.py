"""Hard negatives by a two-dimensional block matrix multiplication.

Vectors become whole numbers and rows are sorted by label and cut into blocks, which are cut again into chunks of dimensions. A
product of an anchor block's chunk with a row block's is a tile of partial scores; a cell of the grid (anchor block, row
block, chunk) is one group of a cogroup, so every product has one owner and needs two small matrices. Tiles are 64-bit sums that are
shuffled by (anchor block, row block) and added up, and each sum is reduced to its best rows before anything else leaves the task.

Twice a part of the grid is worked on, together hardly more than once the whole: first the blocks that share labels, for the
positives; then all others, where each tile keeps the best rows of the window that every positive opens. No score
matrix is stored. A hot label has many blocks like any other run of rows, and a block never holds over ``ROWS`` rows.

Rows with a null label, a null vector or a null or non-finite component take no part. Every other row does, repeated ones and those
with a null vec_id too (which come last among equals and are never anchors); an anchor is not its own positive, its copies may be. Missing
components of shorter vectors count as zero. A score that could leave the range of a long is an error. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Rows and anchors in a block, at most, and dimensions in a chunk.
ROWS, ANCHORS, CHUNK = 8192, 64, 32
#: Numbers in a block, at most, unless it has one row.
CELLS = 1 << 23
_LAST = np.iinfo(np.int64).max
_BLOCK = "part int, i int, chunk int, n int, low long, high long, ids binary, labels binary, keys binary, matrix binary"
_KINDS = {"i2": np.int16, "i4": np.int32, "i8": np.int64}


def packed(values: np.ndarray) -> bytes:
    """Numbers in the narrowest of three widths that holds them all, behind its name."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    return kind.encode() + values.astype(_KINDS[kind]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _KINDS[bytes(data[:2]).decode()], offset=2).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly. Sums below 2^53 are exact in doubles too, which multiply faster."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def prepared(vectors: DataFrame, scale: int, relabel: int, labels: int) -> DataFrame:
    """vec_id, label, q (array<long>) of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x * scale)).alias("q"))


def blocks(rows: DataFrame, most: int, chunk: int) -> DataFrame:
    """Rows (key, vec_id, label, q), in the order they come in, as blocks: one row per block and chunk of dimensions.

    In a block rows are ordered by vec_id, nulls last. Every block has a chunk 0, be it without any dimension.
    """

    def cut(held: list[pa.RecordBatch], part: int, i: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids = table["vec_id"].fill_null(_LAST).to_numpy()
        key = table["key"].to_numpy()
        order = np.lexsort((key, table["vec_id"].is_null().to_numpy(), ids))
        label = table["label"].to_numpy()[order]
        q = table["q"].combine_chunks()
        sizes = q.value_lengths().to_numpy().astype(np.int64)
        wide = np.zeros((len(order), int(sizes.max(initial=0))), np.int64)
        wide[np.repeat(np.arange(len(order)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = q.flatten().to_numpy()
        if (peak := max(int(wide.max(initial=0)), -int(wide.min(initial=0)))) ** 2 * max(1, wide.shape[1]) >= 1 << 63:
            raise OverflowError(f"a component of {peak} may give scores that a long does not hold")
        wide, starts = wide[order], range(0, max(1, wide.shape[1]), chunk)
        null = table["vec_id"].is_null().to_numpy()[order]
        rest = [len(order), int(label.min()), int(label.max()), np.where(null, -1, ids[order]).tobytes() + null.tobytes(), label.tobytes(), key[order].tobytes()]
        rows = [[part, i, c, *rest, packed(wide[:, at : at + chunk])] for c, at in enumerate(starts)]
        yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in _BLOCK.split(", ")), r, strict=True)) for r in rows], schema=pa.schema(_ARROW))

    def run(batches):
        part, i, held, n, widest = TaskContext.get().partitionId(), 0, [], 0, 1
        for b in batches:
            while b.num_rows:
                take = b.slice(0, most - n)
                sizes = take.column(3).value_lengths().to_numpy()
                wide = np.maximum(np.maximum.accumulate(sizes), widest)  # with a wide row in it a block has room for fewer
                fits = int(np.searchsorted(wide * (n + 1 + np.arange(len(wide))), CELLS, "right"))
                if (take := take.slice(0, fits if held else max(1, fits))).num_rows:
                    held.append(take)
                    b, n, widest = b.slice(take.num_rows), n + take.num_rows, int(wide[take.num_rows - 1])
                if n == most or fits < len(sizes):
                    yield from cut(held, part, i)
                    i, held, n, widest = i + 1, [], 0, 1
        if n:
            yield from cut(held, part, i)

    return rows.select("key", "vec_id", "label", "q").mapInArrow(run, _BLOCK)


_ARROW = [
    ("part", pa.int32()), ("i", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
    ("ids", pa.binary()), ("labels", pa.binary()), ("keys", pa.binary()), ("matrix", pa.binary()),
]


def numbered(table: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks with a number of their own from 0 on, in order, in a column ``name``; and how many there are.

    What reaches the driver is one row per partition that wrote blocks.
    """
    counts = sorted((r["part"], r["n"]) for r in table.where("chunk = 0").groupBy("part").agg(F.count("*").alias("n")).collect())
    before, firsts = 0, []
    for part, n in counts:
        firsts.append((part, before))
        before += n
    first = table.sparkSession.createDataFrame(firsts, "part int, before long")
    return table.join(F.broadcast(first), "part").withColumn(name, F.col("before") + F.col("i")).drop("part", "i", "before"), before


def tiles(pairs: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial score tiles (a, r, chunk, tile) of pairs (a, r) of blocks: one product for each cell of the grid."""

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.table({"a": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "tile": pa.array([], pa.binary())})
        if left.num_rows and right.num_rows:
            m, n = left["n"][0].as_py(), right["n"][0].as_py()
            x, y = unpacked(left["matrix"][0].as_py()).reshape(m, -1), unpacked(right["matrix"][0].as_py()).reshape(n, -1)
            width = min(x.shape[1], y.shape[1])
            tile = packed(product(x[:, :width], y[:, :width]))
            out = pa.table({"a": [key[0].as_py()], "r": [key[1].as_py()], "tile": pa.array([tile], pa.binary())})
        return out

    def side(blocks: DataFrame, number: str, name: str) -> GroupedData:
        """Columns under names of their own: both sides come from the same pairs."""
        held = pairs.join(blocks.select(number, "chunk", "n", "matrix"), number).select("a", "r", "chunk", "n", "matrix")
        own = held.toDF(f"{name}_a", f"{name}_r", f"{name}_chunk", "n", "matrix")
        return own.groupBy(f"{name}_a", f"{name}_r", f"{name}_chunk")

    return side(anchors, "a", "left").cogroup(side(rows, "r", "right")).applyInArrow(cell, "a long, r long, tile binary")


def _side(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vec_ids, whether they are null, labels, keys of a block."""
    n = row[f"{name}_n"]
    ids = row[f"{name}_ids"]
    return np.frombuffer(ids, np.int64, n), np.frombuffer(ids, bool, n, 8 * n), np.frombuffer(row[f"{name}_labels"], np.int64), np.frombuffer(row[f"{name}_keys"], np.int64)


def reduced(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, best, schema: str, wanted: DataFrame | None = None) -> DataFrame:
    """Add up the tiles of each pair of blocks and reduce the sum: ``best(scores, anchors, rows, wanted)`` gives lists of values."""
    partial = tiles(pairs, anchors, rows)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    arrow = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = None, None
        for b in batches:
            for row in b.to_pylist():
                part = unpacked(row["tile"]) if row["tile"] is not None else None
                if row["a_n"] is not None:
                    other = row
                if part is not None:
                    total = part if total is None else total + part
        if total is None or other is None:
            return
        a, r = _side(other, "a"), _side(other, "r")
        found = best(total.reshape(len(a[0]), len(r[0])), a, r, other.get("wanted"))
        yield pa.RecordBatch.from_pydict(dict(zip(names, found, strict=True)), schema=pa.schema(arrow))

    # What a tile's rows are travels once for each pair, beside the tiles.
    def meta(table: DataFrame, side: str) -> DataFrame:
        return table.where("chunk = 0").select(side, *(F.col(c).alias(f"{side}_{c}") for c in ("n", "ids", "labels", "keys")))

    about = pairs.join(meta(anchors, "a"), "a").join(meta(rows, "r"), "r")
    if wanted is not None:
        about = about.join(wanted, "a", "left")
    return partial.unionByName(about, allowMissingColumns=True).groupBy("a", "r").applyInArrow(add, schema)


def mine(
    spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    scale: int = 256, relabel: int = 7, labels: int = 10, chunk: int = CHUNK, most_rows: int = ROWS, most_anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; negatives lie between ``window`` percent of the positive's score.
    """
    scratch = Scratch(spark, "negatives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prepared(vectors, scale, relabel, labels)
    few = lambda n, most: max(1, min(parts, -(-n // most)))
    total = vectors.count()
    by = ("label", F.xxhash64("vec_id", "q"))  # equal labels and equal ids spread over several partitions
    rows = rows.repartitionByRange(few(total, most_rows), *by).sortWithinPartitions("label")
    rows = scratch.table(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.repartitionByRange(few(asked.count(), most_anchors), "label", "key").sortWithinPartitions("label", "key")
    right, n_right = numbered(scratch.table(blocks(rows, most_rows, chunk), "row-blocks"), "r")
    left, n_left = numbered(scratch.table(blocks(asked, most_anchors, chunk), "anchor-blocks"), "a")
    if not n_left:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    # Pairs of blocks, by their labels' ranges alone: those that may share a label, and those that may differ in it.
    heads = right.where("chunk = 0").select("r", F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    firsts = left.where("chunk = 0").select("a", "low", "high")
    every_pair = firsts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("r")).join(heads, "r")
    near = every_pair.where("low <= r_high and r_low <= high").select("a", "r")
    far = every_pair.where("not (low = high and r_low = r_high and low = r_low)").select("a", "r")

    def same(scores, a, r, _):
        ids, null, label, key = a
        out = [[] for _ in range(6)]
        other_ids, other_null, other_label, other_key = r
        for i in range(len(ids)):
            at = np.flatnonzero((other_label == label[i]) & (other_key != key[i]))
            at = at[np.argsort(-scores[i, at], kind="stable")[:positives]]
            for j in at.tolist():
                for c, v in zip(out, (key[i], ids[i], None if other_null[j] else other_ids[j], other_key[j], scores[i, j], i), strict=True):
                    c.append(v if v is None else int(v))
        return out

    found = reduced(near, left, right, same, "key long, anchor_id long, positive_id long, positive_key long, positive_score long, i long")
    order = [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), F.col("positive_key")]
    ranked = found.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("p") <= positives)
    chosen = scratch.table(ranked.drop("positive_key", "i"), "positives")

    # Each anchor block carries its own anchors' positives.
    place = left.where("chunk = 0").select("a", F.col("keys"))
    holders = rows_of(place)
    wanted = chosen.join(holders, "key").groupBy("a").agg(F.collect_list(F.struct("key", "p", "positive_score")).alias("wanted"))
    low, high = window

    def different(scores, a, r, want):
        ids, _, label, key = a
        other_ids, other_null, other_label, _ = r
        out = [[] for _ in range(5)]
        where = {int(k): i for i, k in enumerate(key.tolist())}
        asked_of: dict[int, list] = {}
        for w in want or []:
            asked_of.setdefault(where[w["key"]], []).append((w["p"], w["positive_score"]))
        for i, pairs in asked_of.items():
            at = np.flatnonzero(other_label != label[i])
            at = at[np.argsort(-scores[i, at], kind="stable")]
            down = -scores[i, at]  # ascending
            for p, s in pairs:
                first = int(np.searchsorted(down, -(high * s // 100), "left"))
                last = int(np.searchsorted(down, -low * s // 100, "right"))
                for j in range(first, min(last, first + negatives)):
                    n = at[j]
                    for c, v in zip(out, (int(key[i]), p, None if other_null[n] else int(other_ids[n]), int(-down[j]), int(n)), strict=True):
                        c.append(v)
        return out

    hard = reduced(far, left, right, different, "key long, p int, negative_id long, negative_score long, at long", wanted)
    order = [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()]
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("key", "p").orderBy(*order))).where(F.col("rank") <= negatives)
    return chosen.join(hard, ["key", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def rows_of(place: DataFrame) -> DataFrame:
    """(a, key) of every anchor in its block."""

    def run(batches):
        for b in batches:
            for a, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), a)), pa.array(held)], names=["a", "key"])

    return place.mapInArrow(run, "a long, key long")


def report(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return mine(spark, vectors)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
