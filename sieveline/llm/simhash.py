"""SimHash near-duplicates: fingerprints, and links within a Hamming distance found with vantage-point trees.

Two 64-bit fingerprints that differ in at most ``distance`` bits differ in at most distance // 3 bits on one of three
disjoint projections of the bits. For each projection a vantage-point tree parts the fingerprints by their distance from
a vantage point: a node's near side holds those within its bound, the far side the others. By the triangle inequality a
partner of a fingerprint on the far side can be on the near side only if the fingerprint lies within the radius of the
bound, so just those are sent to both sides, and every linked pair meets in at least one leaf. The upper levels of the trees
are fitted on a bounded sample and decide only how work is dealt out; leaves go on splitting where they are
searched, and every fingerprint takes part. In a leaf, pairs are compared on all 64 bits.

Equal fingerprints are one node of the graph. Only links that span a leaf's own components leave it, never its pairs; a leaf
with too many fingerprints for one task is searched as blocks against blocks.

A null text has no words: its fingerprint is zero, linked like any other. Rows with one doc_id are one
document with each row's own fingerprint; a null doc_id gets a null component and links nothing. ``keep`` takes every row as a document. Extra
columns are ignored, by ``keep`` kept. An empty table gives an empty one. A very long text is read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .components import components
from .store import Scratch, held

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Fingerprints that the upper levels are fitted on: a sixteenth of all, between these bounds; and the least number of them in a leaf.
TREE_SAMPLE, MOST_SAMPLE, TREE_LEAF = 32_768, 1 << 20, 24
#: Fingerprints of one leaf that one task splits further and searches; a set small enough to be compared pair by pair.
TASK_LEAF, SMALL = 400_000, 700
PROJECTIONS = (0x00000000001FFFFF, 0x000003FFFFE00000, 0xFFFFFC0000000000)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def shingles(text: bytes, width: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words of a UTF-8 text in their order; fewer words are one shingle, no words none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of the shingles of ``width`` words of a UTF-8 text, repeats included; fewer words are one shingle."""
    return majority(shingles(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; no hashes give zero."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    n, out = len(hashes), 0
    at = np.arange(0, n, 255)
    for bit in range(8):
        # eight bits at a time, one in each byte, added up in runs too short for a byte to overflow
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        ones = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(ones * 2 > n).tolist():
            out |= 1 << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint ``fp`` (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                fps = np.array([fingerprint(x or b"", width, seed) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _split(fps: np.ndarray, mask: np.uint64, radius: int):
    """A vantage point and bound for a set: (point, bound, distances), or None if no split makes both sides smaller."""
    best = None
    for point in fps[np.linspace(0, len(fps) - 1, 5).astype(int)]:
        d = np.bitwise_count((fps ^ point) & mask)
        counts = np.bincount(d, minlength=66).cumsum()
        for bound in range(65):
            near, far = int(counts[min(bound + radius, 65)]), len(fps) - int(counts[bound])
            if far and near < len(fps):
                cost = near * near + far * far
                if best is None or cost < best[0]:
                    best = (cost, point, bound, d)
    return best[1:] if best and best[0] < 0.9 * len(fps) ** 2 else None


def grow(fps: np.ndarray, mask: np.uint64, radius: int, leaf: int) -> np.ndarray:
    """A tree over a sample as an array of nodes: vantage point, bound, the places of its near and far side. A leaf has none, and its number as bound."""
    nodes, leaves = [], 0
    todo = [(fps, -1, "near")]
    while todo:
        own, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 if side == "near" else 3] = len(nodes)
        if len(own) <= leaf or (found := _split(own, mask, radius)) is None:
            nodes.append([0, leaves, -1, -1])
            leaves += 1
        else:
            point, bound, d = found
            todo += [(own[d <= bound + radius], len(nodes), "near"), (own[d > bound], len(nodes), "far")]
            nodes.append([int(point), bound, -1, -1])
    return np.array([tuple(n) for n in nodes], _NODE)


_NODE = np.dtype([("point", np.uint64), ("bound", np.int32), ("near", np.int32), ("far", np.int32)])


def route(fps: np.ndarray, tree: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and leaf numbers: a fingerprint near a bound on its far side is in leaves of both sides."""
    places, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(fps)))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        point, bound, near, far = tree[at]
        if near < 0:
            places.append(who)
            leaves.append(np.full(len(who), bound, np.int64))
        else:
            d = np.bitwise_count((fps[who] ^ point) & mask)
            todo += [(near, who[d <= bound + radius]), (far, who[d > bound])]
    return np.concatenate(places), np.concatenate(leaves)


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _compare(fps: np.ndarray, who: np.ndarray, distance: int, sets: _Sets) -> None:
    """Join all of ``who`` that are linked, on all bits. A flood: each one is compared with those not yet reached only."""
    rest = who
    while len(rest) > 1:
        if len(rest) <= SMALL:
            own = fps[rest]
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= distance, 1))
            if len(a) <= 4 * len(rest):
                for i, j in zip(rest[a].tolist(), rest[b].tolist(), strict=True):
                    sets.join(i, j)
                return
        front, rest = rest[:1], rest[1:]
        first = int(front[0])
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            step = max(1, 2_000_000 // len(rest))
            for i in range(0, len(front), step):
                left = np.flatnonzero(~reached)
                reached[left] = (np.bitwise_count(fps[front[i : i + step]][:, None] ^ fps[rest[left]][None, :]) <= distance).any(axis=0)
            front, rest = rest[reached], rest[~reached]
            for i in front.tolist():
                sets.join(first, i)


def search(fps: np.ndarray, mask: np.uint64, radius: int, distance: int, sets: _Sets) -> None:
    """Join the linked fingerprints of a leaf, splitting it by further vantage points while that helps."""
    todo = [np.arange(len(fps))]
    while todo:
        who = todo.pop()
        if len(who) <= SMALL or (found := _split(fps[who], mask, radius)) is None:
            _compare(fps, who, distance, sets)
        else:
            _, bound, d = found
            todo += [who[d <= bound + radius], who[d > bound]]


def links(nodes: DataFrame, scratch: Scratch, distance: int = DISTANCE, task_leaf: int = TASK_LEAF) -> DataFrame:
    """Rows (a, b) over nodes (fp, node), distinct in fp: links that span the same components as all pairs within ``distance``."""
    spark = nodes.sparkSession
    radius = distance // len(PROJECTIONS)
    size = min(MOST_SAMPLE, max(TREE_SAMPLE, nodes.count() // 16))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(size).toArrow().column(0).to_numpy().view(np.uint64)
    trees = [grow(sample, np.uint64(m), radius, TREE_LEAF) for m in PROJECTIONS]
    sent = spark.sparkContext.broadcast(trees)  # bounded by MOST_SAMPLE

    def deal(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for p, m in enumerate(PROJECTIONS):
                at, leaf = route(fps, sent.value[p], np.uint64(m), radius)
                yield pd.DataFrame({"fp": fps[at].view(np.int64), "node": pdf["node"].to_numpy()[at], "leaf": leaf * len(PROJECTIONS) + p})

    dealt = scratch.table(nodes.select("fp", "node").mapInPandas(deal, "fp long, node long, leaf long"), "leaves")
    # As many rows as there are leaves with too much in them, bounded like the trees.
    hot = dealt.groupBy("leaf").count().where(F.col("count") > task_leaf).collect()
    blocks = F.lit(1)
    if hot:
        small = spark.createDataFrame([(r["leaf"], -(-r["count"] // (task_leaf // 2))) for r in hot], "leaf long, blocks int")
        dealt = dealt.join(F.broadcast(small), "leaf", "left")
        blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")
    dealt = dealt.select("fp", "node", "leaf", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("fp", "node", "leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def leaf_links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp")
        mask = np.uint64(PROJECTIONS[int(pdf["leaf"].iloc[0]) % len(PROJECTIONS)])
        sets = _Sets(len(pdf))
        search(pdf["fp"].to_numpy(np.int64).view(np.uint64), mask, radius, distance, sets)
        node = pdf["node"].to_numpy()
        up = np.array([sets.root(i) for i in range(len(pdf))])
        joined = np.flatnonzero(up != np.arange(len(pdf)))
        return pd.DataFrame({"a": node[joined], "b": node[up[joined]]})

    return dealt.groupBy("leaf", "x", "y").applyInPandas(leaf_links, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable over links, for every row of docs."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprints(docs, width=width, seed=seed), "fingerprints")
    nodes = scratch.table(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # A doc_id with several rows can be the least one of several fingerprints: its rows are one document, hence linked.
    edges = links(nodes.dropDuplicates(["fp"]), scratch, distance).unionByName(
        prints.where("doc_id is not null").join(nodes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(_repeated(prints), F.col("a") == F.col("doc_id"), "left_semi")
    )
    found = components(edges, scratch)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _repeated(prints: DataFrame) -> DataFrame:
    return prints.groupBy("doc_id").agg(F.countDistinct("fp").alias("n")).where("n > 1").select("doc_id")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id."""
    found = near_duplicates(spark, docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least doc_id stays (null first; of equal ones that with the least text)."""
    plain, back = held(docs)
    rows = repeats.keyed(plain, Scratch(spark, "simhash-keep"))
    found = near_duplicates(spark, rows.select(F.col("row").alias("doc_id"), "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*back)
