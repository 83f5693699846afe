"""Near-duplicates by SimHash fingerprints in vantage-point trees, held against the exact Jaccard similarity of the sets of word shingles.

All pairs with a similarity of at least 4/5 are found. What the fingerprints leave is found by prefix filtering: in any one order of all shingles, the first
n - ceil(4n / 5) + 1 of two similar sets have a shingle in common. The order is by hash, but shingles that earlier looks at the prefixes
found often come last, rarer ones first, so that passages which several documents share are seldom in a prefix: as such shingles leave the
prefixes others move up, so the looks go on while each leaves far fewer pairs than the one before. Of two similar sets the first shingle
in common also leaves enough behind it in both; other meetings are not candidates. The order decides only how much work there is. Where
many sets meet in a shingle, the last step also bounds from below in how many shingles two differ, by the parities of their hashed buckets.

First come the pairs that vantage-point trees over SimHash fingerprints of the sets link (``simhash``), as far as they are similar: they join
large groups of near copies without all their pairs. No radius of fingerprints has every similar pair, so the prefixes find the others: the
least members of the components that meet in a shingle are compared with one of the least sets that have it, components that still meet
through their least members, and at last every pair that is still in different components. Candidates are compared on their whole texts: those to be compared with one document
are dealt to tasks behind it, in groups of bounded size, so that no set of shingles is ever stored.

Words are runs of characters other than space and \\t \\n \\v \\f \\r, A-Z as a-z. Shingles are compared by 64-bit hashes. A text with
fewer words than a shingle is one shingle, one without words (or null) the empty set, linked with other empty ones. Equal sets are one
node. Every row is a document, with a null or repeated doc_id too. An empty table stays empty. Extra columns are kept, whatever their
names. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, simhash
from .components import components
from .seq import BASES, LOWER, NOT_BLANK, Prefix, Tokens, mix, slices
from .store import Scratch, held

WIDTH = 5
#: A shingle in more prefixes than this comes last in the order, as far as the list goes, over this many looks; no bound changes what is found.
FREQUENT, LISTED, LOOKS = 4, 1_000_000, 5
#: Bytes of texts whose sets of shingles are made at a time; a longer text's is made alone.
SET_BYTES = 1 << 18
#: Documents that one group compares with one text, about.
GROUP = 500
#: Rows of a shingle from which on the sets that meet in it are told apart by their parities first, and the most 64-bit words of a set's parities.
CROWD, MOST_WORDS = 8, 64


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of rows of a text column with their sets of shingles: (first row, end row, sorted hashes of each)."""
    for first, end, data, offsets in slices(column, SET_BYTES):
        t = Tokens(LOWER[data], offsets, NOT_BLANK)
        hashed = Prefix(t.codes(), BASES[1])
        windows = hashed.windows(width)
        opens, closes = t.ranges[:-1], t.ranges[1:]
        short = hashed.spans(opens, closes)
        yield (
            first,
            end,
            [
                np.unique(windows[i : j - width + 1]) if j - i >= width else short[k : k + (j > i)]
                for k, (i, j) in enumerate(zip(opens.tolist(), closes.tolist(), strict=True))
            ],
        )


def parities(s: np.ndarray) -> np.ndarray:
    """Of a set's shingles dealt to buckets by hash, whether each bucket's number is odd, as bits of 64-bit words.

    Buckets that differ between two sets hold a shingle of only one of them each. There are as many words as the power of two from size / 32 on.
    """
    words = min(MOST_WORDS, 1 << max(0, -(-len(s) // 32) - 1).bit_length())
    buckets = (mix(s ^ np.uint64(BASES[0])) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(buckets, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view("<i8")


def signatures(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, and of its set of shingles the size, two sums of hashes (h, g), the SimHash ``fp`` and the parities ``odd``: equal sets agree on all of them."""

    def run(batches):
        for b in batches:
            for first, end, sets in _sets(b.column(1), width):
                sizes = np.array([len(s) for s in sets], np.int32)
                sums = [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for f in (mix, lambda s: mix(s ^ np.uint64(BASES[2])))]
                fps = np.array([simhash.majority(mix(s)) for s in sets], np.uint64).view(np.int64)
                odd = pa.array([parities(s) for s in sets], pa.list_(pa.int64()))
                columns = [b.column(0).slice(first, end - first), *map(pa.array, (sizes, *sums, fps)), odd]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "h", "g", "fp", "odd"])

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, size int, h long, g long, fp long, odd array<long>")


def prefixes(texts: DataFrame, width: int = WIDTH, last: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(token, node, size, place) for the shingles of the prefix of each text (node, text), place counted from 0 in the order.

    ``last`` holds shingles (sorted hashes) that are last in the order and their ranks there, from 1.
    """
    none = np.zeros(0, np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(last if last is not None else (none, np.zeros(0, np.int32)))  # bounded by LISTED

    def run(batches):
        late, ranks = sent.value
        for b in batches:
            for first, end, sets in _sets(b.column(1), width):
                sizes = np.array([len(s) for s in sets], np.int32)
                if len(late):
                    flat = np.concatenate([*sets, none])
                    at = np.searchsorted(late, flat)
                    at[at == len(late)] = 0
                    rank = np.where(late[at] == flat, ranks[at], 0)
                    parts = np.split(rank, np.cumsum(sizes)[:-1])
                    sets = [s[np.argsort(r, kind="stable")] if r.any() else s for s, r in zip(sets, parts, strict=True)]
                counts = np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)
                tokens = np.concatenate([*(s[:n] for s, n in zip(sets, counts.tolist(), strict=True)), none])
                places = np.concatenate([*(np.arange(n, dtype=np.int32) for n in counts.tolist()), np.zeros(0, np.int32)])
                nodes = b.column(0).slice(first, end - first).to_numpy()
                columns = (tokens.view(np.int64), np.repeat(nodes, counts), np.repeat(sizes, counts), places)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "size", "place"])

    return texts.select("node", "text").mapInArrow(run, "token long, node long, size int, place int")


def ordered(texts: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The prefixes in an order that has often met shingles last, and how often those in several of them are met (token, count), as tables."""
    hashes, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before = last = None
    for look in range(LOOKS):
        entries = scratch.table(prefixes(texts, width, last), "entries")
        counts = scratch.table(entries.groupBy("token").count().where("count > 1"), "counts")
        pairs = counts.agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
        if look == LOOKS - 1 or (before is not None and 4 * pairs > 3 * before):
            return entries, counts
        before = pairs
        often = counts.where(F.col("count") > FREQUENT).orderBy(F.desc("count"), "token").limit(LISTED).toArrow()
        if not len(often):
            return entries, counts
        scratch.drop(entries, counts)
        hashes = np.concatenate((hashes, often.column(0).to_numpy().view(np.uint64)))
        seen = np.concatenate((seen, often.column(1).to_numpy()))
        top = np.lexsort((hashes, -seen))
        hashes, once = np.unique(hashes[top], return_index=True)  # the first of equal ones has the most
        seen = seen[top][once]
        ranks = np.empty(len(hashes), np.int32)
        ranks[np.lexsort((hashes, seen))] = np.arange(1, len(hashes) + 1)
        if len(hashes) > LISTED:
            stay = ranks > len(hashes) - LISTED
            hashes, seen, ranks = hashes[stay], seen[stay], ranks[stay]
        last = hashes, ranks


def similar(pairs: DataFrame, texts: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have a similarity of 4/5 or more; a pair is compared once."""
    pairs = scratch.table(pairs, "pairs")
    per = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "groups")
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    leads = per.select(F.col("a").alias("node"), "a", every.alias("part"), F.lit(0).alias("side"))
    others = pairs.join(per, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("part"), F.lit(1).alias("side"))
    dealt = texts.join(leads.unionByName(others), "node").repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches):
        lead = np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for first, end, sets in _sets(b.column(3), width):
                a, side, node = (b.column(i).slice(first, end - first).to_pylist() for i in range(3))
                for hub, is_other, own, s in zip(a, side, node, sets, strict=True):
                    if not is_other:
                        lead = s
                    elif len(s) and len(lead):
                        at = np.searchsorted(lead, s)
                        at[at == len(lead)] = 0
                        if 9 * int((lead[at] == s).sum()) >= 4 * (len(lead) + len(s)):
                            found.append((hub, own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return scratch.table(dealt.select("a", "side", "node", "text").mapInArrow(run, "a long, b long"), "similar")


def _fits(a: str, b: str):
    """Whether two sets' sizes allow for a similarity of 4/5."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _leaves(a: str, at: str, b: str, bt: str):
    """Whether sets of sizes a and b whose first shingle in common has places at and bt may have a similarity of 4/5."""
    return 9 * F.least(F.col(a) - F.col(at), F.col(b) - F.col(bt)) >= 4 * (F.col(a) + F.col(b))


def _may_agree(p: str, m: str, q: str, n: str):
    """Whether sets of sizes m and n with parities p and q may have a similarity of 4/5: they differ in a shingle at least for each bucket that differs."""

    def differ(x, y):
        return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda v, w: v + w)

    def halved(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))

    # Sets that fit each other's size have as many words, or one twice as many.
    least = F.when(F.size(p) == F.size(q), differ(F.col(p), F.col(q))).when(F.size(p) == 2 * F.size(q), differ(halved(F.col(p)), F.col(q)))
    least = least.when(2 * F.size(p) == F.size(q), differ(F.col(p), halved(F.col(q))))
    return 9 * F.coalesce(least, F.lit(0)) <= F.col(m) + F.col(n)


def near_prints(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that the vantage-point trees link, or that have one fingerprint."""
    least = scratch.table(prints.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = prints.join(least.select("fp", F.col("node").alias("a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    linked = simhash.links(least, scratch).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(linked).distinct()


def links(texts: DataFrame, prints: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """Rows (a, b) over texts (node, text) and their prints (node, fp, odd), distinct in node: links that span the same components as all similar pairs."""
    first = scratch.table(near_prints(prints.select("node", "fp"), scratch), "near-prints")
    near_links = similar(first, texts, scratch, width)

    entries, shared = ordered(texts, scratch, width)
    met = scratch.table(entries.join(shared.select("token"), "token"), "met")
    scratch.drop(entries)

    # Of each component so far the least set stands for the others; it is compared with one of the least sets that it meets, that of most shingles in common.
    placed = _placed(met, near_links, scratch)
    own = placed.groupBy("token", "component").agg(F.min(F.struct("node", "size")).alias("own")).select("token", "own.*")
    hubs = own.groupBy("token").agg(F.min(F.struct("node", "size")).alias("hub"))
    near = own.join(hubs, "token").where(_fits("size", "hub.size")).groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).count().where("a <> b")
    best = near.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    best = scratch.table(best.join(first, ["a", "b"], "left_anti"), "best")
    found = near_links.unionByName(similar(best, texts, scratch, width))
    tested = first.unionByName(best)

    # Components that meet, through their least members.
    placed = _placed(met, found, scratch)
    least = placed.groupBy("token", "component").agg(F.min(F.struct("node", "size")).alias("own"))
    heads = least.groupBy("token").agg(F.min("own").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = least.join(heads, "token").where(_fits("own.size", "hub.size")).select(F.col("hub.node").alias("a"), F.col("own.node").alias("b")).where("a <> b").distinct()
    near = scratch.table(near.join(tested, ["a", "b"], "left_anti"), "near")
    found = found.unionByName(similar(near, texts, scratch, width))
    tested = tested.unionByName(near)

    # What is left: all pairs of different components. The largest component of a shingle is only compared with the others.
    placed = _placed(met, found, scratch)
    counts = placed.groupBy("token", "component").count().groupBy("token")
    counts = counts.agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("n"), F.sum("count").alias("rows"))
    counts = scratch.table(counts.where("n > 1").select("token", F.col("top.component").alias("top"), (F.col("rows") >= CROWD).alias("crowd")), "mixed")
    left = placed.join(counts, "token")
    # Where many meet, their parities tell apart inside the join what the places alone would let through: only a small part of it is similar.
    crowds = left.where("crowd").join(prints.select("node", "odd"), "node", "left").select(*left.columns, "odd")
    left = scratch.table(crowds.unionByName(left.where("not crowd").withColumn("odd", F.lit(None).cast("array<long>"))), "left")
    x = left.where("component <> top").select("token", *(F.col(c).alias(n) for c, n in (("node", "a"), ("size", "m"), ("place", "i"), ("component", "c"), ("odd", "p"))))
    y = left.select("token", *(F.col(c).alias(n) for c, n in (("node", "b"), ("size", "n"), ("place", "j"), ("component", "d"), ("odd", "q"))), "top")
    pairs = x.join(y, "token").where("c <> d").where((F.col("d") == F.col("top")) | (F.col("a") < F.col("b"))).where(_leaves("m", "i", "n", "j"))
    pairs = pairs.where(_may_agree("p", "m", "q", "n"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Written before tested ones go, so that these are looked up once for each pair, not for each shingle that it meets in.
    pairs = scratch.table(pairs, "met-pairs").join(tested, ["a", "b"], "left_anti")
    return found.unionByName(similar(pairs, texts, scratch, width))


def _placed(met: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """met with each node's component over the links found so far."""
    return met.join(components(found, scratch), "node", "left").select("token", "node", "size", "place", F.coalesce("component", "node").alias("component"))


def keep(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least doc_id stays (null first; of equal ones that with the least text)."""
    scratch = Scratch(spark, "jaccard")
    plain, back = held(docs)
    rows = repeats.keyed(plain, scratch)
    signed = scratch.table(signatures(rows, width), "signatures")
    nodes = signed.groupBy("size", "h", "g").agg(F.min("row").alias("node"))  # fp follows from the set
    ids = scratch.table(signed.join(nodes, ["size", "h", "g"]).select("row", "node"), "ids")
    copies = scratch.table(ids.where("row <> node").select(F.col("row").alias("node")), "copies")
    texts = rows.select(F.col("row").alias("node"), "text").join(copies, "node", "left_anti")
    prints = scratch.table(signed.where("size > 0").select(F.col("row").alias("node"), "fp", "odd").join(copies, "node", "left_anti"), "prints")
    found = components(links(texts, prints, scratch, width), scratch)
    # A node is the least row of its set, so a component's name is its least row.
    gone = ids.join(found, "node", "left").where(F.coalesce("component", "node") != F.col("row")).select("row")
    return rows.join(scratch.table(gone, "gone"), "row", "left_anti").select(*back)
