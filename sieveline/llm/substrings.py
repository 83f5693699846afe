"""Substring dedup on a de Bruijn graph of words.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. An edge of the graph is a window of ``length``
consecutive words of one document, from the node of its first to the node of its last ``length`` - 1 words. Edges that start in two places
or more are repeated, and every word that a repeated edge covers is removed, in all its copies; windows are judged on the
input.

Windows with one anchor (see ``repeats``) that follow each other are one compact edge from the start. Anchors where copies differ are
opened up into single edges. Repeated edges are then compacted into nonbranching paths: a node with one edge in and
one out disappears by joining its edges. Chains of edges that lie one behind the other in their first source are found by a window over source
coordinates, and the chains left are joined by doubling steps.

Words are removed where paths lie. Every edge of a run has a place on a chain; the edges of a run that lie on one chain are one span of it,
and each place where the run occurs is a place of that span: so paths get the coordinates of all their copies. Spans must be without gaps, and
the words at every place are held against the run's first source by a second, independent hash.

Null texts have no words. Each row of the input gives a row; rows that share a doc_id are separate documents, ordered by
text. Documents shorter than a window keep everything, and an empty table stays empty. Extra columns are ignored by ``report`` and kept by
``remove``, which refuses those with the names of its own results, and by ``rewrite``, whatever their names. A very long text is handled in
overlapping pieces.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .seq import BASES, NOT_BLANK, Prefix, Tokens, slices
from .store import Scratch, held, staying

LENGTH, ANCHOR = 35, 12


def _codes(data, offsets):
    t = Tokens(data, offsets, NOT_BLANK)
    return t, t.codes(BASES[0])


def word_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of windows of words (see repeats.RUNS) of docs (row, text)."""

    def run(batches):
        for b in batches:
            rows, found = b.column(0).to_numpy(zero_copy_only=False), []
            for first, _, data, offsets in slices(b.column(1)):
                t, codes = _codes(data, offsets)
                a, seg, doc, s, n = repeats.minimizer_runs(codes, t.ranges, length, k)
                found.append((a, seg, rows[first + doc], s, n))
            if found:
                yield repeats.pack(found)

    return docs.select("row", F.col("text").cast("string")).mapInArrow(run, repeats.RUNS)


def _proofs(t: Tokens) -> Prefix:
    """Hashes of spans of words that share nothing with those that runs are found by."""
    return Prefix(t.codes(BASES[2]), BASES[0])


_EDGES = "a long, seg long, copies long, row long, pos int, at int, size int, key long, head long, tail long, proof long"


def edges(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Edges of runs, read from their first source: (row, pos) where an edge starts, ``at`` which place of its run, ``size`` windows in it,
    its nodes head and tail, and the proof of the run's words.

    Runs of mixed anchors become single edges, others one compact edge each.
    """
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("a", "seg", "n", "s", "copies", "mixed")).alias("asked"))
    pairs = docs.select("row", F.col("text").cast("string").alias("text")).join(asked, "row")

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                rows, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
                per = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                flat = lists.flatten()
                a, seg, n, s, copies, mixed = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                for first, end, data, offsets in slices(b.column(1)):
                    t, codes = _codes(data, offsets)
                    mine = slice(per[first], per[end])
                    doc = np.repeat(np.arange(end - first), np.diff(per[first : end + 1]))
                    begin = t.ranges[doc] + s[mine]
                    steps = np.where(mixed[mine], n[mine], 1)
                    which = np.repeat(np.arange(len(doc)), steps)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps)
                    size = np.where(mixed[mine], 1, n[mine])[which]
                    at = begin[which] + inner
                    node, edge = Prefix(codes, BASES[1]), Prefix(codes, BASES[2])
                    proof = _proofs(t).spans(begin, begin + n[mine] + length - 1)[which]
                    places = [(s[mine][which] + inner).astype(np.int32), inner.astype(np.int32), size.astype(np.int32)]
                    columns = [a[mine][which], seg[mine][which], copies[mine][which], rows[first + doc[which]], *places]
                    hashes = [edge.spans(at, at + size + length - 1), node.spans(at, at + length - 1), node.spans(at + size, at + size + length - 1), proof]
                    names = ["a", "seg", "copies", "row", "pos", "at", "size", "key", "head", "tail", "proof"]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(h.view(np.int64)) for h in hashes)], names=names)

    return pairs.select("row", "text", "asked").mapInArrow(run, _EDGES)


def chains(graph: DataFrame) -> DataFrame:
    """Distinct repeated edges (row, pos, size, head, tail), linked through nodes with one edge in and one out.

    Adds ``start``, where the edge's chain begins in its source, and ``before``, the edge (row, pos) that the chain's first edge
    follows elsewhere, if any.
    """
    into = graph.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("n_in"), F.min(F.struct("row", "pos")).alias("last"))
    out = graph.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n_out"))
    simple = into.where("n_in = 1").join(out.where("n_out = 1"), "node").select(F.col("node").alias("head"), "last")
    linked = graph.join(simple, "head", "left")
    here = Window.partitionBy("row").orderBy("pos")
    # Only an edge that begins where the one before it in this source ends goes on its chain; equal nodes can lie further apart.
    adjacent = F.lag(F.expr("pos + size")).over(here) == F.col("pos")
    follows = F.coalesce(adjacent & (F.col("last.row") == F.col("row")) & (F.col("last.pos") == F.lag("pos").over(here)), F.lit(False))
    linked = linked.withColumn("opens", ~follows)
    start = F.max(F.when(F.col("opens"), F.col("pos"))).over(here)
    return linked.select("row", "pos", "size", start.alias("start"), F.when(F.col("opens"), F.col("last")).alias("before"))


def paths(edges_: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Nonbranching paths as chains of their source coordinates: (path, row, start, end, in words), ``path`` being shared by a path's chains.

    edges_: what ``chains`` gives. A chain's edges must fill its span without a gap; that is checked for every chain.
    """
    spans = edges_.groupBy("row", "start").agg(F.max(F.expr("pos + size")).alias("stop"), F.sum("size").alias("windows"), F.first("before", ignorenulls=True).alias("before"))
    spans = spans.withColumn("end", F.expr(f"stop + {length - 1}"))
    spans = spans.withColumn("end", F.when(F.col("windows") == F.col("stop") - F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("a chain does not fill its source span"))))
    spans = scratch.table(spans.select("row", "start", "end", "before"), "spans")
    # Chains that continue a path begun in another source: few, so doubling steps over them are short.
    ends = edges_.select(F.struct("row", "pos").alias("before"), F.struct("row", F.col("start").alias("pos")).alias("up"))
    jumps = spans.where("before is not null").select(F.struct("row", F.col("start").alias("pos")).alias("chain"), "before")
    jumps = scratch.table(jumps.join(ends, "before").where("chain <> up").select("chain", "up"), "jumps")
    count = jumps.count()
    for _ in range(count.bit_length()):  # enough for one path through all of them; a ring stops turning here
        further = jumps.select(F.col("chain").alias("up"), F.col("up").alias("next"))
        after = scratch.table(jumps.join(further, "up", "left").select("chain", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "jumps")
        moved = after.where("moved and up <> chain").limit(1).count()
        scratch.drop(jumps)
        jumps = after.drop("moved")
        jumps.scratch_path = after.scratch_path
        if not moved:
            break
    own = F.struct("row", F.col("start").alias("pos"))
    return spans.withColumn("chain", own).join(jumps, "chain", "left").select(F.coalesce("up", "chain").alias("path"), "row", "start", "end")


def marks(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Where paths lie in docs (row, text): marks (row, start, end, mask, s, n, proof) with the run each comes from, and the paths."""
    packed = repeats.repeated(word_runs(docs, length, k), scratch)
    leaders = packed.where("leader").select("a", "seg", "n", "row", "s", "copies", "mixed").dropDuplicates(["a", "seg"])
    every = scratch.table(edges(docs, leaders, length), "edges")
    sources = every.groupBy("a", "key").agg(F.sum("copies").alias("all_copies"), F.min(F.struct("row", "pos")).alias("source"))
    found = every.join(sources.where("all_copies > 1"), ["a", "key"]).select("a", "seg", "row", "pos", "at", "size", "head", "tail", "proof", "source")
    found = scratch.table(found, "repeated")
    scratch.drop(every)
    graph = found.where(F.struct("row", "pos") == F.col("source")).dropDuplicates(["row", "pos"]).select("row", "pos", "size", "head", "tail")
    chained = scratch.table(chains(graph), "chains")
    compacted = scratch.table(paths(chained, length, scratch), "paths")

    # A run's edges by the chain that they lie on, and how far the run is shifted against it.
    on = chained.select(F.struct("row", "pos").alias("source"), F.struct("row", "start").alias("chain"), (F.col("pos") - F.col("start")).alias("along"))
    spans = found.join(on, "source").groupBy("a", "seg", "proof", "chain", (F.col("at") - F.col("along")).alias("shift"))
    spans = spans.agg(F.min("at").alias("low"), F.max(F.expr("at + size")).alias("high"), F.sum("size").alias("windows"))
    high = F.when(F.col("high") - F.col("low") == F.col("windows"), F.col("high")).otherwise(F.raise_error(F.lit("a span of a chain has gaps")))
    spans = spans.groupBy("a", "seg", "proof").agg(F.collect_list(F.struct("low", high.alias("high"))).alias("spans"))
    # Rows of identical runs meet the spans while they are still packed.
    placed = repeats.places(packed.select("a", "seg", "n", "row", "s", "more").join(spans, ["a", "seg"]).drop("a", "seg"))
    placed = placed.select("row", "s", "n", "proof", F.explode("spans").alias("span"))
    end = F.col("s") + F.col("span.high") + F.lit(length - 1)
    out = placed.select("row", (F.col("s") + F.col("span.low")).alias("start"), end.cast("int").alias("end"), F.lit(None).cast("long").alias("mask"), "s", "n", "proof")
    return out, compacted


def _verify(t: Tokens, found: pa.Array, length: int) -> None:
    """The words at each mark's run must be those of the run's first source."""
    flat = found.flatten()
    if len(flat):
        base = np.repeat(t.ranges[:-1], found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        s, n, proof = (flat.field(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        if (_proofs(t).spans(base + s, base + s + n + length - 1).view(np.int64) != proof).any():
            raise ValueError("different words share the hashes of a run")


def _removed(spark: SparkSession, plain: DataFrame, length: int, k: int) -> DataFrame:
    """plain (doc_id, text, held): held, text, and what is left: ``kept_text``, ``n_words``, ``n_removed``."""
    scratch = Scratch(spark, "substrings")
    rows = repeats.keyed(plain, scratch)
    found, _ = marks(rows.select("row", "text"), scratch, length, k)
    per_row = scratch.table(repeats.marks_by_row(found), "marks")
    joined = rows.select("row", "held", "text").join(per_row, "row", "left").select("held", "text", "marks")

    def run(batches):
        for whole in batches:
            for first, end, data, offsets in slices(whole.column(1)):
                b = whole.slice(first, end - first)
                t = Tokens(data, offsets, NOT_BLANK)
                _verify(t, b.column(2), length)
                sizes = np.diff(t.ranges)
                gone = repeats.covered(b.column(2), sizes, length)
                removed = np.diff(np.append(0, np.cumsum(gone))[t.ranges])
                kept = []
                for x, r, i, j in zip(b.column(1).cast(pa.large_binary()).to_pylist(), removed.tolist(), t.ranges[:-1].tolist(), t.ranges[1:].tolist(), strict=True):
                    words = (x or b"").split()
                    kept.append(b" ".join(words if not r else compress(words, (~gone[i:j]).tolist())).decode())
                added = [pa.array(kept, pa.string()), pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *added], names=schema.names)

    added = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType([joined.schema["held"], T.StructField("text", T.StringType()), *added])
    return joined.mapInArrow(run, schema)


_ADDED = ("kept_text", "n_words", "n_removed")


def remove(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """docs with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``."""
    staying(docs, _ADDED)
    plain, back = held(docs)
    return _removed(spark, plain, length, k).select(*back, *_ADDED)


def rewrite(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, n_chars: str = "n_chars") -> DataFrame:
    """docs with the kept words as texts where any word is removed; other texts stay as they are. A column ``n_chars`` follows."""
    plain, back = held(docs)
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), n_chars: F.length("kept_text").cast("long")}
    columns = [F.when(cut, new[c]).otherwise(b).alias(c) if c in new else b for c, b in zip(docs.columns, back, strict=True)]
    return _removed(spark, plain, length, k).select(*columns)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(spark, docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
edges AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS edge FROM places),
repeated AS (SELECT edge FROM edges GROUP BY edge HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM edges JOIN repeated USING (edge)),
every AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM every ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
