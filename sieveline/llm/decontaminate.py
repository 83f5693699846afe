"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. A phrase is ten consecutive words of a
benchmark item, or the whole of a shorter item that has words. The work goes as follows:

1. count how often each benchmark term occurs in the training texts;
2. pick the rarest and second rarest term of every phrase;
3. store the training postings (document row, position) of those terms, each with the codes of the words around it;
4. join phrases with postings of their rarest term, intersect with those of the second at the right offset, and compare what is left
   on all words. Proximity matches, a phrase's words in any order in as many consecutive words, come from the same postings.

Terms are compared by 64-bit codes. Null texts have no words. Every row of the documents gets a row of the result, repeated ones
as well, in ``scan``; extra columns are ignored there and kept by ``keep``, which judges every row by itself, with or without a doc_id. Without
items nothing is hit; without documents the result is empty. Words in an item without an item_id are hit, but it is no item of ``items``. A very
long text is read whole, alone in its step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .seq import ALPHANUMERIC, LOWER, Tokens, slices
from .store import Scratch, held

PHRASE = 10
#: Terms that are sent to all executors at a time, at most (8 bytes each). Beyond that terms are counted by joins, and phrases are searched in
#: several parts, each with a pass over the documents.
BROADCAST_TERMS = 2_000_000


def _tokens(column: pa.Array):
    for first, end, data, offsets in slices(column):
        t = Tokens(LOWER[data], offsets, ALPHANUMERIC)
        yield first, end, t, t.codes().view(np.int64)


def phrases(benchmark: DataFrame, width: int = PHRASE) -> DataFrame:
    """Rows (item, terms): the distinct phrases of each item; item is item_id as a string."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for first, _, t, codes in _tokens(b.column(1)):
                for k in range(len(t.ranges) - 1):
                    own = codes[t.ranges[k] : t.ranges[k + 1]]
                    found = {tuple(own[i : i + width].tolist()) for i in range(max(1, len(own) - width + 1))} if len(own) else ()
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([names[first + k]] * len(found), pa.string()), pa.array(list(found), pa.list_(pa.int64()))], names=["item", "terms"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item string, terms array<long>").distinct()


def _sorted_terms(terms: DataFrame) -> np.ndarray | None:
    """The distinct terms in order, if they are few enough to send around."""
    rows = terms.limit(BROADCAST_TERMS + 1).toArrow().column(0).to_numpy()
    return np.sort(rows) if len(rows) <= BROADCAST_TERMS else None


def count_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in docs: (term, n). Terms are found by the executors if few."""
    held = _sorted_terms(terms)
    sent = None if held is None else docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        total: dict | np.ndarray = np.zeros(len(sent.value), np.int64) if sent else {}
        for b in batches:
            for _, _, _, codes in _tokens(b.column(0)):
                if sent is None:
                    keys, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["term", "n"])
                elif len(sent.value):
                    at = np.searchsorted(sent.value, codes)
                    at[at == len(sent.value)] = 0
                    total += np.bincount(at[sent.value[at] == codes], minlength=len(total))
        if sent:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value), pa.array(total)], names=["term", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long")
    if sent is None:
        found = found.join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


_POSTING = "array<struct<term: bigint, pos: int, around: array<bigint>>>"


def store_index(docs: DataFrame, terms: DataFrame, scratch: Scratch, around: int = PHRASE - 1) -> DataFrame:
    """Store the postings of ``terms`` in docs (row, text): one row per document (row, n_words, postings), ``row`` being unique.

    A posting holds its position and the codes of the words from ``around`` before it to ``around`` after it; places
    beyond the text's edges hold null.
    """
    held = _sorted_terms(terms)
    if held is None:
        raise ValueError(f"more than {BROADCAST_TERMS} terms: index them in parts")
    sent = docs.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([docs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("postings", T._parse_datatype_string(_POSTING))])

    def run(batches):
        wanted = sent.value
        for b in batches:
            for first, end, t, codes in _tokens(b.column(1)):
                if len(wanted) and len(codes):
                    at = np.searchsorted(wanted, codes)
                    at[at == len(wanted)] = 0
                    hits = np.flatnonzero(wanted[at] == codes)
                else:
                    hits = np.zeros(0, np.int64)
                per = np.searchsorted(hits, t.ranges)
                owner = np.repeat(np.arange(len(t.ranges) - 1), np.diff(per))
                place = hits[:, None] + np.arange(-around, around + 1)
                out = (place < t.ranges[:-1][owner][:, None]) | (place >= t.ranges[1:][owner][:, None])
                near = pa.array(codes[np.clip(place, 0, max(len(codes) - 1, 0)).ravel()] if len(hits) else np.zeros(0, np.int64), pa.int64(), mask=out.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hits) + 1, dtype=np.int32) * (2 * around + 1)), near)
                entry = pa.StructArray.from_arrays([pa.array(codes[hits]), pa.array((hits - t.ranges[:-1][owner]).astype(np.int32)), lists], ["term", "pos", "around"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, end - first), pa.array(np.diff(t.ranges).astype(np.int64)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), entry)],
                    names=["row", "n_words", "postings"],
                )

    return scratch.table(docs.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "postings")


def matches(index: DataFrame, plans: DataFrame, around: int = PHRASE - 1) -> DataFrame:
    """Places of phrases: (row, phrase, start, length, near). Exact matches have a start; near tells of a proximity match there.

    plans: (phrase, terms, first, first_at, second, second_at), the two rarest terms and where in the phrase they are. A
    phrase of one distinct word has no second.
    """
    postings = index.where(F.size("postings") > 0).select("row", F.explode("postings").alias("p")).select("row", "p.term", "p.pos", "p.around")
    lead = postings.join(plans, postings["term"] == plans["first"]).where(F.size(F.array_except("terms", "around")) == 0)
    width, start = F.size("terms"), F.col("pos") - F.col("first_at")
    lead = lead.select(
        "row",
        "phrase",
        "terms",
        "second",
        start.alias("start"),
        width.alias("length"),
        F.slice("around", around + 1 - F.col("first_at"), width).alias("found"),
        (start + F.col("second_at")).alias("second_pos"),
        # the spans of as many words as the phrase has, round the rarest term: places 1 + around - i to ... of what is stored
        F.exists(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.array_sort(F.slice("around", around + 1 - i, width)) == F.array_sort("terms"),
        ).alias("near"),
    )
    other = postings.select("row", F.col("term").alias("second"), F.col("pos").alias("second_pos"), F.lit(True).alias("met")).distinct()
    two = lead.where("second is not null").join(other, ["row", "second", "second_pos"], "left")
    both = two.select("row", "phrase", "start", "length", "near", (F.coalesce("met", F.lit(False)) & (F.col("found") == F.col("terms"))).alias("exact"))
    one = lead.where("second is null").select("row", "phrase", "start", "length", "near", (F.col("found") == F.col("terms")).alias("exact"))
    found = both.unionByName(one).where("near or exact")
    return found.select("row", "phrase", F.when(F.col("exact") & (F.col("start") >= 0), F.col("start")).alias("start"), "length", "near")


def _scan(rows: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = PHRASE) -> DataFrame:
    """For rows (row, text) with a row each: row, n_words, n_hit, items (sorted ids of those that occur), n_near."""
    items = scratch.table(phrases(benchmark, width), "phrases")
    distinct = scratch.table(items.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "distinct")
    vocabulary = distinct.select(F.explode("terms").alias("term")).distinct()
    counts = scratch.table(count_terms(rows, vocabulary), "counts")

    placed = distinct.select("phrase", F.posexplode("terms").alias("at", "term")).groupBy("phrase", "term").agg(F.min("at").alias("at"))
    ranked = placed.join(counts, "term").groupBy("phrase").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "at"))), 1, 2).alias("rare"))
    chosen = distinct.join(ranked, "phrase").select(
        "phrase",
        "terms",
        F.col("rare")[0]["term"].alias("first"),
        F.col("rare")[0]["at"].alias("first_at"),
        F.get("rare", 1)["term"].alias("second"),
        F.get("rare", 1)["at"].alias("second_at"),
    )
    plans = scratch.table(chosen, "plans")
    parts = max(1, -(-4 * plans.count() // BROADCAST_TERMS))  # two terms a phrase at most, and room for uneven parts
    found, sizes = [], None
    for part in range(parts):
        own = plans.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        terms = own.select(F.col("first").alias("term")).unionByName(own.where("second is not null").select(F.col("second").alias("term"))).distinct()
        index = store_index(rows, terms, scratch, width - 1)
        found.append(scratch.table(matches(index, own, width - 1), "matches"))
        sizes = index if sizes is None else sizes
    every = reduce(DataFrame.unionByName, found)
    exact = every.where("start is not null")

    words = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))
    covered = exact.select("row", words.alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = exact.select("row", "phrase").distinct().join(distinct, "phrase").join(items, "terms").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    near = every.where("near").select("row", "phrase").distinct().groupBy("row").agg(F.count("*").alias("n_near"))
    out = sizes.select("row", "n_words").join(covered, "row", "left").join(named, "row", "left").join(near, "row", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("row", "n_words", number("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), number("n_near"))


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = PHRASE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted item ids that occur in it), n_near (phrases whose words lie together in any order)."""
    scratch = Scratch(spark, "decontaminate")
    rows = repeats.keyed(docs.select("doc_id", "text"), scratch)
    return rows.select("row", "doc_id").join(_scan(rows, benchmark, scratch, width), "row").drop("row")


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The scan as digest columns."""
    return scan(spark, docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def keep(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a phrase of the benchmark."""
    scratch = Scratch(spark, "decontaminate")
    plain, back = held(docs)
    rows = repeats.keyed(plain, scratch)
    gone = scratch.table(_scan(rows, benchmark, scratch).where("n_hit > 0").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select(*back)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
cut AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS p, list_sort(w[i:i + 9]) AS bag, least(10, len(w)) AS n FROM cut),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT r, i, q.n, item
  FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places) q JOIN phrases ON q.p = phrases.p AND q.n = phrases.n),
spread AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM hits),
bags AS (SELECT DISTINCT p, bag, n FROM phrases),
near AS (
  SELECT r, count(DISTINCT p) AS n_near
  FROM (SELECT r, n, list_sort(w[i:i + n - 1]) AS bag FROM places) q JOIN bags ON q.bag = bags.bag AND q.n = bags.n GROUP BY r),
covered AS (SELECT r, count(*) AS n_hit FROM spread GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""
