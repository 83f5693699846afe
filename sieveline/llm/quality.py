"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. Every document is scored by

    mean over its word unigrams and bigrams g of  log p_trusted(bucket(g)) - log p_raw(bucket(g))

where both are multinomials over ``buckets`` hash buckets with add-one smoothing. The raw one is counted over all
documents, the trusted one over the documents of a bounded sample of the trusted labels. A document whose mean falls
below ``threshold`` is rejected; there is no randomness. Everything runs as DataFrame functions.

Null texts have no words and fail the base rules; so do empty ones. Repeated rows are judged alike, each one is
returned. Extra columns are ignored by ``judge`` and kept by ``keep``. Without any trusted text every ratio is 0
and only the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets; labelled documents that the trusted multinomial is fitted on, at most; least mean log ratio kept.
BUCKETS, TRUSTED_SAMPLE, THRESHOLD = 10_000, 20_000, -0.05
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text (null: none). A one-character separator keeps the split off the regex engine."""
    spaced = F.coalesce(text, F.lit(""))
    for c in _BLANKS:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


#: A window's hash and place share a number while they can be sorted so: 44 bits of the hash, 20 of the place.
_PLACE_BITS = 20
_HIGH = -(1 << _PLACE_BITS)


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that occur at least twice in the text, the first included.

    Windows are compared by 64-bit hashes. Texts without equal hashes are done after one look. Else hashes are sorted together with
    their places, as single numbers where the upper 44 bits of the hashes part them as well as all 64 do, and as pairs where not.
    """

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: F.least(b - a, F.lit(width)))
        # zip_with pads the shorter side with null, which stands for the last window: it covers its full width
        return F.aggregate(steps, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(width)))

    def union(hit: Column) -> Column:
        return _let(F.sort_array(F.filter(hit, lambda x: x.isNotNull())), covered)

    def by_pairs(h: Column) -> Column:
        def twice(keys: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(keys, a)["h"] == F.get(keys, b)["h"], F.lit(False))
            return union(F.transform(keys, lambda k, i: F.when(same(i, i - 1) | same(i, i + 1), k["i"])))

        return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)

    def by_numbers(h: Column) -> Column:
        def twice(keys: Column) -> Column:
            near = lambda k, i: F.shiftright(k.bitwiseXOR(F.coalesce(F.get(keys, i), F.bitwise_not(k))), _PLACE_BITS) == 0
            return union(F.transform(keys, lambda k, i: F.when(near(k, i - 1) | near(k, i + 1), k.bitwiseAND(F.lit(~_HIGH)).cast("int"))))

        return _let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long")))), twice)

    def counted(h: Column) -> Column:
        upper = F.size(F.array_distinct(F.transform(h, lambda x: F.shiftright(x, _PLACE_BITS))))
        distinct = F.size(F.array_distinct(h))
        return F.when(distinct == F.size(h), 0).when((F.size(h) < 1 << _PLACE_BITS) & (upper == distinct), by_numbers(h)).otherwise(by_pairs(h))

    hashed = F.transform(F.sequence(F.lit(0), F.size(tokens) - width), lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(width))))
    return F.when(F.size(tokens) < width, 0).otherwise(_let(hashed, counted)).cast("long")


def statistics(text: Column, w: Column) -> list[Column]:
    """The base statistics of a text and its words ``w`` as named columns."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" " + _BLANKS)) != "")
    symbols = sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in _SYMBOLS), F.lit(0))
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    ]


def _bucket(buckets: int, *grams: Column) -> Column:
    return F.pmod(F.xxhash64(*grams), F.lit(buckets)).cast("int")


def buckets_of(w: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the unigrams and bigrams of a word list, as pairs; the first word has no bigram."""
    return F.transform(w, lambda x, i: F.array(_bucket(buckets, x), F.when(i > 0, _bucket(buckets, F.get(w, i - 1), x))))


def mean_ratio(w: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Mean of the table's values over the unigrams and bigrams of a word list; 0 for none."""
    each = F.transform(w, lambda x, i: F.get(table, _bucket(buckets, x)) + F.when(i > 0, F.get(table, _bucket(buckets, F.get(w, i - 1), x))).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(2 * F.size(w) - 1, F.lit(1))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = TRUSTED_SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log p_trusted - log p_raw of each bucket; ``buckets`` numbers, whatever the size of the corpus."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    trusted = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("trusted", F.lit(1))
    # At most ``sample`` ids, so the broadcast is bounded.
    flagged = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).join(F.broadcast(trusted), "doc_id", "left")
    grams = flagged.select("trusted", F.explode(F.flatten(buckets_of(F.col("w"), buckets))).alias("b")).where("b is not null")
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted")).collect()
    counts = {r["b"]: (r["raw"], r["trusted"]) for r in rows}
    if not any(t for _, t in counts.values()):
        return [0.0] * buckets
    all_raw, all_trusted = (sum(c[k] for c in counts.values()) + buckets for k in (0, 1))
    found = (counts.get(b, (0, 0)) for b in range(buckets))
    return [math.log((t + 1) / all_trusted) - math.log((r + 1) / all_raw) for r, t in found]


def _verdict(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, threshold: float, buckets: int, sample: int) -> DataFrame:
    """docs with a struct ``v`` behind its columns: the statistics, base_failed, llr and kept."""
    ratios = log_ratios(docs, labels, buckets, sample, doc_id, text)
    table = F.split(F.lit(",".join(f"{x:.9f}" for x in ratios)), ",").cast("array<double>")
    found = _let(words(F.col(text)), lambda w: F.struct(*statistics(F.col(text), w), mean_ratio(w, table, buckets).alias("llr")))

    def decided(v: Column) -> Column:
        failed = (v["n_words"] < LEAST_WORDS) | (100 * v["n_repeat_words"] > MOST_REPEATED_PERCENT * v["n_words"])
        fields = [v[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")]
        return F.struct(*fields, failed.alias("base_failed"), (~failed & (v["llr"] >= threshold)).alias("kept"))

    # Behind a generator a filter on the verdict stays where it is; pushed below it, the verdict would be worked out twice.
    return docs.select(*(F.col(c) for c in docs.columns), F.explode(F.array(_let(found, decided))).alias("v"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, sample: int = TRUSTED_SAMPLE) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, the mean log ratio ``llr`` and ``kept``."""
    return _verdict(docs.select("doc_id", "text"), labels, "doc_id", "text", threshold, buckets, sample).select("doc_id", "v.*")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, sample: int = TRUSTED_SAMPLE) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    kept = _verdict(inner, labels, names["doc_id"], names["text"], threshold, buckets, sample).where("v.kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
