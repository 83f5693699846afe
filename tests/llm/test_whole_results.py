"""Verdicts, samples and pipeline stages against brute force; odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bpe, decontaminate, language, quality, records, repeats, store, substrings

SF = "/root/testdata/sf0.001"
WORD, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return re.findall(WORD, text or "")


def _buckets(words, buckets):
    """Buckets of the unigrams and bigrams of a word list."""
    pair = lambda *ws: np.int64(np.uint64(_chain(ws))) % buckets
    return [int(pair(w)) for w in words] + [int(pair(a, b)) for a, b in zip(words, words[1:], strict=False)]


def _chain(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def _quality(rows, trusted, buckets, threshold):
    """doc_id -> (llr, kept) of (doc_id, text) rows."""
    raw, good = Counter(), Counter()
    for d, t in rows:
        own = _buckets(_words(t), buckets)
        raw.update(own)
        if d in trusted:
            good.update(own)
    all_raw, all_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    out = {}
    for d, t in rows:
        w = _words(t)
        own = _buckets(w, buckets)
        llr = sum(math.log((good[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw) for b in own) / len(own) if own and good else 0.0
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        cover = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        out[d] = llr, len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and llr >= threshold
    return out


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _trusted(spark):
    return {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and not r.toxic}


def test_quality_verdicts(spark, given):
    """Log ratios and verdicts of real documents, all of whose labelled ones fit the trusted multinomial."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = _quality(list(given.items()), _trusted(spark), quality.BUCKETS, quality.THRESHOLD)
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[d].llr - llr) < 1e-6 for d, (llr, _) in want.items())
    sure = {d for d, (llr, _) in want.items() if abs(llr - quality.THRESHOLD) > 1e-6}
    assert all(got[d].kept == want[d][1] for d in sure) and len({k for _, k in want.values()}) == 2


def test_quality_stage(spark, given):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _quality(list(given.items()), _trusted(spark), quality.BUCKETS, quality.THRESHOLD)
    rows = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in rows} == {d: given[d] for d, (_, kept) in want.items() if kept}


def test_substring_stage(spark, given):
    docs, length = spark.read.parquet(f"{SF}/documents.parquet"), substrings.LENGTH
    words = {d: _words(t) for d, t in given.items()}
    seen = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    want, cut = {}, 0
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(length)}
        cut += bool(gone)
        want[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else given[d]
    rows = corpus_pipeline.substring_dedup(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in rows} == want and 0 < cut < len(want)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.text != given[r.doc_id])


def test_decontamination_stage(spark, given):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms = lambda t: re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = terms(r.text)
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(p) for p in phrases}
    clean = set()
    for d, t in given.items():
        w = terms(t)
        if not any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1)):
            clean.add(d)
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == clean and 0 < len(clean) < len(given)


def test_stages_on_odd_rows(spark, given):
    """Null and repeated ids, null and empty texts, extra columns of odd names: columns stay, and no row is lost that should stay."""
    some = sorted(given)[:40]
    rows = [(None if i % 3 == 0 else i // 4, given[d], i) for i, d in enumerate(some)] + [(None, None, 90), (7, "", 91), (7, "short", 92), (None, "x" * 300_000, 93)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars", "row", "row AS v", "row AS llr", "row AS marks", "row AS seg")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and len({r["row"] for r in got}) == len(got), name
        assert all(r["row"] == r["v"] == r["llr"] == r["seg"] for r in got), name
        if name == "substring_dedup":
            assert len(got) == len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(rows) and all(r.decodes for r in last)


def test_rows_without_ids_are_parted(spark):
    """Rows of one doc_id, or of none, are not one range, and stand in the order of their texts."""
    rows = [(None if i % 3 else i, f"{i * 7919 % 3000:05d} text") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.keyed(docs, store.Scratch(spark, "t"))
    sizes = [r[0] for r in got.groupBy(F.shiftright("row", 33)).count().select("count").collect()]
    ordered = got.orderBy("row").collect()
    assert max(sizes) < 1500 and [(r.doc_id, r.text) for r in ordered] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_records_without_ids(spark, docs):
    import public_tokenizers

    texts = [f"text {i % 50}" for i in range(200)] + [None, "", "y " * 50_000]
    table = docs(*texts, ids=[None if i % 3 else i for i in range(203)])
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(records.export(spark, table, path, parts=4).collect(), key=lambda r: r.start)
    ordered = sorted(((None if i % 3 else i), t) for i, t in enumerate(texts) if not i % 3)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(203)]
    assert [r.doc_id for r in got] == [None] * (203 - len(ordered)) + [d for d, _ in ordered]
    ids = lambda t: [*records.library(path).library.encode(t or "", add_special_tokens=False).ids, 2]
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(np.array(ids(t), "<u4").tobytes()) for t in texts)


def test_samples_are_bounded_by_rows(spark):
    """A doc_id that comes very often adds no more rows than its language may have; every window lets a bounded number of rows out of a task."""
    rows = [(1, "de", f"text {i}") for i in range(500)] + [(i, "en", f"word {i}") for i in range(2, 300)] + [(i, "fr", "123") for i in range(300, 320)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert df.where(language.held_out()).where("doc_id = 1").count() == 0
    got = language.sample(df, 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"de": 20, "en": 20}
    first = language.sample(df, 20).where("lang = 'en'").collect()
    hashed = df.where("lang = 'en'").where(~language.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()
    assert sorted(r.text for r in first) == sorted(r.text for r in hashed)
    plan = language.sample(df, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == plan.count("Window [") == 4  # by shares and over them, for ids and for rows


def test_very_many_languages_are_all_learned(spark, monkeypatch):
    """Every label is learned, unlisted ones in families that are dealt out; the rarest as well as the most frequent."""
    rng = random.Random(9)
    names = [f"x{i:02d}" for i in range(30)] + ["en", "de"]
    stems = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)] for n in names}
    rows = [(i, n, " ".join(rng.choices(stems[n], k=30))) for i, n in enumerate(names * 14)]
    monkeypatch.setattr(language, "MOST_ROWS", 320)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(df)
    assert sorted(x for own in model.languages.values() for x in own) == sorted(names)
    assert len(model.languages) == 4 and max(map(len, model.languages.values())) == 12
    got = language.identify(df, model).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_families_of_few_languages_are_their_own():
    assert language.families(["en", "xx", "yy"]) == {"en": "germanic", "xx": "only xx", "yy": "only yy"}


def test_empty_tables_and_long_texts(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.round_trip(docs("a").limit(0).select("doc_id", "text"), path).count() == 0
    assert language.identify(docs("a").limit(0)).count() == 0
    long = "alpha beta gamma " * 40_000
    assert bpe.round_trip(docs(long).select("doc_id", "text"), path).first().decoded == long
    assert language.identify(docs(long, long, "der und")).count() == 3
    items = spark.createDataFrame([(None, "beta gamma alpha beta gamma alpha beta gamma alpha beta")], "item_id string, text string")
    one = decontaminate.report(spark, docs(long, long), items).collect()
    assert [(r.n_words, r.n_items, r.contaminated) for r in one] == [(120_000, 0, True)] * 2
