"""BPE, token records, WARC, decontamination, quality, language, chat."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe, chat, decontaminate, language, quality, records, repeats, store, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["Hello  world,\n\n it's 12345 <|endoftext|> don't\t x", "", None, " lead and trail ", "éü漢字😀" * 9, "a\n b\n  c \r\n\td", "nospace" * 400, "  "]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'st ll\n\t\r\x1c\x85\xa0 é漢1,.<|>")) | st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40))
def test_encoding_equals_the_library(text):
    b = bpe.tokenizer(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    for texts in ([text], ["a b", text, "c\nd e", text]):
        found = b.encode(texts)
        assert found.to_pylist()[texts.index(text)] == ids
        assert records.library(PATH).encode(texts).equals(found)
    assert b.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(ids, skip_special_tokens=False)]


def test_bpe_digest(docs):
    got = {r.doc_id: r for r in bpe.digest(docs(*TEXTS), PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_encode_keeps_columns(docs):
    row = bpe.encode(docs("a b", ids=[4]).withColumn("x.y", F.lit(1)), PATH).first()
    assert (row["doc_id"], row["source"], row["x.y"]) == (4, "s", 1) and "text" not in row.asDict()


def test_token_records(spark, docs):
    ids = [30, 10, 20, 5, 7, 1, 2, 3]
    got = [tuple(r) for r in records.export(spark, docs(*TEXTS, ids=ids), PATH).orderBy("doc_id").collect()]
    at, want = 0, []
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        own = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert got == want
    assert records.export(spark, docs("a").limit(0), PATH).count() == 0
    assert [r.doc_id for r in records.export(spark, docs("a", "b", "a", ids=[2, None, 2]), PATH).orderBy("start").collect()] == [None, 2, 2]


def test_frames_notice_damage():
    data = bytearray(records.frame(b"payload") + records.frame(b"x"))
    assert records.unframe(memoryview(data))[0] == b"payload"
    assert records.unframe(memoryview(data), 23)[0] == b"x"
    for i in (0, 9, 14, 21):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bad))


def test_zip_directories(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored data")
        z.writestr("é.txt", b"x")
        z.writestr("packed", b"a" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a note"
    found = warc.members(out, len(out.getvalue()))
    assert set(found) == {"big", "é.txt"}
    at, n = found["big"]
    assert out.getvalue()[at : at + n] == b"stored data"
    # the ZIP64 forms: a directory whose counts do not fit in the short record
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 4)
    large = io.BytesIO()
    with zipfile.ZipFile(large, "w", zipfile.ZIP_STORED) as z:
        for name in ("a", "b", "c"):
            z.writestr(name, name.encode() * 9)
    data = large.getvalue()
    assert b"PK\x06\x06" in data and data.rfind(b"PK\x05\x06") > 0
    found = warc.members(large, len(data))
    assert {n: data[a : a + k] for n, (a, k) in found.items()} == {"a": b"a" * 9, "b": b"b" * 9, "c": b"c" * 9}
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)


def test_warc(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a b", big), (5, None, big), (3, "u\r\nv", big), (2, "u", other), (7, "u", None), (8, "u", "small"), (9, "u", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("terms", [decontaminate.BROADCAST_TERMS, 15])
def test_decontamination(spark, docs, monkeypatch, terms):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", terms)  # few: terms counted by joins, phrases in parts
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(60)] + ["é漢", "Zz"]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (25, 14, 10, 4, 1)] + ["same " * 12, "...", "", None]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.6:
            parts.append((rng.choice(items) or "").upper())
        texts.append(rng.choice([" ", ", ", "-"]).join(parts))
    texts += ["", None, "same " * 30]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, items[0])], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(spark, docs(*texts), bench).collect()}
    phrases = {}
    for k, x in [*enumerate(items), (99, items[0])]:
        w = _words(x)
        for i in range(max(1, len(w) - 9)):
            if w:
                phrases.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    for d, t in enumerate(texts):
        w, hit, names = _words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    names |= phrases[p]
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    kept = decontaminate.keep(spark, docs(*texts), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d in got if not got[d].contaminated}
    assert decontaminate.report(spark, docs("a b"), bench.limit(0)).first().n_hit == 0
    assert decontaminate.report(spark, docs("a b").limit(0), bench).count() == 0


def test_proximity(spark, docs):
    texts = ["x a y b z c", "c b a", "a b", "q b a c q", "a b c", "a b c c b a", "b b a c", None]
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    got = {r.doc_id: (r.n_near, r.n_hit) for r in decontaminate.scan(spark, docs(*texts), items).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (1, 0), 4: (1, 3), 5: (1, 3), 6: (1, 0), 7: (0, 0)}


def test_keep_judges_each_row(spark, docs):
    """A contaminated row without an id goes; a clean one that shares an id with a contaminated one stays, with all its columns."""
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    rows = docs("a b c", "clean", "x a b c", "clean too", ids=[None, 1, 1, None]).withColumn("row", F.lit("mine")).withColumn("held", F.lit(3))
    kept = decontaminate.keep(spark, rows, items)
    assert kept.columns == rows.columns
    assert sorted((str(r.doc_id), r.text, r.row, r.held) for r in kept.collect()) == [("1", "clean", "mine", 3), ("None", "clean too", "mine", 3)]


def test_warc_odd_pages(spark):
    """Line separators in urls, repeated and missing page_ids with equal payloads."""
    big = "p" * 1500
    urls = ["http://a/\x0bb\x0cc\x1cd\x1ee\x85f\u2028g\u2029h i\nj\rk", "u", None, "u", "u"]
    rows = [(1, urls[0], "x"), (2, urls[1], big), (2, urls[2], big), (None, urls[3], big), (None, urls[4], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()), key=str)
    assert got == sorted([(1, 1, "response", None), (2, 1500, "response", None), (2, 1500, "revisit", 2), (None, 1500, "revisit", 2), (None, 0, "response", None)], key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_quality(spark, docs):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + rng.choice("abcdef") for _ in range(80)) for _ in range(30)]
    junk = [" ".join(rng.choice(["QQ", "WW"]) + rng.choice("$$%%&&##") + str(rng.randint(0, 9)) for _ in range(80)) for _ in range(10)]
    odd = ["", None, "few words", "one two three " * 40, "l\nl\n \nm\nl|#", "a\x0bb\x0cc " * 30]
    texts = good + junk + odd
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(99, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs(*texts), labels, threshold=-0.5).collect()}  # few words: a wide margin
    for d, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            cover |= {i, i + 1, i + 2} if n[g] > 1 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, len(texts)))
    kept = quality.keep(docs(*texts), labels, threshold=-0.5)
    assert kept.columns == docs("a").columns and {r.doc_id for r in kept.collect()} == set(range(30))
    assert quality.judge(docs("a").limit(0), labels).count() == 0
    assert quality.judge(docs(*good), labels.limit(0), threshold=-0.5).where("kept").count() == 30


def test_repeated_words_without_packing(spark, monkeypatch):
    """Texts whose hashes do not fit with their places are compared as pairs, with the same counts."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abc") for _ in range(n)),) for n in (2, 3, 9, 40, 90)]
    df = spark.createDataFrame(rows, "t string").withColumn("w", quality.words(F.col("t")))
    want = [r[0] for r in df.select(quality.repeated_words(F.col("w"))).collect()]
    monkeypatch.setattr(quality, "_PLACE_BITS", 1)
    assert [r[0] for r in df.select(quality.repeated_words(F.col("w"))).collect()] == want


def test_languages(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "and", "of", "ing", "th"], "de": ["der", "und", "sch", "ich", "ung"], "fr": ["les", "eau", "que", "oux", "et"], "es": ["los", "ción", "que", "ado", "ñ"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=2)) for _ in range(40)), k) for i, k in enumerate(rng.choices(list(parts), k=400))]
    rows += [(1000, None, "en"), (1001, "123 ...", "en"), (1002, "", None), (None, "the and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert {r.lang_pred for r in got if r.doc_id >= 1000} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and none.count() == len(rows)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bob b", "yo"), (1, 3, None, None), (2, 0, "system", "x"), (None, 5, "ann", "q"), (1, 2, "bob b", "yo")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns, 5).collect()
    assert len(got) == 5 * 3 + 1
    for name in ("ann", "bob_b", "unknown"):
        mine = sorted((r for r in got if r.conv_id == 1 and r.participant == name), key=lambda r: r.turn_no)
        whole = "".join(r.segment for r in mine)
        assert [r.turn_no for r in mine] == [1, 2, 3, 4, 5]
        assert all(whole[r.start : r.start + len(r.segment)] == r.segment for r in mine)
        assert [whole[r.mask_start : r.mask_end] for r in mine if r.mask_start is not None] == {"ann": ["hi < |assistant|><|end|>\n"], "bob_b": ["yo<|end|>\n"] * 2, "unknown": ["<|end|>\n"]}[name]
        assert whole.count("<|assistant|>") == {"ann": 1, "bob_b": 2, "unknown": 1}[name]


def test_store_names_no_local_folder_on_a_cluster(spark):
    assert store.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs_ = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = store.Scratch(spark, "t").table(stage(spark, docs_, sf))
        assert docs_.columns == before.columns, name
    rows = {r.doc_id: r.text for r in docs_.collect()}
    assert 0 < len(rows) < before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs_, sf).collect()
    assert {r.doc_id: r.ids for r in last} == {d: LIBRARY.encode(t, add_special_tokens=False).ids for d, t in rows.items()}
    assert all(r.decodes for r in last)
    assert struct.calcsize("<qQ") == 16
