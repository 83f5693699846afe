"""Packing: whole documents, full windows, neighbours in BM25's order."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe, packing, records

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = "river stone market engine violet garden planet copper silent window harbor meadow castle thunder".split()


def texts(n, seed=5):
    r = random.Random(seed)
    out = [" ".join(r.choices(WORDS[(t := r.randrange(4)) : t + 9], k=r.choice((0, 1, 3, 40, 200)))) for _ in range(n)]
    return [*out, "", None, "same text here", "same text here", " ".join(r.choices(WORDS, k=5000))]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def whole(pieces, docs, window):
    """Every id in one piece, sequences without gaps, lengths of a window or powers of two. Returns the sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == docs.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        ids = ids_of(docs[i])
        at = 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)
    return by_sequence


def test_all_ids_once_and_no_padding(spark, docs):
    held = dict(enumerate(texts(120)))
    rows = packing.report(spark, docs(*held.values()), PATH).collect()
    found = whole(rows, held, 1024)
    full = sum(sum(p.length for p in own) == 1024 for own in found.values())
    assert full >= sum(len(ids_of(t)) for t in held.values()) // 1024 - 4  # one open window for each of four tasks


def test_small_windows_and_shards(spark, docs):
    held = dict(enumerate(texts(60, 9)))
    rows = packing.pack(spark, docs(*held.values()), PATH, window=64, shard=7).withColumn("ids_crc32", F.crc32("ids")).collect()
    whole(rows, held, 64)


def test_odd_tables(spark, docs):
    assert packing.report(spark, docs("a").where("false"), PATH).collect() == []
    rows = packing.report(spark, docs("a b", "a b", "c", None, ids=[None, None, 5, 5]).withColumn("sequence_id", F.lit("x")), PATH).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in rows if p.start == 0) == [(0, 3), (0, 3), (5, 1), (5, 2)]


def test_neighbours_come_in_the_order_of_bm25():
    r = random.Random(3)
    pieces = [np.array(r.choices(range(1, 40), k=r.randint(1, 60)), np.int64) for _ in range(50)]
    df = Counter(t for p in pieces for t in set(p.tolist()))
    mean = sum(map(len, pieces)) / len(pieces)
    idf = np.array([math.log(1 + (50 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(41)])
    out, used, seeds = packing.Windows(128), set(), 0
    for seed, order in packing.fill(packing.Index(pieces, idf, mean), list(range(50)), [0] * 50, out):
        score = {}
        used |= {p[0] for p in [*out.done, *out.open]}
        for i in set(range(50)) - used:
            tf, score[i] = Counter(pieces[i].tolist()), 0.0
            for t in set(pieces[seed].tolist()):
                score[i] += idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(pieces[i]) / mean))
        assert set(order.tolist()) == score.keys()
        ranked = [score[i] for i in order.tolist()]
        assert all(a >= b - 1e-9 for a, b in zip(ranked, ranked[1:]))
        seeds += 1
    out.finish()
    assert seeds > 5 and sum(p[2] for p in out.done) == sum(map(len, pieces))


def test_statistics_cover_all_tails(spark):
    df = spark.createDataFrame([(np.array(x, "<u4").tobytes(),) for x in ([1, 1, 2], [2], [2, 3])] * 5, "ids binary").repartition(4)
    idf, mean = packing.statistics(df.withColumn("doc_id", F.lit(1)), 5)
    assert mean == 2.0
    assert np.allclose(idf, [math.log(1 + (15 - d + 0.5) / (d + 0.5)) for d in (0, 5, 15, 5, 0)])


def test_copies_share_windows(spark, docs):
    """Texts about two things, alternating: sequences hold one of them, apart from the borders."""
    held = {i: " ".join([("alpha", "omega")[i % 2]] * 20 + WORDS[: i % 5]) for i in range(200)}
    kinds = defaultdict(set)
    for p in packing.pack(spark, docs(*held.values()), PATH, window=128).collect():
        kinds[p.sequence_id].add(p.doc_id % 2)
    assert sum(len(k) == 1 for k in kinds.values()) >= 0.8 * len(kinds)


def test_words_are_asked_for_once_whatever_marks_follow():
    """Ids by word and marks are the library's, and a word is met once."""
    encoder = records.LibraryEncoder(PATH)
    r = random.Random(4)
    parts = ["river", "Übermaß", "×", "ɏɐ", "x²", "don't", "'s", ",", ".'", "!!", "$$$", "_", "7", "漢", "\x85", " ", " ", "\n", "a" * 60, ""]
    odd = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    assert encoder.encode(odd).to_pylist() == [LIBRARY.encode(t, add_special_tokens=False).ids for t in odd]
    encoder.forget()
    encoder.encode(["a river, river. river! river\nriver?"])
    assert sorted(w for w in encoder.known if "river" in w) == [" river", "river"]


def test_met_words_cost_no_step_of_python_each():
    """Words met before are looked up by column: calls from Python don't grow with them."""
    encoder = records.LibraryEncoder(PATH)
    r = random.Random(6)
    text = " ".join({"".join(r.choices("abcdefgh", k=9)) for _ in range(5000)})
    first, calls = encoder.encode([text]), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        second = encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert second.equals(first) and first.to_pylist() == [LIBRARY.encode(text, add_special_tokens=False).ids]
    assert calls.total() < 2000


def test_few_words_are_remembered_and_ids_stay_right(monkeypatch):
    """The bound holds after each call, whatever a call brings; words that are forgotten and met again have the same ids."""
    for module in (bpe, records):
        monkeypatch.setattr(module, "CACHE_WORDS", 20, raising=False)
    encoder = records.LibraryEncoder(PATH)
    r = random.Random(8)
    words = ["".join(r.choices("aeistnr", k=r.randint(1, 6))) for _ in range(300)]
    for n in (1, 15, 300, 15, 3, 300, 0, 40):
        held = [" ".join(r.choices(words, k=n)) + m for m in ("", ".", "!?", "\n")]
        assert encoder.encode(held).to_pylist() == [LIBRARY.encode(t, add_special_tokens=False).ids for t in held]
        assert len([*encoder.known, *getattr(encoder.known, "older", ())]) <= 40
