"""Substring dedup, suffix-array dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sieveline.llm import components, repeats, simhash, store, substrings, suffixes

WORDS = [f"w{i}" for i in range(400)]


def _texts(seed, n=60):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(30, 90))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(passages).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "edit"
            parts.append(rng.choice([" ", "\n", "\t "]).join(words[rng.randint(0, 5) :]))
        out.append(rng.choice([" ", "\n"]).join(parts))
    return [*out, out[0], out[0], "", None, "short", "aé " * 80, "aé " * 80, "x" * 400]


def _brute_words(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def _brute_bytes(texts, length):
    seen = set()
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = 1
            seen.add(b[i : i + length])
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        yield len(b), int(gone.sum()), int(((gone[:-1] == 1) & (gone[1:] == 0)).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, docs, seed):
    texts = _texts(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(spark, docs(*texts)).collect()}
    assert got == dict(enumerate(_brute_words(texts, 35)))


@pytest.mark.parametrize(("seed", "most"), [(3, suffixes.MOST), (4, 400)])
def test_suffixes(spark, docs, monkeypatch, seed, most):
    monkeypatch.setattr(suffixes, "MOST", most)  # few: most anchors are too large for a shard
    texts = _texts(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(spark, docs(*texts)).collect()}
    assert got == dict(enumerate(_brute_bytes(texts, 100)))


def test_long_runs(spark, docs):
    """Runs of more windows than a mask has bits are cut."""
    texts = _texts(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove(spark, docs(*texts), length=200, k=40).collect()}
    assert got == {i: x[:3] for i, x in enumerate(_brute_bytes(texts, 200))}


def test_paths_are_compact(spark, docs):
    rng = random.Random(9)
    passage = " ".join(rng.choice(WORDS) for _ in range(300))
    rows = repeats.keyed(docs(passage, "before " + passage, passage + " after"), store.Scratch(spark, "t"))
    _, paths = substrings.marks(rows.select("row", "text"), store.Scratch(spark, "t"))
    found = paths.collect()
    assert len({r.path for r in found}) == 1 and sum(r.end - r.start - 34 for r in found) == 300 - 34


def test_edges_of_the_tables(spark, docs):
    """Empty tables, repeated rows and ids, null ids, clashing extra columns."""
    from pyspark.sql import functions as F

    empty = docs("a").limit(0)
    for f in (substrings.report, suffixes.report, simhash.report):
        assert f(spark, empty).count() == 0
    text = " ".join(WORDS[:60])
    twice = docs(text, text, "other", ids=[1, 1, None]).withColumn("row", F.lit(7)).withColumn("marks", F.lit(7)).withColumn("held", F.lit(7))
    for f, n in ((substrings.remove, 120), (suffixes.remove, len(text.encode()))):
        rows = f(spark, twice).collect()
        assert len(rows) == 3 and sum(r["n_removed"] for r in rows) == n
        assert all((r["row"], r["marks"], r["held"], r["lang"]) == (7, 7, 7, "en") for r in rows)
        with pytest.raises(ValueError, match="n_removed"):
            f(spark, twice.withColumn("n_removed", F.lit("mine")))
    named = twice.withColumn("n_removed", F.lit("mine")).withColumn("kept_text", F.lit("mine"))
    out = substrings.rewrite(spark, named)
    assert out.columns == named.columns
    assert sorted((r.text, r.n_chars, r.n_removed) for r in out.collect()) == [("", 0, "mine"), ("", 0, "mine"), ("other", 5, "mine")]
    got = {(r.doc_id, r.component_id) for r in simhash.report(spark, twice).collect()}
    assert got == {(1, 1), (None, None)}


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 50, 5000)
    whole = repeats.minimizer_runs(codes, np.array([0, 5000]), 35, 12)
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = repeats.minimizer_runs(codes, np.array([0, 5000]), 35, 12)
    assert whole[4].sum() == parts[4].sum() == 5000 - 34
    assert set(whole[0].tolist()) == set(parts[0].tolist())


def test_later_copies_of_all_lengths():
    rng = random.Random(5)
    for _ in range(60):
        base = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(2)]
        texts = [b[i : i + rng.randint(6, 14)] for b in rng.choices(base, k=rng.randint(1, 8)) for i in [rng.randint(0, 10)]]
        row, start = np.array([rng.randint(0, 3) for _ in texts]), np.arange(len(texts)) * 50
        first = {}
        for x, r, s in zip(texts, row, start, strict=True):
            for o in range(len(x) - 4):
                first[x[o : o + 5]] = min(first.get(x[o : o + 5], (9, 0)), (r, s + o))
        want = [sum(1 << o for o in range(len(x) - 4) if first[x[o : o + 5]] != (r, s + o)) for x, r, s in zip(texts, row, start, strict=True)]
        assert suffixes.later_copies(texts, row, start, 5).tolist() == want


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, distance):
    sets = simhash._Sets(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                sets.join(i, j)
    return [sets.root(i) for i in range(len(fps))]


def test_simhash(spark, docs):
    texts = _texts(7) + ["A b C d E f", "a B c D e F", "one two", "", None]
    got = {r.doc_id: r for r in simhash.report(spark, docs(*texts)).collect()}
    fps = [_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == _components(fps, 4)
    assert got[len(texts) - 1].fingerprint == "0" * 16


def test_links_of_clustered_fingerprints(spark, monkeypatch):
    """Chains and dense clusters, with leaves so small that they are searched as blocks."""
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for center in fps[:6]:
        x = center
        for _ in range(30):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    scratch = store.Scratch(spark, "t")
    for task_leaf in (simhash.TASK_LEAF, 20):
        edges = simhash.links(nodes, scratch, 4, task_leaf)
        found = {r.node: r.component for r in components.components(edges, scratch).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == _components(fps, 4)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, store.Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
