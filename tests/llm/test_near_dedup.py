"""The pipeline's near-dedup stage against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import jaccard

WORDS = [f"w{i}" for i in range(300)]


def _sets(texts):
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def _kept(ids, texts):
    sets = list(_sets(texts))
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = {i: n for n, i in enumerate(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or "")))}
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=order.get)
                up[b] = a
    return [i for i in range(len(ids)) if root(i) == i]


def _texts(seed):
    """Copies with edits (similarities on both sides of 0.8), a passage in many texts, a chain of copies, short and empty texts."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(40)]
    out = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 150))]
        out.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(copy)
    chain = [rng.choice(WORDS) for _ in range(100)]
    for i in range(30):
        chain = list(chain)
        chain[3 * i + 2] = "edit"
        out.append(chain)
    out += [passage + [rng.choice(WORDS) for _ in range(rng.randint(5, 80))] for _ in range(40)]
    texts = [" ".join(w) for w in out]
    return [*texts, "A b c d E f", "a B c d e F", "one two", "One  two", "", None, texts[0], texts[0]]


@pytest.mark.parametrize(("seed", "frequent", "listed"), [(1, jaccard.FREQUENT, jaccard.LISTED), (2, 1, jaccard.LISTED), (3, 1, 20)])
def test_near_dedup(spark, docs, monkeypatch, seed, frequent, listed):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LISTED", listed)
    texts = _texts(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    ids[5], ids[-1], ids[-2] = ids[20], None, ids[40]
    rows = docs(*texts, ids=ids).withColumn("place", F.lit(1))
    want = sorted((str(ids[i]), str(texts[i])) for i in _kept(ids, texts))
    got = corpus_pipeline.near_dedup(spark, rows, "")
    assert got.columns == rows.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == want
    assert 0 < len(want) < len(texts)


def test_near_dedup_of_an_empty_table(spark, docs):
    import corpus_pipeline

    assert corpus_pipeline.near_dedup(spark, docs("a").limit(0), "").count() == 0


def test_vantage_point_trees_over_fingerprints_come_first(spark, docs, monkeypatch):
    """What the trees link is connected as by brute force over the fingerprints, and it is compared before any prefix is made."""
    import corpus_pipeline

    class Reached(Exception):
        pass

    def stop(*_):
        raise Reached

    nodes, pairs, trees = [], [], []
    links, near_prints, similar = jaccard.simhash.links, jaccard.near_prints, jaccard.similar
    monkeypatch.setattr(jaccard.simhash, "links", lambda df, *rest: trees.append(1) or links(df, *rest))
    monkeypatch.setattr(jaccard, "near_prints", lambda df, *rest: nodes.extend(df.select("node", "fp").collect()) or near_prints(df, *rest))
    monkeypatch.setattr(jaccard, "similar", lambda df, *rest: pairs.extend(df.collect()) or similar(df, *rest))
    monkeypatch.setattr(jaccard, "ordered", stop)
    base = " ".join(WORDS)
    with pytest.raises(Reached):
        corpus_pipeline.near_dedup(spark, docs(base, base + " end", "one two three four five six", "start " + base, "", None), "")

    def connected(edges):
        name = {n: n for n, _ in nodes}
        for a, b in edges:
            low, high = sorted((name[a], name[b]))
            name = {n: low if m == high else m for n, m in name.items()}
        return name

    near = [(a, b) for a, f in nodes for b, g in nodes if bin((f ^ g) & (2**64 - 1)).count("1") <= 4]
    assert sorted(n for n, _ in nodes) == [0, 1, 2, 3] and pairs and trees
    assert connected(near) == connected([(r.a, r.b) for r in pairs])


def test_parities_keep_every_similar_pair(spark):
    """Sets of a similarity of 4/5 or more pass, with as many words of parities or half as many; sets far from each other mostly do not."""
    rng = np.random.default_rng(6)
    near, far = [], []
    for n in (1, 2, 9, 31, 33, 60, 64, 70, 128, 260, 500, 2100, 5000):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            lost = int(rng.integers(0, len(a) // 9 + 1))
            new = rng.integers(0, 1 << 63, int(rng.integers(0, (5 * (len(a) - lost) - 4 * len(a)) // 4 + 1))).astype(np.uint64)
            b = np.unique(np.concatenate((a[lost:], new)))
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            near += [(a, b), (b, a)]
            far.append((a, np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))))

    def passed(pairs):
        rows = [(jaccard.parities(a).tolist(), len(a), jaccard.parities(b).tolist(), len(b)) for a, b in pairs]
        return spark.createDataFrame(rows, "p array<long>, m int, q array<long>, n int").where(jaccard._may_agree("p", "m", "q", "n")).count()

    assert any(len(jaccard.parities(a)) != len(jaccard.parities(b)) for a, b in near)
    assert passed(near) == len(near)
    assert passed(far) <= len(far) // 10


def test_copies_that_are_not_similar_to_each_other_are_not_all_paired(spark, docs, monkeypatch):
    """A hundred copies of one text, edited in places of their own: nearly all pairs are under 4/5, and few of them are ever compared."""
    import corpus_pipeline

    rng = random.Random(8)
    base, texts = [f"b{i}" for i in range(200)], []
    for n in range(100):
        copy = list(base)
        for at in range(3):
            copy[5 + 60 * at + rng.randrange(50)] = f"edit{n}-{at}"
        texts.append(" ".join(copy))
    compared, similar = [], jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda df, *rest: compared.append(df.count()) or similar(df, *rest))
    rows = docs(*texts)
    want = sorted(str(texts[i]) for i in _kept(list(range(100)), texts))
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == want
    assert len(want) > 50 and sum(compared) < 1000, compared
