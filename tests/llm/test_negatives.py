"""Hard negatives against all pairs of a small table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, most=10, low=30, high=90):
    held = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        held.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a in held:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in held if b is not a]
        for s, p, _ in sorted((x for x in scored if x[2]), key=by)[:positives]:
            found = sorted((x for x in scored if not x[2] and low * s <= 100 * x[0] <= high * s), key=by)[:most]
            out += [(a[0], p, i + 1, n, s, t) for i, (t, n, _) in enumerate(found)]
    return out


def vectors(n, dims=10, seed=1, labels=10):
    r = random.Random(seed)
    rows = [(i, [r.choice((-0.5, 0.25, 0.5, r.gauss(0, 0.4))) for _ in range(dims)], r.randrange(labels)) for i in range(n)]
    return rows


def got(df, **kw):
    return sorted(map(tuple, negatives.mine(df.sparkSession, df, **kw).collect()), key=str)


@pytest.mark.parametrize("blocks", [{}, {"chunk": 3, "most_rows": 16, "most_anchors": 3}])
def test_equals_all_pairs(spark, blocks):
    rows = vectors(240)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, every=20, **blocks) == sorted(brute(rows, 20), key=str) != []


def test_rows_that_take_no_part_and_odd_rows(spark):
    rows = vectors(60, 4, labels=3)
    rows += [(100, None, 1), (101, [0.5, None, 0.5, 0.5], 1), (102, [0.5, float("nan"), 1.0, 1.0], 1), (103, [float("inf")] * 4, 1), (104, [0.5] * 4, None)]
    rows += [(None, [0.5, 0.5, 0.25, 0.25], 1), (None, [0.5, 0.5, 0.25, 0.25], 2), (200, [], 1), (201, [0.5], 2), (202, [0.5] * 9, 1)]
    rows += [rows[0], rows[0], (20, [0.5, -0.5, 0.5, 0.5], 2), *[(900, [0.25] * 4, 1)] * 7]  # copies of anchors and others
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("key", F.lit("x")).withColumn("r", F.lit(1))
    assert got(df, every=20, chunk=2, most_rows=9, most_anchors=2) == sorted(brute(rows, 20), key=str)


def test_one_label_for_a_third(spark):
    r = random.Random(4)
    rows = [(i, v, 3 if i % 3 == 0 else r.randrange(10)) for i, v, _ in vectors(300, 6, 2)]
    rows += [(i, [0.5] * 6, 3) for i in range(300, 500)]  # very many ties
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, most_rows=32) == sorted(brute(rows), key=str)


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame(vectors(5), SCHEMA)
    assert got(df.where("false")) == [] == got(df.where("vec_id > 0"))


def test_products_are_exact_beyond_doubles():
    a, b = np.full((2, 3), 1 << 28, np.int64) + 1, np.full((1, 3), 1 << 29, np.int64) - 1
    assert negatives.product(a, b).tolist() == [[3 * ((1 << 28) + 1) * ((1 << 29) - 1)]] * 2
    for x in (5, -(1 << 15), 1 << 15, (1 << 31) - 1, -(1 << 31), 1 << 40):
        assert negatives.unpacked(negatives.packed(np.array([x, 0]))).tolist() == [x, 0]


def test_scores_beyond_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e12] * 2, 1), (1, [1e12] * 2, 1)], SCHEMA)
    with pytest.raises(Exception, match="long does not hold"):
        got(df)


def test_a_wide_row_makes_small_blocks(spark, monkeypatch):
    rows = vectors(40, 4, labels=2)
    rows[7] = (7, [0.5] * 30, 1)
    df = negatives.prepared(spark.createDataFrame(rows, SCHEMA), 256, 7, 10).coalesce(1).withColumn("key", F.monotonically_increasing_id())
    monkeypatch.setattr(negatives, "CELLS", 60)
    sizes = [r.n for r in negatives.blocks(df, 64, 8).where("chunk = 0").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 15 and 2 >= min(sizes)
