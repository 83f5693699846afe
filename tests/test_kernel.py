"""The detection kernel: large rule sets, many findings in one input, places."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.functions import keywords
from sieveline.functions import text as fn
from sieveline.operators import detect, scan
from sieveline.plans import rules as R

SECRET = "aB3dE5gH7jK9mN1pQ2rS4tU6"
FIXTURE = R.Rule("fixture", "Fixture", "fixture_([A-Za-z0-9]{24})", 1, ("fixture_",))


def _rules(n):
    return tuple(R.Rule(f"r{i:03d}", "R", rf"\b(k{i:03d}_[A-Za-z0-9]{{8}})\b", 1, (f"K{i:03d}_",)) for i in range(n))


def _inputs(spark, *contents):
    return spark.createDataFrame([(f"p{i}", f"p{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, identity string, content binary")


def test_automaton_equals_contains(spark):
    r = random.Random(1)
    words = [tuple("".join(r.choices("abAB-é", k=r.randint(1, 4))) for _ in range(r.randint(0, 3))) for _ in range(40)]
    texts = ["".join(r.choices("abABcé-\n", k=r.randint(0, 30))) for _ in range(200)] + [""]
    views = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(fn.latin1(F.encode("t", "UTF-8"))).alias("v"))
    low = lambda x: x.encode().lower()
    for row in views.select("t", F.get(keywords.finder(words)(F.col("v")), F.lit(0)).alias("ids")).collect():
        assert row.ids == [i for i, own in enumerate(words) if not own or any(low(w) in low(row.t) for w in own)]


def test_automaton_over_arrays_of_views(spark):
    row = spark.createDataFrame([(["xx", None, "abc x"],), (None,), ([],)], "v array<string>").select(keywords.finder([("abc",), (), ("x",)])(F.col("v")).alias("i"))
    assert [r.i for r in row.collect()] == [[[1, 2], [], [0, 1, 2]], [], []]


def test_large_rule_sets_find_what_single_rules_find(spark):
    """Gated by the automaton, by single searches, and not at all."""
    texts = [(f"a k{i % 60:03d}_abcdefgh K{(i * 7) % 60:03d}_ABCDEFGH " * (i % 3)).encode() for i in range(90)]
    rules = _rules(60)
    rows = _inputs(spark, *texts)
    assert sum(len(r.keywords) for r in rules) > detect.FEW

    def found(config):
        return sorted((r.path, r.rule_id, r.start, r.end) for r in scan.findings(rows, config).collect())

    many = found(scan.Config(rules, builtin=False))
    few = sorted(x for k in range(0, 60, 20) for x in found(scan.Config(rules[k : k + 20], builtin=False)))
    view = rows.select("path", F.lower(fn.latin1("content")).alias("low"), fn.latin1("content").alias("view"))
    ungated = view.select("path", F.explode(detect.all_candidates(F.col("view"), F.col("low"), F.col("path"), list(rules), gate=False)).alias("c"))
    assert many == few == sorted((r.path, r.c.rule_id, r.c.start, r.c.end) for r in ungated.collect()) and len(many) == 90


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = _inputs(spark, *((f"k{i:03d}_abcdefgh\n" * 20).encode() for i in range(200)))

    def timed(n):
        began = time.time()
        found = scan.findings(rows, scan.Config(_rules(n), builtin=False))
        assert found.count() == 20 * min(n, 200)
        return time.time() - began, found._jdf.queryExecution().analyzed().treeString().count("regexp_replace(")

    timed(25)  # compiled code
    (few, patterns), (many, same) = timed(25), timed(225)
    assert many < 2 * few + 1 and patterns == same  # rules are data, not branches of the plan


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le"])
def test_very_many_findings_in_one_input_take_linear_time(spark, codec):
    def timed(n):
        text = "".join(f"é fixture_{SECRET}\n" for _ in range(n))
        data = text.encode(codec) if codec == "utf-8" else b"\xff\xfe" + text.encode(codec)
        began = time.time()
        found = scan.scan_column(_inputs(spark, data), F.col("path"), F.col("content"), scan.Config((FIXTURE,), builtin=False, base64=False))
        last = found.agg(F.count("*").alias("n"), F.max_by(F.struct("line", "column", "start", "end"), "start").alias("last")).first()
        assert last.n == n and last.last.line == n
        assert last.last.column == len("é fixture_".encode(codec)) and data[last.last.start : last.last.end].decode(codec) == SECRET
        return time.time() - began

    timed(1000)
    assert timed(100_000) < 60 * max(timed(2_000), 0.5)


def test_very_many_base64_runs_in_one_input(spark):
    import base64

    run = base64.b64encode(f"x fixture_{SECRET} y".encode()).decode()
    found = scan.findings(_inputs(spark, (f"{run}\n" * 3000).encode()), scan.Config((FIXTURE,), builtin=False)).collect()
    assert len(found) == 3000 and {r.line for r in found} == set(range(1, 3001)) and {(r.column, r.end - r.start) for r in found} == {(0, len(run))}


def test_scan_column_decodes_utf16(spark):
    mark = b"\xff\xfe"
    rows = _inputs(spark, mark + f"fixture_{SECRET}".encode("utf-16-le"), mark + b"a", f"fixture_{SECRET}".encode())
    config = scan.Config((FIXTURE,), builtin=False)
    found, errors = scan.scan_column(rows, F.col("path"), F.col("content"), config, errors=True)
    assert sorted((r.path, r.start) for r in found.collect()) == [("p0", 18), ("p2", 8)]
    assert [tuple(r) for r in errors.collect()] == [("p1", "invalid UTF-16 content")]
    with pytest.raises(Exception, match="invalid UTF-16 content"):
        scan.scan_column(rows, F.col("path"), F.col("content"), config).collect()


def test_rules_of_both_engines_in_one_set(spark):
    rules = (FIXTURE, R.Rule("py", "P", r"id=(?:k_([a-z]{4})|t_([a-z]{4}))", None, ("id",), path=r"^p\d", exclude_paths=("p1$",), allowlist=(R.Allow(stopwords=("WXYZ",)),)))
    text = f"id=t_abcd id=k_wxyz fixture_{SECRET}".encode()
    got = scan.findings(_inputs(spark, text, text, b"none"), scan.Config(rules, builtin=False), secrets=True).collect()
    assert sorted((r.path, r.rule_id, r.secret) for r in got) == [("p0", "fixture", SECRET), ("p0", "py", "abcd"), ("p1", "fixture", SECRET)]
