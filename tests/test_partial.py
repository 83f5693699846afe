"""Scans that are cancelled, bounded reports, scores of very many spans."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import quality, report, scan
from sieveline.plans import rules as R
from sieveline.sources import files

SECRET = "aB3dE5gH7jK9mN1pQ2rS4tU6"
CONFIG = scan.Config((R.Rule("fixture", "Fixture", "fixture_([A-Za-z0-9]{24})", 1, ("fixture_",)),), builtin=False)


def _tree(spark, place):
    for d in ("a", "b", "c"):
        (place / d).mkdir()
        (place / d / "f.txt").write_text(f"fixture_{SECRET}\n")
    parts = files.units(files.survey([str(place)]), folders=2)
    return [scan.findings(files.rows(spark, p).drop("length"), CONFIG) for p in parts]


def test_a_cancelled_scan_keeps_what_is_committed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    units = _tree(spark, tmp_path / "in")
    assert len(units) == 2
    place, control = str(tmp_path / "out"), report.Control(spark, "units")

    def slow(frames):
        for pdf in frames:
            time.sleep(60)
            yield pdf

    stuck = units[1].mapInPandas(slow, units[1].schema)
    timer = threading.Timer(12, control.cancel)
    timer.start()
    done, whole = report.written_units([units[0], stuck, units[1]], place, control)
    assert len(done) == 1 and not whole
    found, errors = report.partial(spark, done, whole, units[0].schema)
    closing = report.summary(found, errors).first()
    assert [r.path for r in found.collect()] == ["a/f.txt"] and (closing.complete, closing.exit_code, closing.finding_count) == (False, 2, 1)
    again = report.Control(spark, "again")
    done, whole = report.written_units(units, place, again)  # goes on behind what is there
    found, errors = report.partial(spark, done, whole, units[0].schema)
    assert whole and sorted(r.path for r in found.collect()) == ["a/f.txt", "b/f.txt", "c/f.txt"] and errors.count() == 0


def test_cancelled_before_it_begins(spark, tmp_path):
    control = report.Control(spark, "early")
    control.cancel()
    done, whole = report.written_units([spark.range(1)], str(tmp_path / "out"), control)
    found, errors = report.partial(spark, done, whole, "path string, error string")
    assert (done, whole, found.count(), errors.first().message) == ([], False, 0, report.CANCELLED)


def test_a_failure_whose_text_says_cancelled_is_no_cancellation(spark, tmp_path):
    broken = spark.range(1).select(F.raise_error(F.lit("cancelled SPARK_JOB_CANCELLED")).cast("string").alias("x"))
    with pytest.raises(Exception, match="cancelled"):
        report.written_units([broken], str(tmp_path / "x"), report.Control(spark, "g"))


def test_bounded_reports_tell_what_they_leave_out(spark):
    rows = [("r", None, f"p{i}", i, i + 1, 1, 1, "r", "f", "e", "low", False, "s") for i in range(8)]
    found = spark.createDataFrame(rows, scan.FINDING)
    errors = spark.createDataFrame([(f"e{i}", "broken" + "x" * 400 * i) for i in range(3)], "path string, message string")
    all_ = report.preview_report(found, errors).first()
    assert (len(all_.findings), len(all_.errors), all_.output_truncated, all_.complete, all_.exit_code) == (8, 3, False, False, 2)
    few = report.preview_report(found, errors, rows=5).first()
    assert (len(few.findings), few.errors, few.output_truncated, few.finding_count, few.error_count) == (5, [], True, 8, 3)
    size = len(all_.findings[0].encode())
    tight = report.preview_report(found, errors, budget=8 * size + 60).first()
    assert len(tight.findings) == 8 and [json.loads(x)["path"] for x in tight.errors] == ["e0"] and tight.output_truncated
    none = report.preview_report(found.limit(0), errors.limit(0)).first()
    assert (none.findings, none.errors, none.output_truncated, none.exit_code) == ([], [], False, 0)


def _brute(found, labels):
    """finding id -> (exact, near, touches) of all pairs of a path."""
    out = {}
    for i, p, s, e in found:
        exact = [x[0] for x in labels if x[1] == p and (x[2], x[3]) == (s, e)]
        near = [x[0] for x in labels if x[1] == p and min(e, x[3]) - max(s, x[2]) >= (x[3] - x[2]) * 0.5 and e - s <= max(1, x[3] - x[2]) * 4]
        touches = any(x[1] == p and min(e, x[3]) > max(s, x[2]) for x in labels)
        met = exact or sorted(near)
        out[i] = "unlocalized" if len(met) > 1 or (not met and touches) else met[0] if met else None
    return out


def test_meetings_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(6)
    span = lambda: (s := r.randrange(300), s + r.choice((1, 5, 10, 40, 120)))
    labels = [(i, f"p{r.randrange(2)}", *span(), r.choice(("positive", "negative"))) for i in range(60)]
    found = [(i, f"p{r.randrange(3)}", *(labels[r.randrange(60)][2:4] if i % 3 == 0 else span())) for i in range(150)]
    monkeypatch.setattr(quality, "meetings", lambda f, g, own=quality.meetings: own(f, g, 16))
    f = spark.createDataFrame(found, "finding_id int, path string, start long, end long")
    g = spark.createDataFrame(labels, "label_id int, path string, start long, end long, label string")
    got = {x.finding_id: "unlocalized" if x["class"] == "unlocalized" else x.label_id for x in quality.classify(f, g).collect()}
    assert got == _brute(found, labels) and len(set(map(str, got.values()))) > 10


def test_very_many_findings_and_labels_in_one_path(spark):
    n = 100_000
    spans = spark.range(n).select(F.col("id").alias("label_id"), F.lit("p").alias("path"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 20).alias("end"), F.when(F.col("id") % 4 == 0, "negative").otherwise("positive").alias("label"))
    found = spans.select(F.col("label_id").alias("finding_id"), "path", F.col("start") + F.when(F.col("label_id") % 2 == 0, 3).otherwise(0), F.col("end")).toDF("finding_id", "path", "start", "end")
    began = time.time()
    one = quality.confusion(found, spans).first()
    assert (one.tp, one.fp, one.unlocalized, one.fn) == (n * 3 // 4, n // 4, 0, 0) and time.time() - began < 120
