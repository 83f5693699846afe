"""Baselines: what was found before, by fingerprint, and how a new scan differs.

A baseline is a table (fingerprint, finding, disposition) with one row per fingerprint. It belongs to a scan context; comparing across
contexts is refused, and an incomplete scan neither makes a baseline nor resolves anything.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("path", "start", "end", "rule_id")


class ContextError(ValueError):
    """The scan cannot be compared or kept as a baseline."""


def _same_context(old: dict | None, new: dict | None) -> None:
    if new is None:
        raise ContextError("a baseline needs a scan context")
    if old is not None and old != new:
        raise ContextError("baseline scan context mismatch")


def representatives(findings: DataFrame) -> DataFrame:
    """The first finding of each fingerprint in report order."""
    nth = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*ORDER))
    return findings.withColumn("nth", nth).where("nth = 1").drop("nth")


def from_findings(findings: DataFrame, previous: DataFrame | None = None, *, complete: bool = True, context: dict | None = None, previous_context: dict | None = None) -> DataFrame:
    """A new baseline; dispositions of the previous one are carried forward."""
    if not complete:
        raise ContextError("cannot create a baseline from an incomplete scan")
    _same_context(previous_context, context)
    rows = representatives(findings)
    entries = rows.select("fingerprint", F.struct(*rows.columns).alias("finding"))
    if previous is None:
        return entries.withColumn("disposition", F.lit(None).cast("string"))
    return entries.join(previous.select("fingerprint", "disposition"), "fingerprint", "left")


def new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every occurrence whose fingerprint the baseline lacks."""
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti").select(*findings.columns)


def resolved(findings: DataFrame, baseline: DataFrame, complete: bool = True) -> DataFrame:
    """Baseline entries that the scan no longer finds; none if the scan is incomplete, since it cannot show absence."""
    gone = baseline.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*baseline.columns)
    return gone if complete else gone.limit(0)


def diff(findings: DataFrame, baseline: DataFrame, *, complete: bool = True, context: dict | None = None, baseline_context: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(new findings, resolved entries)."""
    _same_context(baseline_context, context)
    return new(findings, baseline), resolved(findings, baseline, complete)


VERSION = 2


def write(entries: DataFrame, path: str, context: dict) -> None:
    """Keep a baseline as a table. It is written whole beside the old one, which may be read meanwhile, and then takes its place."""
    spark = entries.sparkSession
    kept = F.lit(json.dumps(context, sort_keys=True))
    beside = f"{path.rstrip('/')}.next-{uuid.uuid4().hex[:8]}"
    entries.select(F.lit(VERSION).alias("schema_version"), kept.alias("context"), "fingerprint", "finding", "disposition").write.parquet(beside)
    old, new_ = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(old, True)
    if not store.rename(new_, old):
        raise OSError(f"the new baseline stays at {beside}: it could not take the old one's place")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    """A kept baseline and its context (null if it has no entries); damaged ones are refused, never taken as empty."""
    table = spark.read.parquet(path)
    wrong = table.where((F.col("schema_version") != VERSION) | F.col("fingerprint").isNull() | (F.col("fingerprint") == "") | ~F.col("fingerprint").eqNullSafe(F.col("finding.fingerprint")))
    if wrong.limit(1).count():
        raise ContextError("the baseline has another schema version or an inconsistent fingerprint")
    contexts = [r[0] for r in table.select("context").distinct().limit(2).collect()]
    if len(contexts) > 1:
        raise ContextError("the baseline mixes scan contexts")
    return table.select("fingerprint", "finding", "disposition"), json.loads(contexts[0]) if contexts else None
