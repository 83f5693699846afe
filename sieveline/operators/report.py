"""Reports: summaries, JSON lines, SARIF, previews, exit codes."""

from __future__ import annotations

import hashlib
import json
import signal
import threading
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fn

FINDING_ORDER = ("path", "start", "end", "rule_id", "fingerprint")
PREVIEW_ROWS, PREVIEW_BYTES = 100, 512 << 10
TOOL = "sieveline"
STATS = ("files", "bytes", "skipped", "detection_passes")
CANCELLED = "scan cancelled; remaining inputs were not fully scanned"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*FINDING_ORDER)


def stats(inputs: DataFrame, max_bytes: int) -> DataFrame:
    """files, bytes, skipped and detection_passes of a table of inputs (length), as one row."""
    over = F.col("length") > max_bytes
    return inputs.agg(
        F.count(F.when(~over, 1)).alias("files"), F.coalesce(F.sum(F.when(~over, F.col("length"))), F.lit(0)).cast("long").alias("bytes"), F.count(F.when(over, 1)).alias("skipped"), F.count(F.when(~over, 1)).alias("detection_passes"),
    )


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows of inputs (length, error), and an observation of the stats that the first job over them counts in passing: no pass of its own."""
    counted, good = Observation(), F.col("error").isNull()
    skipped = F.count(F.when(F.col("error").rlike("exceed(s|ed)"), 1))
    out = rows.observe(
        counted, F.count(F.when(good, 1)).alias("files"), F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).cast("long").alias("bytes"),
        skipped.alias("skipped"), F.count(F.when(good, 1)).alias("detection_passes"),
    )
    return out, counted


def told(spark: SparkSession, counted: Observation) -> DataFrame:
    """The observed stats as one row; waits for the job that counts them."""
    return spark.createDataFrame([tuple(counted.get[k] for k in STATS)], ", ".join(f"{k} long" for k in STATS))


def summary(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: finding_count, error_count, complete, exit_code."""
    both = findings.agg(F.count("*").alias("finding_count")).crossJoin(errors.agg(F.count("*").alias("error_count")))  # one row each
    complete = F.col("error_count") == 0
    return both.select("finding_count", "error_count", complete.alias("complete"), exit_code(complete, F.col("error_count"), F.col("finding_count")).alias("exit_code"))


def exit_code(complete: Column, errors: Column, findings: Column) -> Column:
    """2 if the scan is incomplete, else 1 if it found something, else 0."""
    return F.when(~complete | (errors > 0), 2).when(findings > 0, 1).otherwise(0)


def finding_json(findings: DataFrame) -> Column:
    """A finding as JSON; absent matched_rule_ids are left out."""
    return F.to_json(F.struct(*(F.col(c) for c in findings.columns)))


def _record(kind: str, *fields) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *fields)).alias("value")


def _found(findings: DataFrame) -> Column:
    return _record("finding", F.struct(*findings.columns).alias("finding"))


def _wrong() -> Column:
    return _record("error", F.struct("path", "message").alias("error"))


def closed(closing: DataFrame, counted: DataFrame, context: dict | None = None) -> DataFrame:
    """A summary (one row) with the stats (one row) of what was scanned and the scan's context."""
    own = counted.select(F.struct(*counted.columns).alias("stats"))
    told = closing.crossJoin(own)  # one row each
    return told if context is None else told.withColumn("context", F.struct(*(F.array(*map(F.lit, v)).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in context.items())))


def json_lines(findings: DataFrame, errors: DataFrame, closing: DataFrame) -> DataFrame:
    """Lines in order: findings, errors, the summary. One column ``value``, for write.text."""
    none = F.lit(0).cast("bigint").alias("at")
    rows = [
        findings.select(F.lit(0).alias("part"), *FINDING_ORDER[:1], F.col("start").alias("at"), _found(findings)),
        errors.select(F.lit(1).alias("part"), "path", none, _wrong()),
        closing.select(F.lit(2).alias("part"), F.lit("").alias("path"), none, _record("summary", F.lit(1).alias("schema_version"), *closing.columns)),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).orderBy("part", "path", "at", "value").select("value")


def events(findings: DataFrame, errors: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Records as they come, in no order: findings, errors and, with the stats of what was scanned so far, one of progress. One column ``value``."""
    out = findings.select(_found(findings)).unionByName(errors.select(_wrong()))
    return out if counted is None else out.unionByName(counted.select(_record("progress", F.struct(*counted.columns).alias("stats"))))


class Control:
    """Cancels a scan: the jobs of its group now, and those that it would still begin."""

    def __init__(self, spark: SparkSession, group: str):
        self.spark, self.group, self.cancelled = spark, group, False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)


def _was_cancelled(error: Exception) -> bool:
    """Whether Spark itself says that a job was cancelled; what messages hold otherwise, such as paths, does not count."""
    java = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while java is not None:
        if java.getClass().getName() == "org.apache.spark.SparkException" and "SPARK_JOB_CANCELLED" in str(java.getCondition()):
            return True
        java = java.getCause()
    return False


def written(findings: DataFrame, errors: DataFrame, place: str, group: str) -> DataFrame:
    """Write findings as Parquet under a job group's name; the errors, with one row more if the group is cancelled meanwhile.

    Spark commits a table as a whole, so a cancelled scan leaves no findings behind, and its summary is incomplete. Other failures are raised.
    For a scan that keeps what it has found, see ``written_units``.
    """
    done, _ = written_units([findings], place, Control(findings.sparkSession, group))
    return errors if done else errors.unionByName(errors.sparkSession.createDataFrame([("scan", CANCELLED)], "path string, message string"))


@contextmanager
def interrupts(control: Control):
    """While this is open, an interrupt (Ctrl-C) or a request to end cancels the scan, so that it reports what is committed."""

    def cancel(number, frame):
        # From a thread of its own: this one may be in the middle of a call to the JVM.
        control.cancelled = True
        threading.Thread(target=control.cancel, daemon=True).start()

    known = {s: signal.signal(s, cancel) for s in (signal.SIGINT, signal.SIGTERM)} if threading.current_thread() is threading.main_thread() else {}
    try:
        yield control
    finally:
        for number, handler in known.items():
            signal.signal(number, handler)


def committed(units: list[tuple[str, DataFrame, Observation]], place: str, control: Control, context: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, errors, stats) of units, as far as they are committed: each its name, ``findings`` rows with a column ``error``, and the observation of its inputs.

    Units are kept under the scan's context and their names, which have to tell what they cover, so a scan that was cancelled goes on behind those of
    the same rules, roots, policy and folders; what has changed in these folders since is not seen then. One that is whole is never used again. A unit counts
    once its stats are committed, which say where it is.
    """
    spark = control.spark
    place, attempt = f"{place.rstrip('/')}/{hashlib.sha256(json.dumps(context, sort_keys=True).encode()).hexdigest()[:16]}", 0
    while _is_there(spark, f"{place}/{attempt}/whole"):
        attempt += 1
    place, kept, whole = f"{place}/{attempt}", [], True
    for name, unit, counted in units:
        own = f"{place}/{name}/stats"
        if not _is_there(spark, own):
            at, whole = written_units([unit], f"{place}/{name}/{uuid.uuid4().hex[:8]}", control)
            if not whole:
                break
            told(spark, counted).withColumn("at", F.lit(at[0])).write.mode("overwrite").parquet(own)
        kept.append(own)
    if whole:
        spark.range(1).write.parquet(f"{place}/whole")
    schema = ", ".join([*(f"{k} long" for k in STATS), "at string"])
    counts = spark.read.schema(schema).parquet(*kept) if kept else spark.createDataFrame([], schema)
    found, errors = partial(spark, [r["at"] for r in counts.select("at").collect()], whole, units[0][1].schema)  # one row for each unit
    return found, errors, counts.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in STATS))


def _is_there(spark: SparkSession, folder: str) -> bool:
    """Whether a table is committed in a folder."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def written_units(units: Iterable[DataFrame], place: str, control: Control) -> tuple[list[str], bool]:
    """Write each of several tables under ``place``, one after the other: (what is committed, whether that is all).

    A cancelled scan keeps the units committed so far and nothing of the one it was in. Other failures are raised. Running it again with the
    same units goes on behind those that are there.
    """
    done, context = [], control.spark.sparkContext
    context.setJobGroup(control.group, "scan", interruptOnCancel=True)
    try:
        for i, unit in enumerate(units):
            path = f"{place.rstrip('/')}/unit={i:05d}"
            if control.cancelled:
                return done, False
            if not _is_there(control.spark, path):
                try:
                    unit.write.mode("overwrite").parquet(path)
                except Exception as e:
                    if not _was_cancelled(e):
                        raise
                    return done, False
            done.append(path)
        return done, True
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def partial(spark: SparkSession, done: list[str], whole: bool, schema) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of committed units of ``findings`` rows with a column ``error``; an error says so where they are not all."""
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    errors = rows.where("error is not null").select("path", F.col("error").alias("message"))
    if not whole:
        errors = errors.unionByName(spark.createDataFrame([("scan", CANCELLED)], "path string, message string"))
    return rows.where("error is null").drop("error"), errors


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules with the explanation of their first finding."""
    return findings.groupBy("rule_id").agg(F.min_by("explanation", F.struct(*FINDING_ORDER)).alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF result objects (path, start, result), one per finding."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.lit("warning").alias("level"),
        F.struct(F.concat("explanation", F.lit(" ("), "redacted", F.lit(")")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(fn.path_uri(F.col("path")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("secretFingerprint/v1")).alias("partialFingerprints"),
        F.struct("start", "end", "column", "coordinate_space", "confidence", F.coalesce("matched_rule_ids", F.array().cast("array<string>")).alias("matched_rule_ids"), "is_base64_encoded").alias("properties"),
    )
    return findings.select("path", "start", "rule_id", F.to_json(result).alias("result"))


def sarif(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """A whole SARIF 2.1.0 document as one value. It is one JSON object, so it is gathered in one place: use it for reports, not for tables."""
    results = sarif_results(findings).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "start", "rule_id", "result"))), lambda x: x["result"]).alias("results"))
    rules = sarif_rules(findings).agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct("text").alias("shortDescription")))).alias("rules"))
    notes = errors.agg(F.array_sort(F.collect_list(F.struct(F.lit("error").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct("path").alias("properties")))).alias("notes"))
    one = results.crossJoin(rules).crossJoin(notes)  # one row each
    driver = F.to_json(F.struct(F.lit(TOOL).alias("name"), "rules"))
    complete = F.size("notes") == 0
    return one.select(
        F.concat(
            F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), driver, F.lit('},"results":['), F.array_join("results", ","), F.lit('],"invocations":[{"executionSuccessful":'),
            complete.cast("string"), F.lit(',"toolExecutionNotifications":'), F.to_json("notes"), F.lit('}],"properties":{"complete":'), complete.cast("string"), F.lit("}}]}"),
        ).alias("sarif")
    )


def preview(findings: DataFrame, rows: int = PREVIEW_ROWS, budget: int = PREVIEW_BYTES) -> DataFrame:
    """The first findings in report order, up to ``rows`` of them and ``budget`` bytes of JSON: (place, finding).

    A finding that does not fit is passed over, and smaller ones behind it may still fit. What does not fit now will not fit later, so each
    look takes the next findings that fit into what is left, ``rows`` of them, and takes one at least; most previews need one look.
    """
    order = F.struct(*FINDING_ORDER)
    each = findings.select(order.alias("place"), finding_json(findings).alias("finding")).withColumn("size", F.octet_length("finding"))
    out, used, last = [], 0, None
    while len(out) < rows:
        left = each.where(F.col("size") <= budget - used)
        if last is not None:
            behind = (F.lit(v).cast(findings.schema[c].dataType).alias(c) for c, v in zip(FINDING_ORDER, last, strict=True))
            left = left.where(F.col("place") > F.struct(*behind))
        block = left.orderBy("place").limit(rows).collect()  # at most ``rows``, each within the budget
        for r in block:
            if len(out) < rows and used + r["size"] <= budget:
                out.append(r["finding"])
                used += r["size"]
        if len(block) < rows:
            break
        last = tuple(block[-1]["place"])
    return findings.sparkSession.createDataFrame(list(enumerate(out)), "place int, finding string")


def preview_report(findings: DataFrame, errors: DataFrame, rows: int = PREVIEW_ROWS, budget: int = PREVIEW_BYTES) -> DataFrame:
    """A bounded report as one row: the first findings and errors that fit, the numbers of all, and whether something was left out.

    Findings come first; errors share what they leave of ``rows`` and of ``budget`` bytes.
    """
    shown = [r["finding"] for r in preview(findings, rows, budget).collect()]
    left = budget - sum(len(x.encode()) for x in shown)
    text = F.to_json(F.struct("path", "message"))
    near = errors.select(text.alias("error")).where(F.octet_length("error") <= left).orderBy("error").limit(max(0, rows - len(shown))).collect()
    told = []
    for r in near:
        if len(r["error"].encode()) <= left:
            told.append(r["error"])
            left -= len(r["error"].encode())
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = summary(findings, errors).withColumns({"findings": strings(shown), "errors": strings(told)})
    return out.withColumn("output_truncated", (F.col("finding_count") > len(shown)) | (F.col("error_count") > len(told)))


def document(findings: DataFrame, errors: DataFrame, closing: DataFrame) -> DataFrame:
    """A whole JSON report as one value: findings in report order, errors, and the fields of the summary. For reports, not for tables."""
    key = F.struct(*FINDING_ORDER)
    all_ = findings.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), finding_json(findings).alias("json")))), lambda x: x["json"]).alias("findings"))
    notes = errors.agg(F.array_sort(F.collect_list(F.struct("path", "message"))).alias("errors"))
    one = all_.crossJoin(notes).crossJoin(closing)  # one row each
    fields = F.to_json(F.struct(F.lit(1).alias("schema_version"), *closing.columns))
    value = F.concat(F.regexp_replace(fields, r"\}\z", ""), F.lit(',"findings":['), F.array_join("findings", ","), F.lit('],"errors":'), F.to_json("errors"), F.lit("}"))
    return one.select(value.alias("report"))


def throttle_counts(times: DataFrame, gap: int = 100) -> DataFrame:
    """times (key, ms): how many of a key's times in order are at least ``gap`` after the last one kept: (key, kept).

    Times of a key are read in order as a stream, so a key may have any number of them.
    """
    import pandas as pd

    def run(frames):
        key, last, kept = None, None, 0
        for pdf in frames:
            out = []
            for k, t in zip(pdf["key"].tolist(), pdf["ms"].tolist(), strict=True):
                if k != key or last is None:
                    if last is not None:
                        out.append((key, kept))
                    key, last, kept = k, t, 1
                elif t - last >= gap:
                    last, kept = t, kept + 1
            if out:
                yield pd.DataFrame(out, columns=["key", "kept"])
        if last is not None:
            yield pd.DataFrame([(key, kept)], columns=["key", "kept"])

    ordered_ = times.select("key", "ms").distinct().repartition("key").sortWithinPartitions("key", "ms")
    return ordered_.mapInPandas(run, "key long, kept long")


def throttle(times: Column, gap: int = 100) -> Column:
    """Of progress times in order, those at least ``gap`` after the last one kept; the first is kept."""
    zero = F.array().cast("array<bigint>")
    return F.aggregate(times, zero, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.get(acc, F.size(acc) - 1) >= gap), F.concat(acc, F.array(t.cast("bigint")))).otherwise(acc))
