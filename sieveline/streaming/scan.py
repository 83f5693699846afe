"""Scanning streams: the batch plan over micro-batches, findings handed to a sink as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators import report, scan
from sieveline.sources import encodings


def requests(lines: DataFrame, max_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """JSON request lines (value) as (inputs id, path, identity, content; errors id, message). The path is ``stdin`` if none is given."""
    parsed = lines.withColumn("r", F.from_json("value", "id string, path string, text string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    big = F.octet_length("value") > max_bytes
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.text").isNotNull() & ~big
    path = F.coalesce("r.path", F.lit("stdin"))
    inputs = parsed.where(ok).select(F.col("r.id").alias("id"), path.alias("path"), path.alias("identity"), F.encode("r.text", "UTF-8").alias("content"))
    message = F.when(big, f"request exceeds {max_bytes} byte limit").otherwise("invalid request")
    return inputs, parsed.where(~F.coalesce(ok, F.lit(False))).select(F.col("r.id").alias("id"), message.alias("message"))


def stream_findings(source: DataFrame, config: scan.Config | None = None) -> DataFrame:
    """Findings of a streaming table of inputs (path, identity, content); stateless, append mode. Malformed UTF-16 is left to stream_errors."""
    return scan.findings(encodings.decode_utf16(source)[0], config)


def stream_errors(source: DataFrame) -> DataFrame:
    """Errors (path, message) of a streaming table of inputs: malformed UTF-16."""
    return encodings.decode_utf16(source)[1]


def start(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: scan.Config | None = None, errors: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Run a stream into ``sink(findings, batch_id)``, and error rows into ``errors``. An exception of a sink stops the query and is raised by awaitTermination.

    Without ``errors`` an input that cannot be scanned stops the query before its batch's findings are handed on.
    """

    def batch(inputs: DataFrame, number: int) -> None:
        wrong = stream_errors(inputs)
        if errors is not None:
            errors(wrong, number)
        elif (first := wrong.limit(1).collect()):
            raise ValueError(f"{first[0].message}: {first[0].path}")
        sink(stream_findings(inputs, config), number)

    return _run(source, batch, checkpoint, trigger)


def start_events(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: scan.Config | None = None, **trigger) -> StreamingQuery:
    """Run a stream into ``sink(records, batch_id)``: JSON records of a batch's findings and errors, and one of progress with the batch's stats.

    Inputs over the size limit are errors. A batch that is run again after a failure gives the same records under the same number.
    """
    limit = (config or scan.Config()).max_bytes

    def batch(inputs: DataFrame, number: int) -> None:
        inputs = inputs.persist()
        kept, over = scan.size_gate(inputs, limit)
        counted = report.stats(inputs.select(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length")), limit)
        sink(report.events(stream_findings(kept, config), over.unionByName(stream_errors(kept)), counted), number)
        inputs.unpersist()

    return _run(source, batch, checkpoint, trigger)


def _run(source: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    options = trigger or {"availableNow": True}
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**options).start()
