"""Shared scratch storage: tables and files that every executor can see.

The place is the folder named by ``spark.checkpoint.dir``. Only where a session names none (a local test)
is a temporary folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder of this session."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/") if "://" in named or named.startswith("file:") else "file://" + named.rstrip("/")


def staying(docs: DataFrame, names: tuple[str, ...], instead: tuple[str, ...] = ()) -> list[str]:
    """The columns of docs that stay; ValueError if one of them has a name that is to be added."""
    kept = [c for c in docs.columns if c not in instead]
    if clash := sorted({c.lower() for c in kept} & {n.lower() for n in names}):
        raise ValueError(f"the input has columns named {', '.join(clash)} already; rename them")
    return kept


def held(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(doc_id, text as string, ``held`` with all other columns under names of their own), and the columns that turn it into docs again."""
    names = {c: f"held.c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    other = F.struct(*(F.col(f"`{c}`").alias(n.removeprefix("held.")) for c, n in names.items()))
    back = [F.col(names.get(c, "text")).alias(c) for c in docs.columns]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), other.alias("held")), back


class Scratch:
    """A folder of its own for one run of an operator; written tables cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df as Parquet here and read it back, so that later steps start from files."""
        self._n += 1
        path = self.path(f"{self._n:03d}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()  # shuffle files of plans that are done with are deleted then
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark free the shuffle files behind them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()
