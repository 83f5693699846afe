"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, extra ones too, whatever their names; n_chars follows the text where a stage changes it.

Every row is a document, with a null or repeated doc_id too. Null and empty texts have no words and fail the quality rules. Of repeated rows and
other near-duplicates one row stays, that with the least doc_id (null first). Very long texts are worked on whole. An empty table passes through
all stages as an empty one; the last stage returns doc_id, lang, source, ids, n_tokens and whether decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, decontaminate, jaccard, quality, substrings
from sieveline.llm.store import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word Jaccard similarity of 0.8 or more) the document with the least doc_id stays."""
    return jaccard.keep(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go, in all copies; a text without any keeps its own form. Every document stays."""
    return substrings.rewrite(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase of the benchmark go."""
    return decontaminate.keep(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as ids, with the number of ids and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    text = F.coalesce("text", F.lit(""))
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", text.alias("text"), F.sha2(text, 256).alias("was")), path, chars=bpe.FEW_CHARS)
    decodes = F.sha2("decoded", 256) == F.col("was")
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), decodes.alias("decodes"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_round_trip),
]

#: SQL has neither the log-likelihood buckets' hash nor the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
