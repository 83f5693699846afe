"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, fim, language, negatives, packing, quality, records, simhash, substrings, suffixes, warc

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(spark, _table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(spark, _table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), vocabulary())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spark, _table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.export(spark, _table(spark, sf_dir, "documents"), vocabulary())


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(spark, _table(spark, sf_dir, "documents"), vocabulary())


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(spark, _table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_NAMED = (
    op1_debruijn, op2_suffix_array, op3_bpe, op4_decontaminate, op5_warc, op6_simhash, op7_quality,
    op8_language, op9_chat, op10_token_records, op11_fim, op12_packing, op13_negatives, pipeline,
)
QUERIES = {f.__name__: f for f in _NAMED}
ORACLES: dict[str, str] = {
    "op1_debruijn": substrings.SQL,
    "op2_suffix_array": suffixes.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
    "op9_chat": chat.SQL,
    "op11_fim": fim.SQL,
    "op13_negatives": negatives.SQL,
}
