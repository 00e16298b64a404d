"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, chat, contamination, embeddings, fingerprints, html, jaccard, lines, quality, resampling, search, toxicity, warc
from lakeloom.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_bpe, op3_line_dedup, op4_decontamination, op5_jaccard_join, op6_warc, op7_quality, op8_chat, op9_toxicity, op10_embedding_dedup,
        op11_fingerprints, op12_importance_resampling, op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE_SQL, "op4_decontamination": contamination.ORACLE_SQL, "op8_chat": chat.ORACLE_SQL,
    "op11_fingerprints": fingerprints.ORACLE_SQL, "op12_importance_resampling": resampling.ORACLE_SQL, "op13_lexical_search": search.ORACLE_SQL,
}
