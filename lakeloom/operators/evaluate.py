"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, recall, ndcg, rr) of the first k of ranked(query_id, chunk_id, rank) against relevant(query_id, chunk_id).

    Queries without ranked rows score 0; queries without relevant rows are left out.
    """
    good = relevant.select("query_id", "chunk_id").distinct()
    found = ranked.join(good, ["query_id", "chunk_id"], "left_semi")
    return metrics_of_found(found, good.groupBy("query_id").agg(F.count("*").alias("n")), k)


def metrics_of_found(found: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """retrieval_metrics by the ranked rows that are relevant, found(query_id, chunk_id, rank), and size(query_id, n), how many are: relevance may be by a class, so no pairs are made."""
    by = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = size.join(by, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", F.coalesce(F.col("found") > 0, F.lit(False)).alias("hit"), zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("rr"))


def context_precision(rows: DataFrame, k: int) -> DataFrame:
    """Average precision at k of rows(query_id, rank, relevant); 0 where nothing is relevant."""
    own = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("relevant").cast("int")
    part = rows.where(F.col("rank") <= k).withColumn("p", F.sum(good).over(own) / F.col("rank") * good)
    return part.groupBy("query_id").agg(F.round(F.coalesce(F.try_divide(F.sum("p"), F.sum(good)), F.lit(0.0)), 6).alias("average_precision"))


def faithfulness(claims: DataFrame) -> DataFrame:
    """Share of an answer's claims that are supported; 1 for an answer without claims (a null verdict row)."""
    judged = F.count("supported")
    return claims.groupBy("answer_id").agg(F.round(F.coalesce(F.try_divide(F.count_if("supported"), judged), F.lit(1.0)), 6).alias("faithfulness"))


def run_delta(before: DataFrame, after: DataFrame, bucket: str, value: str) -> DataFrame:
    """Means by bucket of two runs and their difference."""
    a = before.groupBy(bucket).agg(F.avg(value).alias("a"), F.count("*").alias("n_before"))
    b = after.groupBy(bucket).agg(F.avg(value).alias("b"), F.count("*").alias("n_after"))
    return a.join(b, bucket, "full").select(bucket, "n_before", "n_after", F.round("a", 6).alias("before"), F.round("b", 6).alias("after"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def refusal_ratio(marks: DataFrame) -> DataFrame:
    """Share of a query's critiques that refuse."""
    return marks.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("mark") == "refuse") / F.count("*"), 6).alias("refusal_ratio"))
