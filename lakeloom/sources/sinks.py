"""Sinks: whole partitions are replaced, so a retried write gives the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write df so that each value of keys in it replaces what path had for that value; other values stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
