"""Filters that every query over shared tables carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str | None, workspace: str | None = None, bot: int | None = None) -> DataFrame:
    """Rows of one tenant, and of a workspace or bot if given; a missing tenant is an error, never "all"."""
    if tenant is None:
        raise ValueError("a tenant is required")
    df = df.where(F.col("tenant") == tenant)
    df = df.where(F.col("workspace") == workspace) if workspace is not None else df
    return df.where(F.col("bot") == bot) if bot is not None else df


def between(df: DataFrame, since: str, until: str, at: str = "started_at") -> DataFrame:
    """Rows from since to until, both included."""
    return df.where((F.col(at) >= F.lit(since).cast("timestamp")) & (F.col(at) <= F.lit(until).cast("timestamp")))


def half_open(df: DataFrame, since: str, until: str, at: str = "started_at") -> DataFrame:
    return df.where((F.col(at) >= F.lit(since).cast("timestamp")) & (F.col(at) < F.lit(until).cast("timestamp")))


def recent(df: DataFrame, as_of: str, days: int, at: str = "started_at") -> DataFrame:
    """Rows later than so many days before a given moment."""
    return df.where(F.col(at) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted, by their own flag."""
    return df.where(F.col("deleted_at").isNull())


def of_live_documents(rows: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose document is there and not softly deleted."""
    return rows.join(live(documents).select(key), key, "left_semi")


def metadata_contains(df: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose map column holds every wanted entry."""
    for k, v in wanted.items():
        df = df.where(F.try_element_at(F.col(column), F.lit(k)) == v)
    return df


def with_fallback(primary: DataFrame, fallback: DataFrame, *keys: str) -> DataFrame:
    """Rows of primary, and those of fallback for keys that primary has no rows for; without keys, fallback only if primary is empty."""
    if keys:
        return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"))
    some = primary.limit(1).agg(F.count("*").alias("some"))
    return primary.unionByName(fallback.crossJoin(F.broadcast(some)).where("some = 0").drop("some"))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a URL's host is one of the hosts; *.name allows the hosts below name."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    out = F.lit(False)
    for h in hosts:
        out = out | (host.endswith(h[1:].lower()) if h.startswith("*.") else host == h.lower())
    return F.coalesce(out, F.lit(False))
