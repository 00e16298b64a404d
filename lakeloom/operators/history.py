"""Joins over logs in time: histories, as-of matches, stuck work, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_history(sources: list[DataFrame], key: str, limit: int) -> DataFrame:
    """(key, role, content, created_at, place): the last turns of all sources by time, each once where it repeats the one before.

    Turns without content are dropped and turns without a time come first; ties keep the order of the sources and their seq.
    """
    parts = [s.select(key, "role", "content", "created_at", "seq", F.lit(i).alias("src")) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("content IS NOT NULL AND content <> ''")
    order = [F.asc_nulls_first("created_at"), "src", "seq"]
    own = Window.partitionBy(key).orderBy(*order)
    same = F.col("role").eqNullSafe(F.lag("role").over(own)) & F.col("content").eqNullSafe(F.lag("content").over(own)) & (F.row_number().over(own) > 1)
    kept = rows.withColumn("_same", same).where("NOT _same")
    back = Window.partitionBy(key).orderBy(F.desc_nulls_last("created_at"), F.desc("src"), F.desc("seq"))
    kept = kept.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= max(limit, 0))
    return kept.withColumn("place", F.row_number().over(own)).select(key, "role", "content", "created_at", "place")


def asof_latest(events: DataFrame, states: DataFrame, key: str, event_at: str, state_at: str, value: str) -> DataFrame:
    """events with the last value of states at or before their time, by one sort of both instead of a join of all pairs.

    At equal times states count as earlier; of equal states the greatest value is the last.
    """
    e = events.withColumn("_at", F.col(event_at)).withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(states.schema[value].dataType))
    s = states.select(key, F.col(state_at).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    own = Window.partitionBy(key).orderBy("_at", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(own)).where("_kind = 1").drop("_at", "_kind", "_v")


def stuck(documents: DataFrame, outbox: DataFrame, as_of: str, older_s: int, cooldown_s: int) -> DataFrame:
    """Documents in a draft state for too long without a pending event and without one in the cooldown; the event's payload is JSON with document_id."""
    now = F.lit(as_of).cast("timestamp")
    sent = outbox.withColumn("doc_id", F.get_json_object("payload", "$.document_id").cast("long"))
    busy = sent.where((F.col("status") == "pending") | (F.col("created_at") > now - F.make_dt_interval(secs=F.lit(cooldown_s)))).select("doc_id")
    late = documents.where((F.col("state") == "DRAFT") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(older_s))))
    return late.join(busy, "doc_id", "left_anti")


def latest_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with their newest feedback."""
    newest = feedback.groupBy("request_id").agg(F.max_by("score", F.struct("created_at", "score")).alias("feedback_score"))
    return logs.join(newest, "request_id", "left")


def running_quota(rows: DataFrame, limit: int, *keys: str, at: str = "started_at", tie: str = "request_id") -> DataFrame:
    """Each row's number within its key and UTC day, and whether it is within the limit."""
    own = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, tie)
    n = F.row_number().over(own)
    return rows.withColumn("n_today", n).withColumn("allowed", n <= limit)


def fixed_window(rows: DataFrame, seconds: int, limit: int, *keys: str, at: str = "started_at") -> DataFrame:
    """Calls per key and bucket of so many seconds since the epoch, and how many were over the limit."""
    bucket = F.floor(F.unix_timestamp(at) / seconds).cast("long")
    by = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return by.withColumn("denied", F.greatest(F.col("n") - limit, F.lit(0)))


def resolve_layers(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, layer): each key's value from the first layer that has one."""
    rows = layers[0].select(key, F.col(value).cast("string").alias(value), F.lit(0).alias("layer"))
    for i, x in enumerate(layers[1:], 1):
        rows = rows.unionByName(x.select(key, F.col(value).cast("string").alias(value), F.lit(i).alias("layer")))
    own = Window.partitionBy(key).orderBy("layer")
    return rows.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def page_after(rows: DataFrame, at: str, tie: str, cursor: str, n: int) -> DataFrame:
    """The n newest rows before a cursor and one more, which tells whether another page follows."""
    return rows.where(F.col(at) < F.lit(cursor).cast("timestamp")).orderBy(F.desc(at), F.desc(tie)).limit(n + 1)


def latest_hit_rate(rows: DataFrame, key: str, hit: str, at: str, tie: str) -> DataFrame:
    """Share of hits by key, and the latest outcome."""
    return rows.groupBy(key).agg(F.round(F.avg(F.col(hit).cast("int")), 6).alias("hit_rate"), F.max_by(hit, F.struct(at, tie)).alias("latest"))
