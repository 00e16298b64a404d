"""Structured Streaming forms: dedup, windows, rate limits, outbox with dead letters, life cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup(events: DataFrame, *keys: str, at: str = "ts", within: str = "24 hours") -> DataFrame:
    """The first event of each key; repeats within the time are dropped and older state is forgotten."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


def tumbling_distinct(events: DataFrame, what: str, *keys: str, at: str = "ts", width: str = "60 seconds", late: str = "2 minutes", exact: bool = False) -> DataFrame:
    """Distinct values per key and window of fixed width; the sketch keeps state small, exact is for batches."""
    count = F.countDistinct(what) if exact else F.approx_count_distinct(what)
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(count.alias("n_distinct"), F.count("*").alias("n"))


def sliding_limit(events: DataFrame, key: str, limit: int, window_s: int, burst: float = 1.0, burst_s: int = 0, at: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Each event with allowed and used, by a log of the allowed calls of the last window_s seconds; denied calls leave no trace.

    With a burst factor above 1 the limit rises by it while the last burst_s seconds hold fewer calls than that. The state of a key is its allowed calls, limit times the factor at most,
    and is dropped a window after its last event. Events of a batch are taken in time order.
    """
    top = int(limit * burst) if burst > 1 and burst_s > 0 else limit

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, event_id], kind="stable")
        out = []
        for t, i in zip(rows[at].astype("int64") / 1e9 if rows[at].dtype == "datetime64[ns]" else rows[at].map(lambda x: x.timestamp()), rows[event_id], strict=True):
            log = [x for x in log if x >= t - window_s]
            ceiling = top if top > limit and sum(x >= t - burst_s for x in log) < top else limit
            used = len(log)
            if used < ceiling:
                log.append(t)
            out.append((k[0], i, used < ceiling, used + (used < ceiling)))
        state.update((log,))
        state.setTimeoutDuration(max(1, window_s) * 1000)
        yield pd.DataFrame(out, columns=[key, event_id, "allowed", "used"])

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, allowed boolean, used long"
    return events.select(key, event_id, at).groupBy(key).applyInPandasWithState(run, schema, "log array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def lifecycle(events: DataFrame, key: str = "doc_id", at: str = "ts", state_col: str = "state") -> DataFrame:
    """The latest state of each document, by event time."""
    return events.groupBy(key).agg(F.max_by(state_col, at).alias("state"), F.max(at).alias("updated_at"))


def expire(rows: DataFrame, as_of: str, at: str = "expires_at") -> DataFrame:
    """Rows that haven't expired."""
    return rows.where(F.col(at).isNull() | (F.col(at) > F.lit(as_of).cast("timestamp")))


def relay(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], DataFrame], dead_letters: str, max_attempts: int = 5, trigger: dict | None = None, retries: str | None = None):
    """Start a stream that hands each batch to handle(batch, batch_id) and keeps the rows it returns as failed, with their attempts.

    handle gives failed rows (payload, attempts). Those with max_attempts attempts or more are dead letters; the others go to the folder retries (beside the dead letters where
    it isn't given), from where they can be streamed in again. Files are named by batch, so a batch that runs again replaces its own.
    """
    again = retries or f"{dead_letters.rstrip('/')}-retries"

    def each(batch: DataFrame, batch_id: int) -> None:
        failed = handle(batch, batch_id).persist()
        dead = F.coalesce(F.col("attempts") >= max_attempts, F.lit(True))
        failed.where(dead).write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
        failed.where(~dead).write.mode("overwrite").json(f"{again}/batch={batch_id}")
        failed.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
