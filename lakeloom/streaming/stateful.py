"""Streams that keep a state for each key, with timers in event time: life cycles, messages that come back, facts that a conversation has settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The steps of a document, and those that may follow each; seconds until an unacknowledged message comes back; deliveries at most; share by
#: which a price may differ.
STEPS = {"": ("DRAFT",), "DRAFT": ("PROCESSING", "FAILED"), "PROCESSING": ("ACTIVE", "FAILED"), "FAILED": ("PROCESSING",), "ACTIVE": ("PROCESSING",)}
IDLE_S, DELIVERIES, PRICE_SHARE = 30, 5, 0.01
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_states(spark: SparkSession) -> None:
    """States with timers need a store that holds several columns a key; a batch query needs the coordinator of the stores, which the first look at the streams starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active


def _ms(values: pd.Series) -> list[int]:
    return [int(round(pd.Timestamp(v).tz_localize("UTC").timestamp() * 1000)) if pd.Timestamp(v).tzinfo is None else int(round(pd.Timestamp(v).timestamp() * 1000)) for v in values]


class _Steps(StatefulProcessor):
    def __init__(self, steps: dict[str, tuple[str, ...]], forget_s: int):
        self.steps, self.forget = steps, forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("step", "step string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, at = self.state.get() if self.state.exists() else ("", 0)
        out = []
        for b in rows:
            b = b.assign(_ms=_ms(b["ts"])).sort_values(["_ms", "step"], kind="stable")
            for new, ms in zip(b["step"], b["_ms"], strict=True):
                good = new in self.steps.get(step, ()) and ms >= at
                out.append((key[0], ms, step, new, good))
                if good:
                    step, at = new, ms
        if step:
            self.state.update((step, at))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at + self.forget)
        yield pd.DataFrame(out, columns=["key", "at_ms", "before", "step", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs(), step, "", True)], columns=["key", "at_ms", "before", "step", "accepted"])

    def close(self) -> None:
        pass


def life_cycle(events: DataFrame, steps: dict[str, tuple[str, ...]] = STEPS, forget_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, at_ms, before, step, accepted) for each of events(key, ts, step): whether the step may follow the one that the key is at.

    A refused step changes nothing. A key without a step for so long, by the watermark, is forgotten with a row whose step is empty, and its state is gone.
    """
    kind = events.schema["key"].dataType.simpleString()
    some = events.select("key", "ts", "step").withWatermark("ts", late)
    return some.groupBy("key").transformWithStateInPandas(_Steps(steps, forget_s), f"key {kind}, at_ms long, before string, step string, accepted boolean", "Append", "EventTime")


class _Pending(StatefulProcessor):
    def __init__(self, idle_s: int, deliveries: int):
        self.idle, self.most = idle_s * 1000, deliveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("pending", "payload string, deliveries int")

    def _wait(self, until: int | None) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, until = [], None
        pending = self.state.get() if self.state.exists() else None
        for b in rows:
            b = b.assign(_ms=_ms(b["ts"])).sort_values("_ms", kind="stable")
            for payload, acked, ms in zip(b["payload"], b["acked"], b["_ms"], strict=True):
                if acked:
                    pending, until = None, None
                elif pending is None:
                    pending, until = (payload, 1), ms + self.idle
                    out.append((key[0], ms, payload, 1, "sent"))
        if pending is None:
            self.state.clear()
            self._wait(None)
        else:
            self.state.update(pending)
            if until is not None:
                self._wait(until)
        yield pd.DataFrame(out, columns=["key", "at_ms", "payload", "deliveries", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (payload, n), at = self.state.get(), expiredTimerInfo.getExpiryTimeInMs()
        if n >= self.most:
            self.state.clear()
            what = "dead"
        else:
            n, what = n + 1, "again"
            self.state.update((payload, n))
            self.handle.registerTimer(at + self.idle)
        yield pd.DataFrame([(key[0], at, payload, n, what)], columns=["key", "at_ms", "payload", "deliveries", "what"])

    def close(self) -> None:
        pass


def pending_messages(events: DataFrame, idle_s: int = IDLE_S, deliveries: int = DELIVERIES, late: str = "0 seconds") -> DataFrame:
    """(key, at_ms, payload, deliveries, what) for events(key, ts, payload, acked): messages as they are sent, sent again and given up.

    A message that isn't acknowledged for so many seconds, by the watermark, is sent again, and after so many deliveries it is a dead letter. An acknowledged
    message leaves no state.
    """
    kind = events.schema["key"].dataType.simpleString()
    some = events.select("key", "ts", "payload", "acked").withWatermark("ts", late)
    return some.groupBy("key").transformWithStateInPandas(_Pending(idle_s, deliveries), f"key {kind}, at_ms long, payload string, deliveries int, what string", "Append", "EventTime")


def drift(answer: Column, locked_name: Column, locked_price: Column, names: Column, prices: Column, share: float = PRICE_SHARE) -> Column:
    """The rules that an answer breaks: another of the names at hand in place of the settled one; prices that are all but the settled one.

    names: those of the chunks at hand; prices: the answer's. Nothing settled is never broken.
    """
    said = F.lower(F.coalesce(answer, F.lit("")))
    own = F.lower(locked_name)
    other = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: (F.lower(n) != own) & F.contains(said, F.lower(n)) & ~F.contains(said, own))
    far = F.filter(F.coalesce(prices, F.array().cast("array<double>")), lambda p: F.abs(p - locked_price) > F.greatest(locked_price * share, F.lit(1.0)))
    price = (F.size(far) > 0) & ~F.coalesce(F.array_contains(prices, locked_price), F.lit(False))
    return F.array_compact(F.array(F.when(F.coalesce(other, F.lit(False)), "service_drift"), F.when(F.coalesce(price, F.lit(False)), "price_drift")))


class _Settled(StatefulProcessor):
    def __init__(self, forget_s: int):
        self.forget = forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("settled", "name string, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, price = self.state.get() if self.state.exists() else (None, None)
        out, last = [], 0
        for b in rows:
            b = b.assign(_ms=_ms(b["ts"])).sort_values("_ms", kind="stable")
            for ms, new, worth, answer in zip(b["_ms"], b["name"], b["price"], b["answer"], strict=True):
                out.append((key[0], ms, name, price, answer))
                name = new if isinstance(new, str) else name
                price = float(worth) if pd.notna(worth) else price
                last = max(last, ms)
        self.state.update((name, price))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.forget)
        yield pd.DataFrame(out, columns=["key", "at_ms", "locked_name", "locked_price", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({c: [] for c in ("key", "at_ms", "locked_name", "locked_price", "answer")})

    def close(self) -> None:
        pass


def settled_facts(turns: DataFrame, forget_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, at_ms, locked_name, locked_price, answer) for turns(key, ts, name, price, answer): what the conversation had settled before each answer."""
    kind = turns.schema["key"].dataType.simpleString()
    some = turns.select("key", "ts", "name", "price", "answer").withWatermark("ts", late)
    return some.groupBy("key").transformWithStateInPandas(_Settled(forget_s), f"key {kind}, at_ms long, locked_name string, locked_price double, answer string", "Append", "EventTime")
