"""Operational analytics over request logs and token ledgers.

Every function takes facts and gives one aggregate plan; costs are summed as decimals and turned into doubles at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOOD, REFUSED, FAILED = ("success",), ("refused", "moderated"), ("failed", "timeout")


def _percentile(column: str, share: float) -> Column:
    """Exact, interpolated."""
    return F.percentile(column, F.lit(share))


def _pct(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 6)


def _cost(column: str = "cost_usd") -> Column:
    return F.round(F.coalesce(F.sum(column), F.lit(0)).cast("double"), 6)


def is_pass() -> Column:
    return (F.col("status") == "success") & F.col("refusal_reason").isNull()


def pass_rate(logs: DataFrame, *keys: str) -> DataFrame:
    """Counts of passed, refused and wrong requests by keys. A null verdict counts as neither."""
    total, passed = F.count("*"), F.count_if(is_pass())
    refused = F.count_if((F.col("status") == "refused") | F.col("refusal_reason").isNotNull())
    wrong = F.count_if(F.col("is_correct") == F.lit(False))
    return logs.groupBy(*keys).agg(total.alias("total"), passed.alias("pass_count"), refused.alias("refuse_count"), wrong.alias("wrong_count"), _pct(passed, total).alias("pass_rate_pct"))


def cost(logs: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*")
    return logs.groupBy(*keys).agg(n.alias("total_requests"), _cost().alias("total_cost_usd"), F.round(F.sum("cost_usd").cast("double") / n, 8).alias("avg_cost_per_turn"))


def latency(logs: DataFrame, *keys: str, measure: str = "duration_ms") -> DataFrame:
    shares = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return logs.groupBy(*keys).agg(*[F.round(_percentile(measure, v), 4).alias(k) for k, v in shares.items()], F.max(measure).alias("max_ms"))


def usage(logs: DataFrame, bots: DataFrame, slugs: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    """Requests, cost, tokens and latency by bot, workspace and channel; slugs and channels narrow it."""
    if slugs:
        logs = logs.join(bots.where(F.col("slug").isin(slugs)).select(F.col("bot")), "bot", "left_semi")
    if channels:
        logs = logs.where(F.col("channel").isin(channels))
    named = logs.join(bots.select("bot", "slug"), "bot", "left")
    return named.groupBy("bot", "slug", "workspace", "channel").agg(
        F.count("*").alias("total_requests"), _cost().alias("total_cost_usd"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"), F.round(_percentile("duration_ms", 0.95), 4).alias("p95_duration_ms"),
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
    )


SORTS = {"total_cost": "total_cost_usd", "total_requests": "total_requests", "avg_latency": "avg_duration_ms"}


def summary(logs: DataFrame, key: str, sort_by: str = "total_cost", limit: int = 100) -> DataFrame:
    """One row per key with distinct workspaces and bots, the first so many by a named measure."""
    if limit <= 0 or sort_by not in SORTS:
        raise ValueError(f"limit must be positive and sort_by one of {sorted(SORTS)}")
    out = logs.groupBy(key).agg(
        F.countDistinct("workspace").alias("workspace_count"), F.countDistinct("bot").alias("bot_count"), F.count("*").alias("total_requests"), _cost().alias("total_cost_usd"),
        F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"), F.round(_percentile("duration_ms", 0.95), 4).alias("p95_duration_ms"), F.sum("total_tokens").alias("total_tokens"),
    )
    return out.orderBy(F.desc_nulls_first(SORTS[sort_by]), key).limit(limit)


def drift(logs: DataFrame, as_of: str, days: int, *keys: str, major: tuple[float, float] = (10.0, 25.0), minor: tuple[float, float] = (5.0, 10.0)) -> DataFrame:
    """The last days against as many before them; the row at the boundary belongs to both windows.

    major and minor: a drop of the pass rate in points, a rise of the cost in percent.
    """
    now = F.lit(as_of).cast("timestamp")
    cut, start = now - F.expr(f"INTERVAL {int(days)} DAYS"), now - F.expr(f"INTERVAL {2 * int(days)} DAYS")
    at = F.col("started_at")
    rows = logs.where((at >= start) & (at <= now)).withColumn("current", (at >= cut)).withColumn("base", at <= cut)

    def part(flag: str) -> list[Column]:
        mine = F.col(flag)
        n = F.count_if(mine)
        return [
            _pct(F.count_if(mine & is_pass()), n).alias(f"{flag}_rate"), F.coalesce(F.try_divide(F.sum(F.when(mine, F.col("cost_usd"))).cast("double"), n), F.lit(0.0)).alias(f"{flag}_cost"),
            F.coalesce(F.percentile(F.when(mine, F.col("duration_ms")), F.lit(0.95)), F.lit(0.0)).alias(f"{flag}_p95"),
        ]

    both = rows.groupBy(*keys).agg(*part("current"), *part("base"))
    drop, rise = F.col("base_rate") - F.col("current_rate"), F.round(F.coalesce(F.try_divide((F.col("current_cost") - F.col("base_cost")) * 100.0, F.col("base_cost")), F.lit(0.0)), 6)
    crossed = lambda t: (drop >= t[0]) | (rise >= t[1])
    severity = F.when(crossed(major), "MAJOR").when(crossed(minor), "MINOR").otherwise("NONE")
    return both.select(*keys, F.round(-drop, 6).alias("pass_rate_delta_pp"), rise.alias("cost_delta_pct"), F.round(F.col("current_p95") - F.col("base_p95"), 4).alias("p95_delta_ms"), severity.alias("severity"))


def token_rollup(logs: DataFrame) -> DataFrame:
    """Totals, by day, by workspace, and by bot and channel, in one scan by grouping sets; level names the set."""
    rows = logs.withColumn("day", F.date_trunc("day", "started_at"))
    day, workspace, bot, channel = (F.col(c) for c in ("day", "workspace", "bot", "channel"))
    out = rows.groupingSets([[], [day], [workspace], [bot, channel]], day, workspace, bot, channel).agg(
        F.grouping_id().alias("g"), F.count("*").alias("requests"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double"), 5).alias("cost_usd")
    )
    level = F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "day").when(F.col("g") == 11, "workspace").otherwise("bot_channel")
    return out.select(level.alias("level"), "day", "workspace", "bot", "channel", "requests", "tokens", "cost_usd")


def outcomes(logs: DataFrame, *keys: str) -> DataFrame:
    """Latency percentiles with refusals and errors."""
    return latency(logs, *keys).join(
        logs.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(F.col("status").isin(*REFUSED)).alias("refusals"), F.count_if(F.col("status").isin(*FAILED)).alias("errors")), list(keys)
    )


def shares(steps: DataFrame, key: str = "step_name") -> DataFrame:
    """Calls and mean duration by step, and its share of the sum of means."""
    by = steps.groupBy(key).agg(F.count("*").alias("calls"), F.avg("duration_ms").alias("avg_raw"), F.count_if(~F.col("status").isin("success", "")).alias("errors"))
    share = F.round(F.col("avg_raw") * 100.0 / F.sum("avg_raw").over(Window.partitionBy()), 4)
    return by.select(key, "calls", F.round("avg_raw", 4).alias("avg_ms"), "errors", share.alias("pct_of_total"))


def status_distribution(logs: DataFrame) -> DataFrame:
    by = logs.groupBy("status").agg(F.count("*").alias("n"), F.count("is_correct").alias("judged"), F.count_if("is_correct").alias("correct"), F.round(F.avg("feedback"), 6).alias("avg_feedback"))
    return by.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def budget_status(budgets: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Usage of each budget in its current day or month at its level, all budgets in one join.

    Usage is summed once by tenant, workspace, bot and day, and again by level; a budget is joined with the sum of its level, period and scope.
    """
    now = F.lit(as_of).cast("timestamp")
    daily = F.sum(F.when(F.col("started_at") >= F.date_trunc("day", now), F.col("total_tokens"))).alias("daily")
    month = logs.where((F.col("started_at") >= F.date_trunc("month", now)) & (F.col("started_at") <= now))
    base = month.groupBy("tenant", "workspace", "bot").agg(daily, F.sum("total_tokens").alias("monthly"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("daily", "monthly")]
    scopes = {"tenant": F.col("tenant"), "workspace": F.col("workspace"), "bot": F.col("bot").cast("string")}
    used = None
    for level, scope in scopes.items():
        part = base.groupBy("tenant", scope.alias("scope")).agg(*sums).withColumn("level", F.lit(level))
        used = part if used is None else used.unionByName(part)
    both = budgets.join(used, ["tenant", "level", "scope"], "left")
    tokens = F.coalesce(F.when(F.col("period") == "monthly", F.col("monthly")).otherwise(F.col("daily")), F.lit(0))
    pct = F.round(F.coalesce(F.try_divide(tokens * 100.0, F.col("token_limit")), F.lit(0.0)), 4)
    return both.select("budget_id", "level", "scope", "period", "token_limit", tokens.alias("used_tokens"), pct.alias("pct"), (pct >= F.coalesce("alert_at_pct", F.lit(80))).alias("alerting"))


def overview(logs: DataFrame, *keys: str) -> DataFrame:
    judged = F.count("is_correct")
    return logs.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), _cost().alias("cost_usd"), F.sum("total_tokens").alias("tokens"), judged.alias("judged"),
        F.round(F.try_divide(F.sum(F.col("is_correct").cast("int")), judged), 6).alias("accuracy"),
    )


def timeseries(ledger: DataFrame, unit: str, *breakdown: str, at: str = "started_at") -> DataFrame:
    """Sums by hour, day or month, and by further keys."""
    if unit not in ("hour", "day", "month"):
        raise ValueError("unit is hour, day or month")
    return ledger.groupBy(F.date_trunc(unit, at).alias("bucket"), *breakdown).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd").cast("double"), 6).alias("cost_usd"))


def feedback(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(F.count_if(F.col("feedback") > 0).alias("up"), F.count_if(F.col("feedback") < 0).alias("down"))


def extremes(logs: DataFrame, *keys: str) -> DataFrame:
    """Filtered minimum, and the requests with the shortest and the longest duration; the least request_id breaks ties."""
    pick = lambda f, sign: f("request_id", F.struct("duration_ms", (F.col("request_id") * sign)))
    return logs.groupBy(*keys).agg(
        F.min(F.when(F.col("status") == "success", F.col("duration_ms"))).alias("min_success_ms"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), pick(F.max_by, -1).alias("slowest"), pick(F.min_by, 1).alias("fastest")
    )


def over_limit(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def quota_alerts(tenants: DataFrame, logs: DataFrame, as_of: str, days: int, warn: float = 0.8, exceed: float = 1.0) -> DataFrame:
    """Tenants whose usage in the last days reaches a share of their quota; no quota and a quota of 0 never alert."""
    if days <= 0 or not 0 < warn <= 1 or exceed < warn:
        raise ValueError("days must be positive, warn in (0, 1] and exceed no less than warn")
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    used = logs.where(F.col("started_at") >= since).groupBy("tenant").agg(F.sum("total_tokens").alias("used"))
    ratio = F.col("used_tokens") / F.col("quota")
    both = tenants.where("quota IS NOT NULL AND quota <> 0").join(used, "tenant", "left").withColumn("used_tokens", F.coalesce("used", F.lit(0)))
    severity = F.when(ratio >= exceed, "exceeded").when(ratio >= warn, "warning")
    return both.select("tenant", "used_tokens", "quota", F.round(ratio, 6).alias("ratio"), severity.alias("severity")).where("severity IS NOT NULL")


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Rows by bucket: below the first edge, from each edge on."""
    bucket = F.when(F.col(value).isNull(), "none").when(F.col(value) < edges[0], f"<{edges[0]:g}")
    for a, b in zip(edges, edges[1:]):
        bucket = bucket.when(F.col(value) < b, f"{a:g}-{b:g}")
    return rows.groupBy(bucket.otherwise(f">={edges[-1]:g}").alias("bucket")).agg(F.count("*").alias("n"))


def calls_per_request(rows: DataFrame, request: str, *keys: str) -> DataFrame:
    """Percentiles of how many rows a request has: two levels of aggregation."""
    per = rows.groupBy(request, *keys).agg(F.count("*").alias("calls"))
    return per.groupBy(*keys).agg(F.count("*").alias("requests"), F.round(_percentile("calls", 0.5), 4).alias("p50"), F.round(_percentile("calls", 0.95), 4).alias("p95"), F.max("calls").alias("max_calls"))


def latest(rows: DataFrame, at: str, tie: str, *keys: str) -> DataFrame:
    """The newest row of each key, nulls last; ties by the greatest tie column."""
    own = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc_nulls_last(tie))
    return rows.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def monthly_cap(ledger: DataFrame, cap: int, warn_percent: int = 80, block_percent: int = 100, *keys: str) -> DataFrame:
    """Tokens by key and month, and the decision by whole percents."""
    by = ledger.groupBy(*keys, F.date_format("started_at", "yyyyMM").alias("month")).agg(F.sum("tokens").alias("tokens"))
    percent = F.floor(F.col("tokens") * 100 / cap).cast("long")
    return by.withColumn("percent", percent).withColumn("decision", F.when(percent >= block_percent, "block").when(percent >= warn_percent, "warn").otherwise("allow"))


def corpus_marker(documents: DataFrame, *keys: str) -> DataFrame:
    """The newest change of each corpus, deletions included."""
    return documents.groupBy(*keys).agg(F.max(F.greatest("updated_at", F.coalesce("deleted_at", "updated_at"))).alias("marker"), F.count("*").alias("n"))


def top_questions(logs: DataFrame, n: int, by: str = "ask_count") -> DataFrame:
    out = logs.groupBy("question").agg(F.count("*").alias("ask_count"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.round(F.avg("duration_ms"), 4).alias("avg_latency"))
    return out.orderBy(F.desc(by), "question").limit(n)


def verify_chain(rows: DataFrame, tenant: str, order: list[str], payload: Column, stored: str = "row_hash") -> DataFrame:
    """Rows whose stored hash isn't that of the previous stored hash and their payload.

    After a match the previous computed hash equals the stored one, so the lag of the stored hash suffices.
    """
    before = F.coalesce(F.lag(stored).over(Window.partitionBy(tenant).orderBy(*order)), F.lit(""))
    expected = F.sha2(F.concat(before, payload).cast("binary"), 256)
    checked = rows.withColumn("expected_hash", expected)
    return checked.where(~F.trim(F.coalesce(F.col(stored), F.lit(""))).eqNullSafe(F.col("expected_hash")))


def pareto(rows: DataFrame, up: list[str], down: list[str], key: str) -> DataFrame:
    """Rows that no other row is at least as good as in everything and better in something."""
    a, b = rows.alias("a"), rows.alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for c in up:
        no_worse, better = no_worse & (F.col(f"b.{c}") >= F.col(f"a.{c}")), better | (F.col(f"b.{c}") > F.col(f"a.{c}"))
    for c in down:
        no_worse, better = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}")), better | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    return a.join(b, no_worse & better, "left_anti")


def ingest_state(chunks: DataFrame, min_coverage: float = 0.8) -> DataFrame:
    """By document: active if its leaf chunks are embedded well enough. A chunk that others name as parent is no leaf."""
    parents = chunks.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("chunk_id"), F.lit(True).alias("is_parent")).distinct()
    both = chunks.join(parents, "chunk_id", "left")
    leaf = F.col("is_parent").isNull()
    by = both.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(leaf).alias("leaves"), F.count_if(leaf & F.col("embedded")).alias("embedded_leaves"))
    state = F.when(F.col("total") == 0, "failed").when(F.try_divide(F.col("embedded_leaves"), F.col("leaves")) >= min_coverage, "active").otherwise("failed")
    return by.withColumn("state", state)
