"""Reads and rollups over log, document and configuration records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An identifier of five groups of hex digits.
UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is on a list of ids; a null key is on none."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def metrics_by_model(logs: DataFrame, model: str = "model_name") -> DataFrame:
    """Requests, mean time, tokens, cost and accuracy by model; accuracy is null where nothing was judged."""
    judged, right = F.count("is_correct"), F.count_if(F.col("is_correct"))
    return logs.groupBy(model).agg(
        F.count("*").alias("requests"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 4).alias("avg_duration_ms"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double"), 6).alias("total_cost_usd"), F.round(F.try_divide(right.cast("double"), judged), 6).alias("accuracy"),
    )


def step_breakdown(steps: DataFrame, step: str = "step_name") -> DataFrame:
    """Samples, mean and exact 95th percentile of the time of each step."""
    p95 = F.expr("percentile(duration_ms, 0.95)")
    return steps.groupBy(step).agg(F.count("*").alias("samples"), F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"), F.round(p95, 4).alias("p95_duration_ms"))


def audit_overview(documents: DataFrame, chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """One row of counts and means of live documents(doc_id, n_chars), their chunks(doc_id, content, strategy) and request logs, with chunks by strategy as a map."""
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("total_chars"))
    own = chunks.join(documents.select("doc_id"), "doc_id", "left_semi")
    c = own.agg(F.count("*").alias("chunks"), F.round(F.coalesce(F.avg(F.length("content")), F.lit(0.0)), 4).alias("avg_chunk_chars"))
    by = own.where("strategy IS NOT NULL").groupBy("strategy").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("strategies"))
    q = logs.agg(F.count("*").alias("queries"), F.round(F.expr("percentile(duration_ms, 0.5)"), 4).alias("p50_ms"), F.round(F.expr("percentile(duration_ms, 0.95)"), 4).alias("p95_ms"))
    return d.crossJoin(c).crossJoin(by).crossJoin(q)  # one row each


def distinct_tuples(rows: DataFrame, group: str, *columns: str, more_than: int = 1) -> DataFrame:
    """(group, rows, tuples) of the groups with more rows than distinct tuples of the columns; a tuple of nulls counts as one."""
    tuples = F.count_distinct(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")).alias(c) for c in columns]))
    return rows.groupBy(group).agg(F.count("*").alias("rows"), tuples.alias("tuples")).where((F.col("rows") > F.col("tuples")) & (F.col("rows") > more_than))


def type_histogram(blocks: DataFrame, kind: str = "kind") -> DataFrame:
    """Blocks by type, unknown ones as TEXT."""
    return blocks.groupBy(F.upper(F.coalesce(F.col(kind), F.lit("text"))).alias("block_type")).agg(F.count("*").alias("n"))


def add_to_counters(counters: DataFrame, usage: DataFrame, *keys: str) -> DataFrame:
    """counters(keys, tokens) with usage(keys, tokens) added: sums of what stands and what comes, for keys of either."""
    both = counters.select(*keys, "tokens").unionByName(usage.select(*keys, "tokens"))
    return both.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))


def union_by_first(lists: DataFrame, group: str, key: str) -> DataFrame:
    """The rows of several lists(list_no, place) of a group in order, each key at its first place; rows without a key all stay."""
    own = Window.partitionBy(group, key).orderBy("list_no", "place")
    first = lists.withColumn("_n", F.row_number().over(own)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("list_no", "place")))


def intent_weights(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """queries(intent) with vector, lexical and rerank weights of weights(intent, vector, bm25, reranker) that sum to one; unknown intents take those of 'default'.

    Weights that sum to nothing stay as they are. The table of weights has a row per intent, so Spark broadcasts it.
    """
    total = F.col("vector") + F.col("bm25") + F.col("reranker")
    scaled = [F.when(total > 0, F.col(c) / total).otherwise(F.col(c)).alias(c) for c in ("vector", "bm25", "reranker")]
    known = weights.select(F.lower(F.trim("intent")).alias("_key"), *scaled)
    name = F.lower(F.trim(F.coalesce("intent", F.lit(""))))
    found = queries.withColumn("_name", name).join(known.select(F.col("_key").alias("_known")), F.col("_name") == F.col("_known"), "left")
    return found.withColumn("_key", F.coalesce("_known", F.lit("default"))).drop("_known", "_name").join(known, "_key", "left").drop("_key")


def list_all(rows: DataFrame, at: str = "created_at", key: str = "entity_id", cap: int = 1000) -> DataFrame:
    """The first rows by age, as many as a page takes."""
    return rows.orderBy(F.asc_nulls_last(at), key).limit(cap)


def chunk_references(requests: DataFrame) -> DataFrame:
    """(request_id, chunk_id, rank, score) of requests(request_id, chunks array of struct(chunk_id, rank, score)): the rank given or else the place, without ids that are no UUIDs."""
    flat = requests.select("request_id", F.posexplode("chunks").alias("place", "c"))
    rank = F.coalesce(F.col("c.rank").try_cast("int"), F.col("place"))
    return flat.where(F.rlike("c.chunk_id", F.lit(UUID))).select("request_id", F.lower("c.chunk_id").alias("chunk_id"), rank.alias("rank"), F.col("c.score").try_cast("double").alias("score"))


def invocations(messages: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Steps and model calls(message_id, at, name) of each message as one list in order of time."""
    both = steps.select("message_id", "at", "name", F.lit("step").alias("kind")).unionByName(calls.select("message_id", "at", "name", F.lit("call").alias("kind")))
    own = Window.partitionBy("message_id").orderBy("at", "kind", "name")
    return with_ids(both, messages, "message_id").withColumn("place", F.row_number().over(own))


def bindings(rows: DataFrame, tenant: str | None, bot: Column | int, purposes: list[str]) -> DataFrame:
    """(purpose, models) of a bot: active bindings of the tenant and those without one, models in order of rank; a purpose without bindings has an empty list."""
    spark = rows.sparkSession
    mine = F.col("tenant").isNull() if tenant is None else F.col("tenant").isNull() | (F.col("tenant") == tenant)
    found = rows.where(mine & (F.col("bot") == bot) & F.col("purpose").isin(purposes) & F.col("active"))
    found = found.groupBy("purpose").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda x: x["model"]).alias("models"))
    asked = spark.createDataFrame([(p,) for p in purposes], "purpose string")
    return asked.join(found, "purpose", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def unique_match(wanted: DataFrame, rows: DataFrame, *keys: str, key: str) -> DataFrame:
    """wanted with the one row's key that has the same keys; null where none or more than one has."""
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")
    return wanted.join(one, list(keys), "left")


def chained(rows: DataFrame, tenant: str, order: str, content: str) -> DataFrame:
    """Each tenant's rows in order with hash and prev_hash: a row's hash is over the previous hash and its content, so no row can change unseen.

    One hash needs the one before, so a tenant's rows pass through one task, sorted, with the last hash as all that is kept of them.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in (tenant, order)]
    body = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("body")
    ordered = rows.select(tenant, order, body).repartition(F.col(tenant)).sortWithinPartitions(tenant, order, "body")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = object(), ""
        for b in batches:
            before, after = [], []
            for t, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                last = last if t == own else ""
                own = t
                before.append(last)
                last = hashlib.sha256((last + body).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(after, pa.string()), pa.array(before, pa.string())], [tenant, order, "hash", "prev_hash"])

    return ordered.mapInArrow(link, f"{tenant} {kinds[0]}, {order} {kinds[1]}, hash string, prev_hash string")


def audit_page(rows: DataFrame, actor: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest audit rows of an actor since a moment, a page of them."""
    out = rows if actor is None else rows.where(F.col("actor") == actor)
    out = out if since is None else out.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return out.orderBy(F.desc("at"), "event_id").limit(limit)


def served(chunks: Column, items: int, chars: int) -> Column:
    """What of an array of chunks(chunk_id, score, rerank_score, rrf_score, source, content) is kept: the first items, one score each, and the head of the text; null has none."""
    one = lambda c: F.struct(
        F.coalesce(c["chunk_id"], F.lit("")).alias("chunk_id"), F.coalesce(c["score"], c["rerank_score"], c["rrf_score"]).cast("double").alias("score"), F.coalesce(c["source"], F.lit("")).alias("source"), F.substring(F.coalesce(c["content"], F.lit("")), 1, chars).alias("content")
    )
    return F.coalesce(F.transform(F.slice(chunks, 1, items), one), F.array().cast("array<struct<chunk_id:string,score:double,source:string,content:string>>"))


def clamped_percent(value: Column) -> Column:
    """A whole number from 0 to 100; null and what is no number is 0."""
    return F.coalesce(F.least(F.greatest(value.cast("string").try_cast("double").cast("int"), F.lit(0)), F.lit(100)), F.lit(0))


def autonomy(bot: Column, system: Column) -> Column:
    """The greater of two percents, each clamped."""
    return F.greatest(clamped_percent(bot), clamped_percent(system))


def autonomy_band(percent: Column) -> Column:
    """The name of a percent's band."""
    p = clamped_percent(percent)
    return F.when(p < 1, "docs_only").when(p < 34, "constrained").when(p < 67, "moderate").when(p < 100, "liberal").otherwise("research")


def serialised(row: DataFrame, name: str, price: str, attributes: str) -> Column:
    """An entity as a line for a prompt: its name, price and attributes that say something, in order of their names."""
    pairs = F.filter(F.array_sort(F.map_entries(F.col(attributes))), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    told = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), "; ")
    return F.concat_ws(" | ", F.col(name), F.when(F.col(price).isNotNull(), F.concat(F.lit("price: "), F.col(price).cast("string"))), F.when(told != "", told))


def sub_queries(text: Column, most: int) -> Column:
    """The questions of a model's JSON list, blank ones left out and no more than most; what is no list gives none."""
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    found = F.filter(F.transform(F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(found, 1, most)


def estimated_tokens(text: Column, given: Column, chars_per_token: int = 4) -> Column:
    """The count given, or where it is missing or 0 one estimated from the text's length."""
    return F.when(given > 0, given).otherwise(F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token).cast("long"))


def price_strings(text: Column) -> Column:
    """The amounts with a unit in a text as they stand, distinct and in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iu)\d[\d.,]*\s*(?:đ|đồng|vnd|k|tr|triệu)(?!\p{L})"), 0))
