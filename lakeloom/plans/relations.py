"""The supplied tables as the relations that the operators work on, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relined(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """(doc_id, text) of documents, each line x of number i replaced by an expression; rows of one doc_id are one text, by the numbers of their lines."""
    lines = F.expr(f"transform(split(text, '\n', -1), (x, i) -> struct(i, {line} AS line))")
    found = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("doc_id").agg(F.flatten(F.collect_list(lines)).alias("lines"))
    return found.select("doc_id", F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "\n").alias("text"))


def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as bots, nation as workspace, region as tenant."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    dims = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("workspace"), F.col("r_name").alias("tenant"))
    return c.join(F.broadcast(dims), c["c_nationkey"] == dims["n_nationkey"]).select(F.col("c_custkey").alias("bot"), F.col("c_name").alias("slug"), "workspace", "tenant")


BOTS = """bots AS (SELECT c_custkey AS bot, c_name AS slug, n_name AS workspace, r_name AS tenant FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as request logs of the bots."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("started_at"), F.col("user_id").alias("bot"),
        F.when(kind == "error", "failed").when(kind == "signup", "refused").otherwise("success").alias("status"), F.when(kind == "signup", "no_context").alias("refusal_reason"),
        F.round(F.col("value") * 100).cast("int").alias("duration_ms"), (F.col("value") / 1000).cast("decimal(12,6)").alias("cost_usd"), k.alias("total_tokens"),
        F.when(F.col("event_id") % 3 == 0, "web").otherwise("api").alias("channel"), F.when(kind == "purchase", True).when(kind == "error", False).alias("is_correct"),
        F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 11 == 0, -1).alias("feedback"), F.concat(F.lit("q"), k.cast("string")).alias("question"), kind.alias("step_name"),
    )
    return logs.join(bots(spark, sf_dir).select("bot", "workspace", "tenant"), "bot", "left")


LOGS = (
    BOTS
    + """, logs AS (SELECT event_id AS request_id, ts AS started_at, user_id AS bot, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'refused' ELSE 'success' END AS status,
  CASE WHEN event_type = 'signup' THEN 'no_context' END AS refusal_reason, CAST(round(value * 100) AS INTEGER) AS duration_ms, CAST(value / 1000 AS DECIMAL(12,6)) AS cost_usd,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens, CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'api' END AS channel,
  CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN false END AS is_correct, CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN -1 END AS feedback,
  'q' || json_extract_string(props, '$.k') AS question, event_type AS step_name, workspace, tenant FROM events LEFT JOIN bots ON user_id = bot)"""
)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a token ledger."""
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(14,4)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("started_at"), F.col("l_quantity").cast("long").alias("tokens"), price.alias("cost_usd"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("action"), F.col("l_suppkey").alias("supplier")
    )


LEDGER = """ledger AS (SELECT l_orderkey AS request_id, l_shipdate AS started_at, CAST(l_quantity AS BIGINT) AS tokens, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(14,4)) AS cost_usd, l_returnflag AS model, l_linestatus AS action, l_suppkey AS supplier FROM lineitem)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as priced entities of documents; every sixth has no first price, every third a second one."""
    size, key = F.col("p_size"), F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    attrs = F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(size % 2 == 0, size.cast("string")).otherwise(F.lit(" "))), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(
        key.alias("entity_id"), (key % 50).alias("doc_id"), (key % 7).cast("int").alias("chunk_index"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), size.alias("size"),
        F.when(key % 6 != 0, price).alias("price_primary"), F.when(key % 3 == 0, (price * 2).cast("decimal(18,2)")).alias("price_secondary"), attrs.alias("attributes"),
    )


ENTITIES = """entities AS (SELECT p_partkey AS entity_id, p_partkey % 50 AS doc_id, CAST(p_partkey % 7 AS INTEGER) AS chunk_index, p_name AS name, p_type AS category, p_brand AS brand, p_size AS size,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS price_primary, CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2)) END AS price_secondary FROM part)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as their chunks; a chunk's parent is the first of its run of four."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    ident = lambda i: F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string"))
    parent = F.when(F.col("chunk_index") % 4 != 0, ident(F.col("chunk_index") - F.col("chunk_index") % 4))
    return lines.select(ident(F.col("chunk_index")).alias("chunk_id"), parent.alias("parent_id"), "doc_id", "source", "lang", "chunk_index", "content", (F.col("chunk_index") % 5 != 4).alias("embedded"))


CHUNKS = """lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents),
  chunks AS (SELECT doc_id || '-' || chunk_index AS chunk_id, CASE WHEN chunk_index % 4 <> 0 THEN doc_id || '-' || (chunk_index - chunk_index % 4) END AS parent_id, doc_id, source, lang, CAST(chunk_index AS INTEGER) AS chunk_index, content, chunk_index % 5 <> 4 AS embedded FROM lines)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("entity"))
