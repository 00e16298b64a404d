"""Queries of the catalogue over records: memberships, metrics, counts, bindings, references, chains; and checks of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import answers, records, scope, structured
from lakeloom.plans.catalog import COST, P, USAGE, query
from lakeloom.plans.relations import CHUNKS, ENTITIES, LOGS, bots, chunks, entities, request_logs, table


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE chunk_id IN (SELECT item_id || '-1' FROM benchmark)")
def chunks_by_ids(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("-1")).alias("chunk_id"))
    return records.with_ids(chunks(spark, sf), ids, "chunk_id").select("chunk_id")


@query(f"""WITH {LOGS} SELECT coalesce(step_name, '') AS model_name, count(*) AS requests, round(avg(duration_ms), 4) AS avg_duration_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {COST} AS total_cost_usd,
  round(count(*) FILTER (is_correct) / nullif(count(is_correct), 0), 6) AS accuracy FROM logs WHERE tenant = 'ASIA' GROUP BY 1""")
def metrics_by_model(spark, sf):
    logs = scope.scoped(request_logs(spark, sf), "ASIA").withColumn("model_name", F.coalesce("step_name", F.lit("")))
    return records.metrics_by_model(logs)


@query(f"WITH {LOGS} SELECT step_name, count(*) AS samples, round(avg(duration_ms), 4) AS avg_duration_ms, {P.format('duration_ms', 0.95)} AS p95_duration_ms FROM logs GROUP BY step_name")
def step_breakdown(spark, sf):
    return records.step_breakdown(request_logs(spark, sf))


@query(f"""WITH {LOGS}, {CHUNKS}, d AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT content FROM chunks WHERE doc_id IN (SELECT doc_id FROM d))
  SELECT (SELECT count(*) FROM d) AS documents, (SELECT CAST(sum(n_chars) AS BIGINT) FROM d) AS total_chars, (SELECT count(*) FROM c) AS chunks, (SELECT round(avg(length(content)), 4) FROM c) AS avg_chunk_chars,
    (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM chunks WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY lang)) AS strategies, (SELECT count(*) FROM logs) AS queries,
    (SELECT {P.format('duration_ms', 0.5)} FROM logs) AS p50_ms, (SELECT {P.format('duration_ms', 0.95)} FROM logs) AS p95_ms""")
def audit_overview(spark, sf):
    live = table(spark, sf, "documents").where("doc_id % 7 <> 0")
    out = records.audit_overview(live, chunks(spark, sf).withColumnRenamed("lang", "strategy"), request_logs(spark, sf))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("strategies")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("strategies", told)


@query(f"WITH {ENTITIES} SELECT (SELECT count(*) FROM entities WHERE contains(lower(name), 'a')) AS by_name, (SELECT count(*) FROM entities WHERE (price_primary BETWEEN 1000 AND 1500) OR (price_secondary BETWEEN 1000 AND 1500)) AS by_price, (SELECT count(*) FROM entities) AS every_one")
def exact_counts(spark, sf):
    e = entities(spark, sf)
    by_name, by_price = F.contains(F.lower("name"), F.lit("a")), structured.in_price_range(1000, 1500)
    return e.agg(F.count_if(by_name).alias("by_name"), F.count_if(by_price).alias("by_price"), F.count("*").alias("every_one"))


@query("""SELECT p_size % 10 AS bucket, count(*) AS rows, count(DISTINCT coalesce(CAST(CASE WHEN p_size % 3 > 0 THEN p_brand END AS VARCHAR), '?') || '/' || coalesce(CASE WHEN p_size % 2 > 0 THEN p_type END, '?')) AS tuples FROM part GROUP BY 1 HAVING count(*) > tuples AND count(*) > 1""")
def tuple_distinct(spark, sf):
    size = F.col("p_size")
    rows = table(spark, sf, "part").select((size % 10).alias("bucket"), F.when(size % 3 > 0, F.col("p_brand")).alias("b"), F.when(size % 2 > 0, F.col("p_type")).alias("t"))
    return records.distinct_tuples(rows, "bucket", "b", "t")


@query("SELECT upper(coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, 'text')) AS block_type, count(*) AS n FROM documents GROUP BY 1")
def block_types(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("kind"))
    return records.type_histogram(d)


@query(f"""WITH {LOGS}, c AS (SELECT bot, '2024-01' AS month, 1000 AS tokens FROM bots WHERE bot % 2 = 0 UNION ALL SELECT bot, strftime(started_at, '%Y-%m'), total_tokens FROM logs) SELECT bot, month, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY bot, month""")
def monthly_counter_upsert(spark, sf):
    counters = bots(spark, sf).where("bot % 2 = 0").select("bot", F.lit("2024-01").alias("month"), F.lit(1000).cast("long").alias("tokens"))
    usage = request_logs(spark, sf).select("bot", F.date_format("started_at", "yyyy-MM").alias("month"), F.col("total_tokens").alias("tokens"))
    return records.add_to_counters(counters, usage, "bot", "month")


@query(f"WITH {LOGS} SELECT {USAGE} FROM logs")
def usage_grand_total(spark, sf):
    """The totals beside usage_multi_bot, over all rows at once: percentiles of groups don't add up."""
    return request_logs(spark, sf).agg(
        F.count("*").alias("total_requests"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double"), 6).alias("total_cost_usd"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"), F.round(F.expr("percentile(duration_ms, 0.95)"), 4).alias("p95_duration_ms"),
    )


@query("""WITH l AS (SELECT o_custkey AS g, 0 AS list_no, o_orderkey AS place, 'c' || (o_orderkey % 5) AS chunk_id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN 'c' || (o_orderkey % 7) END FROM orders),
  f AS (SELECT *, row_number() OVER (PARTITION BY g, chunk_id ORDER BY list_no, place) AS n FROM l QUALIFY n = 1 OR chunk_id IS NULL) SELECT g, list_no, place, chunk_id, row_number() OVER (PARTITION BY g ORDER BY list_no, place) AS rank FROM f""")
def candidate_union(spark, sf):
    k, o = F.col("o_orderkey"), table(spark, sf, "orders")
    name = lambda n: F.concat(F.lit("c"), (k % n).cast("string"))
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("g"), F.lit(0).alias("list_no"), k.alias("place"), name(5).alias("chunk_id"))
    b = o.select(F.col("o_custkey").alias("g"), F.lit(1).alias("list_no"), k.alias("place"), F.when(k % 7 > 0, name(7)).alias("chunk_id"))
    return records.union_by_first(a.union(b), "g", "chunk_id")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 0.25::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS vector, CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'view' THEN 0.25::DOUBLE ELSE 0.4::DOUBLE END AS bm25, CASE event_type WHEN 'purchase' THEN 0.25::DOUBLE WHEN 'view' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END AS reranker FROM events")
def intent_weights(spark, sf):
    weights = spark.createDataFrame([("Purchase", 1.0, 2.0, 1.0), ("view", 2.0, 1.0, 1.0), ("default", 2.0, 2.0, 1.0)], "intent string, vector double, bm25 double, reranker double")
    return records.intent_weights(table(spark, sf, "events").select("event_id", F.col("event_type").alias("intent")), weights).select("event_id", "vector", "bm25", "reranker")


@query("SELECT p_partkey AS entity_id FROM part ORDER BY p_size, p_partkey LIMIT 1000")
def list_all_entities(spark, sf):
    return records.list_all(table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), "p_size"), "p_size").select("entity_id")


@query("""SELECT o_orderkey AS request_id, '00000000-0000-0000-0000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS chunk_id, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 1 END AS rank, CASE WHEN o_orderkey % 3 > 0 THEN 0.5::DOUBLE END AS score FROM orders""")
def chunk_references(spark, sf):
    k = F.col("o_orderkey")
    one = lambda ident, rank, score: F.struct(ident.alias("chunk_id"), rank.cast("string").alias("rank"), score.cast("string").alias("score"))
    good = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))
    refs = F.array(one(F.lit("row 5"), F.lit("0"), F.lit("1")), one(good, F.when(k % 2 == 0, "7").otherwise("x"), F.when(k % 3 > 0, "0.5").otherwise("")))
    return records.chunk_references(table(spark, sf, "orders").select(k.alias("request_id"), refs.alias("chunks")))


@query("""WITH b AS (SELECT l_orderkey AS message_id, l_shipdate AS moment, 'line ' || l_linenumber AS name, 'step' AS kind FROM lineitem UNION ALL SELECT o_orderkey, o_orderdate, 'order', 'call' FROM orders)
  SELECT message_id, name, kind, row_number() OVER (PARTITION BY message_id ORDER BY moment, kind, name) AS place FROM b WHERE message_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def message_invocations(spark, sf):
    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    messages = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("message_id"))
    steps = i.select(F.col("l_orderkey").alias("message_id"), F.col("l_shipdate").alias("at"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"))
    calls = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("name"))
    return records.invocations(messages, steps, calls).select("message_id", "name", "kind", "place")


@query("""SELECT u.purpose, coalesce(models, []) AS models FROM (SELECT unnest(['FURNITURE', 'MACHINERY', 'NOTHING']) AS purpose) u LEFT JOIN (SELECT c_mktsegment AS purpose, list(c_name ORDER BY c_custkey % 10, c_name) AS models FROM customer
  WHERE (c_nationkey = 3 OR c_nationkey % 4 = 0) AND c_custkey % 3 <> 0 GROUP BY 1) b USING (purpose)""")
def bindings_by_purpose(spark, sf):
    k = F.col("c_custkey")
    tenant = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("string"))
    rows = table(spark, sf, "customer").select(tenant.alias("tenant"), F.lit(1).alias("bot"), F.col("c_mktsegment").alias("purpose"), (k % 10).alias("rank"), F.col("c_name").alias("model"), (k % 3 != 0).alias("active"))
    return records.bindings(rows, "3", 1, ["FURNITURE", "MACHINERY", "NOTHING"])


@query("SELECT e.event_id, c.key AS bot FROM events e LEFT JOIN (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS key FROM customer GROUP BY 1, 2 HAVING count(*) = 1) c ON e.user_id % 25 = c.c_nationkey AND c.c_mktsegment = 'BUILDING'")
def unique_bot_lookup(spark, sf):
    wanted = table(spark, sf, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "bot")
    return records.unique_match(wanted, rows, "c_nationkey", "c_mktsegment", key="bot").select("event_id", "bot")


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS t, o_orderkey AS k, sha256(o_orderstatus || o_orderpriority) AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  h AS (SELECT t, k, n, sha256(body) AS hash, '' AS prev_hash FROM r WHERE n = 1
    UNION ALL SELECT r.t, r.k, r.n, sha256(h.hash || r.body), h.hash FROM h JOIN r ON r.t = h.t AND r.n = h.n + 1) SELECT t AS o_custkey, k AS o_orderkey, hash, prev_hash FROM h""")
def audit_chain_append(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("said"))
    return records.chained(rows, "o_custkey", "o_orderkey", "said")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50")
def audit_list(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("actor"), F.col("ts").alias("at"))
    return records.audit_page(rows, "click", "2024-01-10").select("event_id")


@query("SELECT o_orderkey, CAST(least(o_orderkey % 14 + 1, 12) AS INTEGER) AS kept, 0.5::DOUBLE AS score, length(left(repeat('x', CAST(o_orderkey % 500 AS INTEGER)), 400)) AS head FROM orders")
def served_chunks(spark, sf):
    k = F.col("o_orderkey")
    null = F.lit(None).cast("double")
    one = F.struct(F.lit("c").alias("chunk_id"), null.alias("score"), F.lit(0.5).alias("rerank_score"), F.lit(0.1).alias("rrf_score"), F.lit("s").alias("source"), F.repeat(F.lit("x"), (k % 500).cast("int")).alias("content"))
    rows = table(spark, sf, "orders").select("o_orderkey", records.served(F.array_repeat(one, (k % 14 + 1).cast("int")), 12, 400).alias("s"))
    first = F.col("s")[0]
    return rows.select("o_orderkey", F.size("s").alias("kept"), first["score"].alias("score"), F.length(first["content"]).alias("head"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE least(greatest(CAST(trunc(c_acctbal / 50) AS INTEGER), 0), 100) END AS own, least(CAST(c_custkey % 130 AS INTEGER), 100) AS sys FROM customer)
  SELECT c_custkey, greatest(own, sys) AS percent, CASE WHEN greatest(own, sys) < 1 THEN 'docs_only' WHEN greatest(own, sys) < 34 THEN 'constrained' WHEN greatest(own, sys) < 67 THEN 'moderate' WHEN greatest(own, sys) < 100 THEN 'liberal' ELSE 'research' END AS band FROM p""")
def autonomy_bands(spark, sf):
    own = F.when(F.col("c_custkey") % 5 == 0, "high").otherwise((F.col("c_acctbal") / 50).cast("int").cast("string"))
    percent = records.autonomy(own, F.col("c_custkey") % 130)
    return table(spark, sf, "customer").select("c_custkey", percent.alias("percent"), records.autonomy_band(percent).alias("band"))


@query(f"WITH {ENTITIES} SELECT entity_id, name || CASE WHEN price_primary IS NULL THEN '' ELSE ' | price: ' || price_primary END || ' | brand: ' || brand || CASE WHEN size % 2 = 0 THEN '; size: ' || size ELSE '' END AS line FROM entities")
def entity_lines(spark, sf):
    e = entities(spark, sf)
    return e.select("entity_id", records.serialised(e, "name", "price_primary", "attributes").alias("line"))


@query("SELECT p_partkey, ['giá ' || p_name, 'còn ' || p_size] AS questions FROM part")
def sub_query_lists(spark, sf):
    t = F.concat(F.lit('Sure:\n["giá '), "p_name", F.lit('", " ", "còn '), F.col("p_size").cast("string"), F.lit('", "thêm"]'))
    return table(spark, sf, "part").select("p_partkey", records.sub_queries(t, 2).alias("questions"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 ELSE CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) END AS tokens FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", records.estimated_tokens(F.col("text"), F.col("doc_id") % 4).alias("tokens"))


@query("SELECT p_partkey, [p_size || '.000đ', p_size || ' triệu'] AS prices FROM part")
def locked_prices(spark, sf):
    s = F.col("p_size").cast("string")
    t = F.concat(F.lit("từ "), s, F.lit(".000đ đến "), s, F.lit(" triệu, mã 12, lại "), s, F.lit(".000đ"))
    return table(spark, sf, "part").select("p_partkey", records.price_strings(t).alias("prices"))


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'citation' WHEN d.doc_id % 4 = 1 THEN CASE WHEN length(d.text) >= 20 THEN 'quote' ELSE 'none' END WHEN d.doc_id % 4 = 2 THEN 'numbers' ELSE 'none' END AS kind FROM documents d WHERE text IS NOT NULL""")
def answer_grounding(spark, sf):
    """Answers with a mark, a run, the numbers, and nothing of their source."""
    k, t = F.col("doc_id"), F.col("text")
    answer = F.when(k % 4 == 0, F.lit("so [c-1]")).when(k % 4 == 1, F.substring(t, 1, 20)).when(k % 4 == 2, F.concat(F.lit("it is 77"), k.cast("string"))).otherwise("§§ no 9 §§")
    source = F.array(t, F.concat(F.lit("77"), k.cast("string")))
    kind = answers.grounded(answer, source)
    rows = table(spark, sf, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", kind.alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'wait' WHEN 2 THEN 'overlap' WHEN 3 THEN 'numbers' WHEN 4 THEN 'topic' ELSE 'safe' END AS verdict FROM part""")
def draft_verdicts(spark, sf):
    k = F.col("p_partkey")
    main = F.when(k % 6 == 1, "too short").otherwise(F.lit("the price of this one is exactly 1.500 in all shops we know of today"))
    draft = (
        F.when(k % 6 == 0, " ").when(k % 6 == 2, "something else was said here by a model that knew nothing")
        .when(k % 6 == 3, "the price of this one is exactly 1.500 in all shops we know of today 99").otherwise("the price of this one is exactly 1.500 in all shops")
    )
    cosine = F.when(k % 6 == 4, 0.1).otherwise(0.9)
    return table(spark, sf, "part").select("p_partkey", answers.verdict(draft, main, cosine).alias("verdict"))
