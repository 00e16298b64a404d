"""More queries of the catalogue: predicates, scalars, upserts, further ranking and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import numbers, text
from lakeloom.operators import chunking, dedup, evaluate, history, ranking, retrieval, scope, structured, tables
from lakeloom.plans.catalog import BM25, COS, DENSE, EDGES, W, _bm25, _dense, query
from lakeloom.plans.relations import BOTS, CHUNKS, ENTITIES, LEDGER, LOGS, bots, chunks, entities, ledger, request_logs, table, vectors

# ---- predicates and joins ----


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def live_document_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return scope.of_live_documents(chunks(spark, sf), d).select("chunk_id")


@query(f"WITH {ENTITIES} SELECT entity_id FROM entities WHERE brand = 'Brand#2' AND size = 12")
def metadata_containment(spark, sf):
    e = entities(spark, sf).withColumn("metadata", F.create_map(F.lit("brand"), "brand", F.lit("size"), F.col("size").cast("string")))
    return scope.metadata_contains(e, {"brand": "Brand#2", "size": "12"}).select("entity_id")


GRADED = f"{DENSE.format(k=10)}, gr AS (SELECT query_id, CASE WHEN chunk_id % 3 = 0 THEN 'relevant' WHEN chunk_id % 3 = 1 THEN 'ambiguous' ELSE 'irrelevant' END AS grade FROM dense)"


@query(f"WITH {GRADED} SELECT query_id, count(*) FILTER (grade = 'relevant') AS relevant, count(*) AS graded, count(*) FILTER (grade = 'relevant') >= 2 AND count(*) FILTER (grade = 'relevant') / count(*) >= 0.3 AS adequate FROM gr GROUP BY 1")
def retrieval_adequacy(spark, sf):
    i = F.col("chunk_id") % 3
    rows = _dense(spark, sf, 10).withColumn("grade", F.when(i == 0, "relevant").when(i == 1, "ambiguous").otherwise("irrelevant"))
    return ranking.adequacy(rows, 2, 0.3)


@query(f"WITH {GRADED} SELECT CASE WHEN grade = 'irrelevant' AND query_id % 100 = 0 THEN 'ambiguous' ELSE grade END AS grade, count(*) AS n FROM gr GROUP BY 1")
def lenient_grades(spark, sf):
    i = F.col("chunk_id") % 3
    rows = _dense(spark, sf, 10).withColumn("grade", F.when(i == 0, "relevant").when(i == 1, "ambiguous").otherwise("irrelevant")).withColumn("intent", F.when(F.col("query_id") % 100 == 0, "comparison").otherwise("factoid"))
    return rows.groupBy(ranking.lenient(F.col("grade"), F.col("intent"), ("comparison", "multi_hop")).alias("grade")).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT request_id, started_at FROM logs WHERE started_at < TIMESTAMP '2024-01-10' ORDER BY started_at DESC, request_id DESC LIMIT 26")
def keyset_page(spark, sf):
    return history.page_after(request_logs(spark, sf), "started_at", "request_id", "2024-01-10", 25).select("request_id", "started_at")


@query(f"WITH {BOTS} SELECT bot, slug FROM bots WHERE slug ILIKE '%stomer#00%1%' ORDER BY slug, bot LIMIT 20 OFFSET 5")
def search_page(spark, sf):
    return bots(spark, sf).where(F.ilike("slug", F.lit("%stomer#00%1%"))).orderBy("slug", "bot").offset(5).limit(20).select("bot", "slug")


@query(f"WITH {EDGES}, n AS (SELECT subject AS node FROM edges UNION SELECT object FROM edges), q AS (SELECT 1 AS query_id, 'asia' AS keyword UNION ALL SELECT 2, 's1' UNION ALL SELECT 1, 'nation_2') SELECT DISTINCT query_id, node FROM n JOIN q ON contains(lower(node), keyword)")
def graph_seeds(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    e = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("subject"), F.col("n_name").alias("object"))
    e = e.union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))
    return retrieval.mention_seeds(spark.createDataFrame([(1, "asia"), (2, "s1"), (1, "nation_2")], "query_id int, keyword string"), e)


@query(f"""WITH {ENTITIES}, k AS (SELECT entity_id, CAST(10000 + size AS VARCHAR) AS key, price_primary IS NOT NULL OR price_secondary IS NOT NULL AS priced FROM (SELECT * REPLACE (CASE WHEN entity_id % 2 = 0 THEN price_primary END AS price_primary, CASE WHEN entity_id % 2 = 0 THEN price_secondary END AS price_secondary) FROM entities)),
  a AS (SELECT key, min(entity_id) AS anchor_id FROM k WHERE priced GROUP BY 1) SELECT entity_id, anchor_id FROM k JOIN a USING (key) WHERE NOT priced""")
def entity_reconcile(spark, sf):
    even = F.col("entity_id") % 2 == 0
    e = entities(spark, sf).withColumn("price_primary", F.when(even, F.col("price_primary"))).withColumn("price_secondary", F.when(even, F.col("price_secondary"))).withColumn("code", F.concat(F.lit("sku "), (F.col("size") + 10000).cast("string")))
    return structured.reconcile(e, F.col("code"))


@query(f"""WITH {LEDGER} SELECT s_name AS supplier, n_name AS nation, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger JOIN supplier ON supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY ALL""")
def star_join(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").where("n_regionkey = 2")
    dims = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), "s_name", "n_name")
    rows = ledger(spark, sf).join(dims, "supplier")
    return rows.groupBy(F.col("s_name").alias("supplier"), F.col("n_name").alias("nation"), "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_purge(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("bot"))
    return dedup.purge({"orders": table(spark, sf, "orders").withColumn("bot", F.col("o_custkey"))}, gone)["orders"].select("o_orderkey")


@query("""WITH m AS (SELECT o_custkey AS k, o_orderdate AS seen_at, o_orderkey % 2 AS new, max(o_orderkey) AS v FROM orders GROUP BY 1, 2, 3) SELECT k, seen_at, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen_at DESC, new DESC) AS rn FROM m) WHERE rn = 1""")
def document_upsert(spark, sf):
    o = table(spark, sf, "orders").withColumn("seen_at", F.col("o_orderdate").cast("timestamp"))
    parts = [o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k"), "seen_at").agg(F.max("o_orderkey").alias("v")) for r in (0, 1)]
    return dedup.upsert(*parts, ["k"], "seen_at")


@query("SELECT DISTINCT o_custkey AS subject, o_orderpriority AS object FROM orders")
def insert_absent_edges(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), "o_orderkey")
    have = o.where("o_orderkey % 3 = 0").dropDuplicates(["subject", "object"]).drop("o_orderkey")
    return dedup.insert_absent(have, o.drop("o_orderkey"), ["subject", "object"])


@query(f"WITH {LOGS}, f AS (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 1 ELSE -1 END AS score, started_at AS created_at FROM logs WHERE request_id % 5 = 0 UNION ALL SELECT request_id, 2, started_at + INTERVAL 1 HOUR FROM logs WHERE request_id % 10 = 0), n AS (SELECT request_id, max_by(score, created_at) AS feedback_score FROM f GROUP BY 1) SELECT logs.request_id, feedback_score FROM logs LEFT JOIN n USING (request_id)")
def feedback_attach(spark, sf):
    logs = request_logs(spark, sf)
    a = logs.where("request_id % 5 = 0").select("request_id", F.when(F.col("request_id") % 2 == 0, 1).otherwise(-1).alias("score"), F.col("started_at").alias("created_at"))
    b = logs.where("request_id % 10 = 0").select("request_id", F.lit(2).alias("score"), (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return history.latest_feedback(logs, a.union(b)).select("request_id", "feedback_score")


@query("""WITH p AS (SELECT p_partkey AS rule_id, p_name AS pattern FROM part WHERE p_partkey % 150 < 100), t AS (SELECT p_partkey AS rule_id, p_brand AS pattern FROM part WHERE p_partkey % 150 >= 50) SELECT rule_id, coalesce(t.pattern, p.pattern) AS pattern FROM p FULL JOIN t USING (rule_id)""")
def rule_overlay(spark, sf):
    p = table(spark, sf, "part")
    rules = lambda some, name: p.where(some).select(F.col("p_partkey").alias("rule_id"), F.col(name).alias("pattern"))
    return dedup.overlay_rules(rules("p_partkey % 150 < 100", "p_name"), rules("p_partkey % 150 >= 50", "p_brand"))


@query("""SELECT c_custkey AS bot, coalesce(CASE WHEN c_custkey % 5 = 0 THEN '5' END, CASE WHEN c_custkey % 3 = 0 THEN '7' END, '9') AS top_k, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS layer FROM customer""")
def layered_config(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("bot"))
    layers = [c.withColumn("top_k", F.when(F.col("bot") % 5 == 0, 5)), c.withColumn("top_k", F.when(F.col("bot") % 3 == 0, 7)), c.withColumn("top_k", F.lit(9))]
    return history.resolve_layers(layers, "bot", "top_k")


@query(f"WITH {LOGS} SELECT channel, round(avg(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 6) AS hit_rate, last(status = 'success' ORDER BY started_at, request_id) AS latest FROM logs GROUP BY channel")
def cache_hit_rate(spark, sf):
    return history.latest_hit_rate(request_logs(spark, sf).withColumn("hit", F.col("status") == "success"), "channel", "hit", "started_at", "request_id")


@query("SELECT label AS entity, round(sqrt(sum(s * s)) / max(n), 6) AS coherence FROM (SELECT label, i, sum(v / l) AS s, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def centroid_coherence(spark, sf):
    return retrieval.coherence(vectors(spark, sf), "entity")


@query(f"WITH {LOGS} SELECT CAST(time_bucket(INTERVAL 1 DAY, started_at) AS TIMESTAMP) AS start, channel, count(DISTINCT bot) AS n_distinct, count(*) AS n FROM logs GROUP BY 1, 2")
def tumbling_distinct(spark, sf):
    from lakeloom.streaming.streams import tumbling_distinct as windowed

    w = windowed(request_logs(spark, sf), "bot", "channel", at="started_at", width="1 day", exact=True)
    return w.select(F.col("window.start").alias("start"), "channel", "n_distinct", "n")


# ---- ranking ----


@query(f"WITH {DENSE.format(k=10)}, b AS (SELECT query_id, chunk_id, round(score * CASE chunk_id % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 0.9 ELSE 1.0 END, 12) AS score FROM dense) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b")
def modality_boost(spark, sf):
    rows = _dense(spark, sf, 10).drop("rank").withColumn("kind", F.element_at(F.array(F.lit("table"), F.lit("image"), F.lit("text")), (F.col("chunk_id") % 3 + 1).cast("int")))
    return ranking.boost(rows, {"table": 1.2, "image": 0.9}).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {DENSE.format(k=10)}, s AS (SELECT query_id, CAST(rank % 3 AS INTEGER) AS stage, chunk_id, score FROM dense), t AS (SELECT query_id, stage, max(score) AS top FROM s GROUP BY 1, 2), p AS (SELECT query_id, coalesce(min(stage) FILTER (top >= 0.33), max(stage)) AS stage FROM t GROUP BY 1) SELECT s.* FROM s JOIN p USING (query_id, stage)")
def staged_fallback(spark, sf):
    return ranking.staged(_dense(spark, sf, 10).select("query_id", (F.col("rank") % 3).cast("int").alias("stage"), "chunk_id", "score"), 0.33)


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id // 20 * 5 + doc_id % 5 AS query_id, chunk_id, doc_id, chunk_index, content, CAST(row_number() OVER (PARTITION BY doc_id // 20 * 5 + doc_id % 5 ORDER BY doc_id) AS INTEGER) AS rank FROM chunks WHERE chunk_index = 2),
  w AS (SELECT query_id, doc_id, min(greatest(chunk_index - 1, 0)) AS lo, max(chunk_index + 1) AS hi FROM s GROUP BY 1, 2), a AS (SELECT w.query_id, c.chunk_id, c.doc_id, c.chunk_index, c.content, false AS seed, NULL AS rank FROM w JOIN chunks c ON w.doc_id = c.doc_id AND c.chunk_index BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = w.query_id AND s.chunk_id = c.chunk_id)),
  u AS (SELECT query_id, chunk_id, doc_id, chunk_index, content, true AS seed, rank FROM s UNION ALL SELECT * FROM a), v AS (SELECT *, row_number() OVER o AS place, sum(length(content) // 4) OVER (PARTITION BY query_id ORDER BY seed DESC, rank, doc_id, chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM u WINDOW o AS (PARTITION BY query_id ORDER BY seed DESC, rank, doc_id, chunk_index, chunk_id))
  SELECT query_id, chunk_id, seed, place FROM v WHERE seed OR used <= 600""")
def neighbour_expand(spark, sf):
    """Four seeds a query: the queries grow with the documents, not the seeds of a query."""
    c = chunks(spark, sf)
    own = Window.partitionBy("query_id").orderBy("doc_id")
    seeds = c.where("chunk_index = 2").withColumn("query_id", F.expr("doc_id DIV 20 * 5 + doc_id % 5")).withColumn("rank", F.row_number().over(own))
    return ranking.expand_neighbours(seeds, c, 1, 600).select("query_id", "chunk_id", "seed", "place")


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_index, 0.25 AS score FROM chunks WHERE contains(lower(content), 'license') OR contains(lower(content), 'ation') ORDER BY doc_id, chunk_index LIMIT 50")
def keyword_scan(spark, sf):
    return retrieval.keyword_scan(chunks(spark, sf), ["license", "Ation"], 50)


@query(f"WITH {BM25.format(k=10)}, b AS (SELECT query_id, chunk_id, score + CASE WHEN contains(lower(text), 'license') THEN 1.0 ELSE 0.0 END AS score FROM sparse JOIN documents ON doc_id = chunk_id) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b")
def phrase_boost(spark, sf):
    held = F.when(F.contains(F.lower("text"), F.lit("license")), "license").otherwise("")  # looked up where the texts are read, so no text is shuffled
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), held.alias("content"))
    out = retrieval.phrase_boost(_bm25(spark, sf, 10).drop("rank").join(d, "chunk_id"), "License")
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH q AS (SELECT * FROM embeddings), c AS (SELECT vec_id + 1 AS i, embedding FROM embeddings) SELECT q.vec_id, {COS} >= 0.1 AS kept FROM q JOIN c ON q.vec_id = c.i")
def speculative_keep(spark, sf):
    v = table(spark, sf, "embeddings")
    c = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return v.join(c, "vec_id").select("vec_id", (F.round(retrieval.cosine(F.col("embedding"), F.col("e2")), 9) >= 0.1).alias("kept"))


@query("SELECT doc_id % 20 AS answer_id, round(coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 1), 6) AS faithfulness FROM labels GROUP BY 1")
def faithfulness(spark, sf):
    return evaluate.faithfulness(table(spark, sf, "labels").select((F.col("doc_id") % 20).alias("answer_id"), (F.col("quality") == 1).alias("supported")))


@query("SELECT doc_id % 20 AS query_id, count(*) AS n, round(count(*) FILTER (toxic = 1) / count(*), 6) AS refusal_ratio FROM labels GROUP BY 1")
def refusal_ratio(spark, sf):
    return evaluate.refusal_ratio(table(spark, sf, "labels").select((F.col("doc_id") % 20).alias("query_id"), F.when(F.col("toxic") == 1, "refuse").otherwise("ok").alias("mark")))


# ---- texts ----


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT doc_id, translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY') AS plain FROM documents")
def strip_marks(spark, sf):
    return _docs(spark, sf).select("doc_id", text.strip_marks(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-zÀ-ÿ])-\n([A-Za-zÀ-ÿ])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def line_break_cleaning(spark, sf):
    return _docs(spark, sf).select("doc_id", text.clean_line_breaks(F.col("text")).alias("clean"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS total FROM d), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line, ' ')) AS k FROM e)
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (total <= 10 OR k < 3 OR trim(line, ' ') = '' OR length(trim(line, ' ')) >= 100), '') AS clean FROM c GROUP BY doc_id""")
def repeated_line_cleaning(spark, sf):
    return _docs(spark, sf).select("doc_id", text.drop_repeated_lines(F.col("text")).alias("clean"))


@query(f"WITH w AS (SELECT doc_id, {W.format('text')} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) ELSE [] END AS s FROM w) SELECT doc_id, len(list_intersect(s, ['of the', 'in the', 'and the'])) >= 2 AS leaks FROM s")
def leak_detector(spark, sf):
    return _docs(spark, sf).select("doc_id", text.leaks(F.col("text"), ["of the", "in the", "and the"], 2, 2).alias("leaks"))


@query(f"WITH w AS (SELECT doc_id, text, list_distinct({W.format('text')}) AS a, list_distinct({W.format(chr(39) + 'the of and' + chr(39))}) AS b FROM documents) SELECT doc_id, trim(text, ' ') = 'the of and' OR len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0) >= 0.05 AS refused FROM w")
def refusal_test(spark, sf):
    return _docs(spark, sf).where("text <> ''").select("doc_id", text.refused(F.col("text"), "the of and", 0.05).alias("refused"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')))) AS words FROM documents")
def keyword_extraction(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_sort(text.keywords(F.col("text"), ["the", "and"])).alias("words"))


@query(r"SELECT d.doc_id, r.rule_id FROM documents d JOIN (VALUES ('secret', '(?i)password\s*='), ('mail', '[a-z0-9.]+@[a-z0-9.]+'), ('digits', '[0-9]{12,}')) r(rule_id, pattern) ON regexp_matches(d.text, r.pattern)")
def guardrail_rules(spark, sf):
    rules = spark.createDataFrame([("secret", r"(?i)password\s*="), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("digits", "[0-9]{12,}")], "rule_id string, pattern string")
    return text.guardrail_hits(_docs(spark, sf).select("doc_id", "text"), rules).select("doc_id", "rule_id")


@query(r"SELECT doc_id, list_filter(regexp_extract_all(text, '\d[\d.,]*\d|\d'), lambda t: length(regexp_replace(t, '[^0-9]', '', 'g')) >= 4) AS numbers FROM documents")
def significant_numbers(spark, sf):
    return _docs(spark, sf).select("doc_id", numbers.significant(F.col("text")).alias("numbers"))


@query("SELECT p_partkey, CAST(p_partkey % 900 AS BIGINT) * 1000 + 1000000 AS a, CAST(p_partkey AS BIGINT) * 1000000 AS b, CAST(p_partkey AS BIGINT) * 1000 AS c FROM part")
def money_literals(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    a = numbers.money(F.concat(F.lit("giá 1tr"), F.lpad((k % 900).cast("string"), 3, "0"), F.lit(" nhé")))
    b = numbers.money(F.concat(k.cast("string"), F.lit(" triệu")))
    c = numbers.money(F.translate(F.format_number(k * 1000, 0), ",", "."))
    return p.select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"))


@query(f"WITH {LOGS} SELECT CASE WHEN duration_ms <= 500 THEN 'good' WHEN duration_ms <= 2000 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM logs GROUP BY 1")
def sla_bands(spark, sf):
    return request_logs(spark, sf).groupBy(numbers.band(F.col("duration_ms"), [(500, "good"), (2000, "fair")], "poor").alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {LOGS}, r AS (SELECT *, sum(total_tokens) OVER (PARTITION BY bot ORDER BY request_id) AS after FROM logs) SELECT bot, request_id FROM r WHERE after - total_tokens < 2000 AND after >= 2000")
def quota_depletion(spark, sf):
    own = Window.partitionBy("bot").orderBy("request_id")
    r = request_logs(spark, sf).withColumn("after", F.sum("total_tokens").over(own))
    return r.where(numbers.just_depleted(F.col("after") - F.col("total_tokens"), F.col("after"), F.lit(2000))).select("bot", "request_id")


@query("SELECT conv_id, min(turn) AS turn, lower(trim(text, ' ')) AS key FROM conversations GROUP BY conv_id, lower(trim(text, ' '))")
def distinct_preserving(spark, sf):
    out = dedup.distinct_preserving(table(spark, sf, "conversations"), "text", "conv_id", order="turn")
    return out.select("conv_id", "turn", F.lower(F.trim("text")).alias("key"))


# ---- chunks and tables ----


@query(f"""WITH {CHUNKS}, p AS (SELECT chunk_id, doc_id, CAST(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index) - length(content) - 1 AS BIGINT) AS s, CAST(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS BIGINT) AS e, CAST(sum(length(content) + 1) OVER (PARTITION BY doc_id) AS BIGINT) AS len FROM chunks),
  w AS (SELECT chunk_id, s, e, i * 400 AS ws, least(i * 400 + 500, len) AS we FROM (SELECT *, unnest(generate_series(0, CAST(greatest(ceil((len - 500) / 400.0), 0) AS BIGINT))) AS i FROM p))
  SELECT chunk_id, CAST(ws AS BIGINT) AS start, CAST(we AS BIGINT) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY greatest(least(e, we) - greatest(s, ws), 0) DESC, ws) AS rn FROM w) WHERE rn = 1""")
def late_chunk_windows(spark, sf):
    own = Window.partitionBy("doc_id").orderBy("chunk_index")
    c = chunks(spark, sf).withColumn("end", F.sum(F.length("content") + 1).over(own) - 1).withColumn("start", F.col("end") - F.length("content")).withColumn("doc_length", F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id")))
    return chunking.window_of(c, 500, 100)


@query(f"WITH {CHUNKS} SELECT chunk_id, coalesce(lag(content) OVER w, '') AS before, coalesce(lead(content) OVER w, '') AS after FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def context_buffer(spark, sf):
    return chunking.with_context(chunks(spark, sf)).select("chunk_id", "before", "after")


@query(f"WITH {CHUNKS}, m AS (SELECT *, CASE WHEN chunk_index % 3 = 0 THEN content END AS v FROM chunks) SELECT chunk_id, last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS content FROM m WHERE true")
def forward_fill(spark, sf):
    c = chunks(spark, sf).where("trim(content) <> ''")
    c = chunks(spark, sf).withColumn("content", F.when(F.col("chunk_index") % 3 == 0, F.col("content")).otherwise(F.lit(" ")))
    return chunking.forward_fill(c, "content", "doc_id", order="chunk_index").select("chunk_id", "content")


@query("SELECT p_partkey // 50 AS doc_id, p_partkey, p_name AS name, p_type AS category, CAST(p_retailprice * 1000 AS BIGINT) AS price FROM part")
def table_to_entities(spark, sf):
    row = F.concat(F.lit("\n| "), F.lpad("p_partkey", 9, "0"), F.lit(" | "), "p_name", F.lit(" | "), "p_type", F.lit(" | "), F.floor(F.round(F.col("p_retailprice") * 1000)).cast("string"), F.lit(" |"))
    p = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 50).cast("long").alias("doc_id")).agg(F.concat(F.lit("| Code | Name | Type | Price |\n|---|---|---|---|"), F.array_join(F.array_sort(F.collect_list(row)), "")).alias("text"))
    e = tables.entities(tables.pipe_rows(p))
    return e.select("doc_id", F.element_at("attributes", "Code").cast("long").alias("p_partkey"), "name", "category", F.col("price_primary").alias("price"))


@query()
def char_capped_context(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("n_chars"))
    return ranking.char_cap(_bm25(spark, sf, 10).join(d, "chunk_id"), 4000, size="n_chars").select("query_id", "chunk_id", "rank")


@query()
def cover_density_rank(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(retrieval.cover_density(["the", "of"], retrieval.terms(F.col("text"))), 9).alias("score"))


@query()
def tolerant_json(spark, sf):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", '"', "'"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", text.tolerant_json(broken).alias("parsed"))
