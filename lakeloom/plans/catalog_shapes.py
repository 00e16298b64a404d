"""Queries on shapes of texts, questions and cells, and on what answers claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import shapes
from lakeloom.plans.catalog import query
from lakeloom.plans.relations import table


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, list_filter(list_transform(string_split_regex(text, '[.!?](?:\s+|\z)'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents),
  c AS (SELECT doc_id, CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN 0 ELSE (least(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0) / 0.8::DOUBLE, 1) + least(coalesce(list_sum(list_transform(p, lambda s: length(s))) / nullif(len(p), 0), 0) / 200::DOUBLE, 1)) / 2 END AS c FROM w)
  SELECT doc_id, round(c, 9) AS complexity, CAST(round_even(1000 - c * 700, 0) AS INTEGER) AS size FROM c""")
def adaptive_sizes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", shapes.complexity(F.col("text")).alias("c"))
    return rows.select("doc_id", F.round("c", 9).alias("complexity"), shapes.adaptive_size(F.col("c")).alias("size"))


#: Turns with openings of several kinds by their number, and some without.
OPENED = """CASE (conv_id + turn) % 9 WHEN 0 THEN 'Hello ' || text WHEN 1 THEN text || ' why' WHEN 2 THEN 'cảm ơn, ' || text WHEN 3 THEN 'có Mấy ' || text WHEN 4 THEN 'A VS B: ' || text WHEN 5 THEN '  okay' WHEN 6 THEN 'history ' || text
  WHEN 7 THEN 'so sánh và giải thích ' || text ELSE text END"""
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p in shapes.INTENTS) + " END"


@query(rf"""WITH o AS (SELECT conv_id, turn, regexp_replace({OPENED}, '^\s+|\s+$', '', 'g') AS t FROM conversations), i AS (SELECT conv_id, turn, t, CASE WHEN t <> '' THEN {INTENT} END AS intent FROM o)
  SELECT conv_id, turn, intent, CASE WHEN intent IN ('greeting', 'chitchat') THEN 0.9 WHEN intent IS NOT NULL THEN 0.8 END AS confidence, contains(lower(t), 'mấy') OR contains(lower(t), 'so sánh') AS all_of FROM i""")
def question_intents(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(OPENED).alias("t"))
    return rows.select("conv_id", "turn", shapes.heuristic_intent(F.col("t")).alias("i"), shapes.asks_for_all(F.col("t"), ["mấy", "So sánh"]).alias("all_of")).select("conv_id", "turn", "i.intent", "i.confidence", "all_of")


#: Cells of many shapes, with the shape that each has.
CELLS = (
    ("p_name || ' ' || p_type", "name"), ("CAST(p_partkey AS STRING) || '-R16 ' || p_size || '/55'", "code"), ("'https://e.org/' || p_partkey", "url"), ("p_size || ',' || p_size || ',' || p_size || ',a'", "list"), ("CAST(p_size + 100 AS STRING) || 'k'", "money"),
    ("'  '", "empty"), ("'a; b; c; d'", "list"), ("'Gói ' || p_size || ' triệu nhé'", "name"), ("'X'", "token"), ("'1tr' || (p_size + 100)", "money"),
)


@query(f"""WITH c AS (SELECT p_partkey, CASE p_partkey % {len(CELLS)} {' '.join(f'WHEN {i} THEN {e}' for i, (e, _) in enumerate(CELLS))} END AS cell, CASE p_partkey % {len(CELLS)} {' '.join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(CELLS))} END AS shape FROM part)
  SELECT p_partkey, shape, CASE WHEN shape = 'name' AND 1000 + 10 * len(regexp_extract_all(cell, '\\p{{L}}{{2,}}')) + length(cell) > 1000 + 10 * 2 + 14 THEN cell ELSE 'BrandX product' END AS name FROM c""")
def cell_shapes(spark, sf):
    cell = F.expr(f"CASE p_partkey % {len(CELLS)} {' '.join(f'WHEN {i} THEN {e}' for i, (e, _) in enumerate(CELLS))} END")
    rows = table(spark, sf, "part").select("p_partkey", cell.alias("cell"))
    return rows.select("p_partkey", shapes.cell_shape(F.col("cell")).alias("shape"), shapes.descriptive_name(F.array(F.lit("2-R16"), F.lit("BrandX product"), F.lit(None), "cell")).alias("name"))


#: For each size of part, the parts of that size and a question that names words of its first part and others.
@query(r"""WITH RECURSIVE q AS (SELECT p_size AS query_id, 'what costs ' || arg_min(p_type, p_partkey) || ' or ' || arg_min(p_brand, p_partkey) || ' now' AS query FROM part GROUP BY p_size),
  w AS (SELECT query_id, list_distinct_kept AS w FROM (SELECT query_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_kept FROM (SELECT query_id, regexp_extract_all(lower(query), '\p{L}{3,}') AS t FROM q))),
  c AS (SELECT p_size AS query_id, p_partkey AS candidate_id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS text FROM part),
  r AS (SELECT query_id, candidate_id, 0 AS k FROM c UNION ALL SELECT query_id, candidate_id, k FROM (
    SELECT r.query_id, r.candidate_id, r.k + 1 AS k, contains(c.text, w.w[r.k + 1]) AS has, count(*) FILTER (contains(c.text, w.w[r.k + 1])) OVER (PARTITION BY r.query_id) AS n, count(*) OVER (PARTITION BY r.query_id) AS m
    FROM r JOIN c ON r.query_id = c.query_id AND r.candidate_id = c.candidate_id JOIN w ON w.query_id = r.query_id WHERE r.k < len(w.w)) WHERE has OR n = 0)
  SELECT r.query_id, candidate_id FROM r JOIN w USING (query_id) WHERE k = len(w)""")
def discriminated_candidates(spark, sf):
    p = table(spark, sf, "part")
    first = lambda c: F.min_by(c, "p_partkey")
    q = p.groupBy("p_size").agg(F.concat(F.lit("what costs "), first("p_type"), F.lit(" or "), first("p_brand"), F.lit(" now")).alias("query"))
    rows = p.join(q, "p_size").select(F.col("p_size").alias("query_id"), "query", F.col("p_partkey").alias("candidate_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return shapes.discriminated(rows).select("query_id", "candidate_id")


#: Answers with triples in JSON: fenced, bare, within prose, broken, with empty or equal ends.
ANSWER = """CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || '[{"subject": " u' || user_id || ' ", "relation": "did", "object": "' || event_type || '"}]' || chr(10) || '```' WHEN 1 THEN '[{"subject": "a", "relation": "r", "object": "A"}, {"subject": "b", "relation": "", "object": "c"}]'
  WHEN 2 THEN 'Here: [{"subject": "x", "relation": "r", "object": "' || event_type || '"}, {"subject": "y", "relation": "s", "object": "z"}] done' WHEN 3 THEN '[{"subject": broken' WHEN 4 THEN 'none' ELSE NULL END"""


@query("""SELECT event_id, 'u' || user_id AS subject, 'did' AS relation, event_type AS object FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 'x', 'r', event_type FROM events WHERE event_id % 6 = 2 UNION ALL SELECT event_id, 'y', 's', 'z' FROM events WHERE event_id % 6 = 2""")
def answer_triples(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(ANSWER).alias("a"))
    return rows.select("event_id", F.explode(shapes.triples(F.col("a"))).alias("t")).select("event_id", "t.*")


DENIAL = "CASE p_partkey % 4 WHEN 0 THEN 'Dạ bên em CHƯA phân phối hãng ' || p_brand || ' ạ' WHEN 1 THEN 'we do not carry the Other or ' || p_brand || ' line' WHEN 2 THEN 'yes we have ' || p_brand ELSE 'chưa phân phối hãng 205 nào' END"


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN regexp_extract(p_brand, '[A-Z][A-Za-z0-9]{2,}') WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN regexp_extract(p_brand, '[A-Z][A-Za-z0-9]{2,}') ELSE 'Other' END END AS denied FROM part""")
def denied_brands(spark, sf):
    question = F.when(F.col("p_partkey") % 8 == 1, F.concat(F.lit("any "), F.lower("p_brand"))).otherwise(F.lit("")).alias("q")
    rows = table(spark, sf, "part").select("p_partkey", F.expr(DENIAL).alias("a"), question)
    return rows.select("p_partkey", shapes.denied_brand(F.col("a"), F.col("q"), ["", "chưa phân phối hãng", "do not carry"]).alias("denied"))


@query()
def quality_gate(spark, sf):
    return shapes.quality_gate(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "quality", "passed")
