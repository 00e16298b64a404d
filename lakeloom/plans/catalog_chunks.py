"""Queries on table regions, blocks that stay whole, places of chunks, topics by vectors and measures of cohesion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import char_ngrams
from lakeloom.operators import blocks, cohesion, firstcome, regions
from lakeloom.plans.catalog import query
from lakeloom.plans.relations import relined, table

# ---- table regions ----

#: A customer's sheet: prose, a table, prose, a table of another width; some with stray commas, blank lines, tables of one row, no header.
SHEET_PARTS = (
    ("1", "'Orders of ' || c_name || ' as they are kept in the ledger of the year'"),
    ("2", "CASE WHEN c_custkey % 3 = 0 THEN 'note: see the other sheet,,,' END"),
    ("3", "CASE WHEN c_custkey % 4 = 1 THEN '' END"),
    ("4", "CASE WHEN c_custkey % 5 <> 2 THEN 'order,status,priority' END"),
    ("6", "CASE WHEN c_custkey % 7 = 3 THEN 'short' ELSE 'The following table lists the same orders by customer.' END"),
    ("8", "CASE WHEN c_custkey % 2 = 1 THEN 'All entries are subject to change without notice.' END"),
)


def sheets(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    flat = [c.select(F.col("c_custkey").alias("doc_id"), F.lit(int(p)).alias("p"), F.lit(0).cast("long").alias("k"), F.expr(e).alias("line")) for p, e in SHEET_PARTS]
    key, status, rank = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    some = o
    first = some.select(F.col("o_custkey").alias("doc_id"), F.lit(5).alias("p"), F.col("o_orderkey").alias("k"), F.concat_ws(",", key, status, rank).alias("line"))
    second = some.select(F.col("o_custkey").alias("doc_id"), F.lit(7).alias("p"), F.col("o_orderkey").alias("k"), F.concat_ws(",", key, F.col("o_custkey").cast("string"), F.lit(""), rank).alias("line"))
    rows = first.unionByName(second)
    for f in flat:
        rows = rows.unionByName(f)
    lines = F.array_sort(F.collect_list(F.struct("p", "k", "line")))
    return rows.where("line IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


SHEETS = (
    "lines_of AS ("
    + " UNION ALL ".join(f"SELECT c_custkey AS doc_id, {p} AS p, 0 AS k, {e} AS line FROM customer" for p, e in SHEET_PARTS)
    + """ UNION ALL SELECT o_custkey, 5, o_orderkey, o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority FROM orders
    UNION ALL SELECT o_custkey, 7, o_orderkey, o_orderkey || ',' || o_custkey || ',,' || o_orderpriority FROM orders),
  sheets AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p, k) AS text FROM lines_of WHERE line IS NOT NULL GROUP BY doc_id)"""
)
ISLANDS = r"""raw AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) AS line,
    generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> ''), 1) - 1 AS i FROM sheets),
  shaped AS (SELECT *, CASE WHEN len(string_split(line, ',')) >= 2 AND len(list_filter(string_split(line, ','), lambda x: trim(x) <> '')) >= 2 THEN len(string_split(line, ',')) END AS shape FROM raw),
  marked AS (SELECT *, CASE WHEN shape IS NULL OR shape IS DISTINCT FROM lag(shape) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM shaped),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
  inside AS (SELECT *, shape IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, island) >= 2 AS is_in FROM islands),
  firsts AS (SELECT *, CASE WHEN is_in AND island IS DISTINCT FROM lag(island) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS opens FROM inside),
  heads AS (SELECT doc_id, arg_min(line, i) AS header FROM shaped WHERE shape IS NOT NULL GROUP BY doc_id),
  placed AS (SELECT doc_id, i, line, is_in, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, header FROM firsts JOIN heads USING (doc_id)),
  data AS (SELECT doc_id, n AS region, CAST(row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS INTEGER) AS row, header, line FROM placed
    WHERE is_in AND line <> header AND regexp_replace(line, '[,\s]', '', 'g') <> '')"""
#: Groups by recursion over the rows: a group's letters so far, its number, and how many rows it has.
GROUPS = """packed AS (SELECT doc_id, region, row, 0 AS part, length(header) + length(line) + 1 AS used FROM data WHERE row = 1
  UNION ALL SELECT d.doc_id, d.region, d.row, CASE WHEN used + length(line) + 1 > {most} THEN part + 1 ELSE part END,
    CASE WHEN used + length(line) + 1 > {most} THEN length(header) ELSE used END + length(line) + 1
    FROM packed p JOIN data d ON d.doc_id = p.doc_id AND d.region = p.region AND d.row = p.row + 1),
  sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, region, part) AS n, max(part) OVER (PARTITION BY doc_id, region) AS last FROM packed),
  dealt AS (SELECT doc_id, region, row, CAST(CASE WHEN part = last AND n = 1 AND part > 0 THEN part - 1 ELSE part END AS INTEGER) AS part FROM sized)"""
MOST = 200


@query(f"""WITH RECURSIVE {SHEETS}, {ISLANDS}, {GROUPS.format(most=MOST)} SELECT doc_id, region, row, part, header || chr(10) || line AS content FROM data JOIN dealt USING (doc_id, region, row)""")
def table_row_chunks(spark, sf):
    rows = regions.data_rows(regions.table_lines(sheets(spark, sf)))
    groups = regions.group_chunks(rows, MOST).select("doc_id", "region", "part", "first_row", "last_row")
    one = regions.row_chunks(rows)
    return one.join(groups, ["doc_id", "region"]).where("row BETWEEN first_row AND last_row").select("doc_id", "region", "row", "part", "content")


@query(f"""WITH RECURSIVE {SHEETS}, {ISLANDS}, {GROUPS.format(most=MOST)} SELECT doc_id, region, part, min(row) AS first_row, max(row) AS last_row,
  any_value(header) || chr(10) || string_agg(line, chr(10) ORDER BY row) AS content FROM data JOIN dealt USING (doc_id, region, row) GROUP BY doc_id, region, part""")
def table_group_chunks(spark, sf):
    return regions.group_chunks(regions.data_rows(regions.table_lines(sheets(spark, sf))), MOST)


@query(f"""WITH {SHEETS}, {ISLANDS}, said AS (SELECT doc_id, n AS gap, string_agg(line, chr(10) ORDER BY i) AS said, max(length(line)) AS longest FROM placed WHERE NOT is_in GROUP BY doc_id, n),
  counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, region) AS n FROM data),
  ends AS (SELECT doc_id, region, any_value(header) AS header, string_agg(line, chr(10) ORDER BY row) FILTER (row <= 3) AS head, string_agg(line, chr(10) ORDER BY row) FILTER (row > n - 3) AS tail FROM counted GROUP BY doc_id, region),
  sides AS (SELECT e.doc_id, region, 'before' AS kind, said || chr(10) || header || chr(10) || head AS content FROM ends e JOIN said s ON e.doc_id = s.doc_id AND gap = region - 1 AND longest > 30
    UNION ALL SELECT e.doc_id, region, 'after', header || chr(10) || tail || chr(10) || said FROM ends e JOIN said s ON e.doc_id = s.doc_id AND gap = region AND longest > 30)
  SELECT * FROM sides WHERE length(content) <= 1500""")
def table_surroundings(spark, sf):
    return regions.surroundings(sheets(spark, sf))


# ---- blocks that stay whole ----

#: Documents whose lines are dressed as formulas, pictures, tables and code by their number.
DRESS = """CASE ({i} + doc_id) % 9 WHEN 1 THEN '$$ ' || {x} || ' $$' WHEN 2 THEN '![' || left({x}, 20) || '](p.png) ' || {x} WHEN 3 THEN '| a | ' || {x} || ' |' WHEN 4 THEN '```' || chr(10) || {x} || chr(10) || '$$' || chr(10) || '```'
  WHEN 5 THEN '$$' || chr(10) || {x} || chr(10) || '  $$' WHEN 6 THEN '| b | ' || {x} || ' |' WHEN 7 THEN '$x_1$' ELSE {x} END"""


def dressed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    lines = docs.select("doc_id", "i", F.expr(DRESS.format(i="i", x="x")).alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


DRESSED = f"""dressed AS (SELECT doc_id, string_agg({DRESS.format(i='i', x='x')}, chr(10) ORDER BY i) AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id)"""


@query(r"""WITH DRESSED, ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM dressed),
  f AS (SELECT *, trim(regexp_replace(line, '\s', ' ', 'g')) AS bare FROM ls), f2 AS (SELECT *, CAST(bare LIKE '```%' AS INTEGER) AS fence FROM f),
  f3 AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM f2), f4 AS (SELECT *, fences % 2 = 1 OR fence = 1 AS code FROM f3),
  f5 AS (SELECT *, CASE WHEN NOT code AND bare = '$$' THEN 1 ELSE 0 END AS dollar FROM f4), f6 AS (SELECT *, sum(dollar) OVER (PARTITION BY doc_id ORDER BY i) AS dollars FROM f5),
  f7 AS (SELECT *, dollars % 2 = 1 OR dollar = 1 AS formula FROM f6),
  k AS (SELECT *, CASE WHEN code THEN 'code' WHEN formula OR regexp_matches(line, '^\s*(\$\$[^\n]+\$\$|\$[^$\n]+\$)\s*$') THEN 'formula' WHEN regexp_matches(line, '!\[[^\]]*\]\([^)]+\)') THEN 'image'
    WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' ELSE 'text' END AS kind, CASE WHEN code THEN ceil(fences / 2) WHEN formula THEN -ceil(dollars / 2) ELSE 0 END AS run FROM f7),
  n AS (SELECT *, CASE WHEN kind = lag(kind) OVER o AND run = lag(run) OVER o THEN 0 ELSE 1 END AS fresh FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS block FROM n),
  c AS (SELECT doc_id, block, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY i) AS content FROM b GROUP BY doc_id, block),
  s AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
  p AS (SELECT doc_id, block, kind, start, CASE WHEN kind = 'text' THEN regexp_extract_all(content, '(?s).{1,999}(?:\s|\z)|.{1,1000}') ELSE [content] END AS parts FROM s),
  u AS (SELECT doc_id, block, kind, start, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS part FROM p)
  SELECT doc_id, block, CAST(part AS INTEGER) AS part, kind, CAST(start + coalesce(sum(length(content)) OVER (PARTITION BY doc_id, block ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, content FROM u""".replace("DRESSED", DRESSED))
def atomic_chunks(spark, sf):
    return blocks.atomic_chunks(dressed(spark, sf)).withColumn("start", F.col("start").cast("long"))


def _trimmed_chunks(spark, sf):
    """The whole chunks, their white space changed, every eleventh missing and every thirteenth foreign."""
    c = blocks.atomic_chunks(dressed(spark, sf))
    n = F.col("block") * 100 + F.col("part")
    text = F.when(n % 13 == 5, "no such text").otherwise(F.regexp_replace("content", r"\s+", "\n "))
    return c.where(n % 11 != 3).select("doc_id", n.alias("chunk_index"), text.alias("content"))


@query()
def located_chunks(spark, sf):
    return blocks.located(_trimmed_chunks(spark, sf), dressed(spark, sf))


@query()
def chunk_gaps(spark, sf):
    docs = dressed(spark, sf)
    return blocks.missed(blocks.located(_trimmed_chunks(spark, sf), docs), docs)


# ---- topics by vectors, cohesion ----


def _sentence_key(n):
    return lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long") % n


def _sentence_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("key"), "embedding"), v.count()


SENTENCES = r"""sen AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)),
  vec AS (SELECT sen.*, embedding FROM sen LEFT JOIN embeddings ON vec_id = ('0x' || left(md5(sentence), 8))::BIGINT % (SELECT count(*) FROM embeddings))"""
COSINE = "coalesce(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 0)"


@query(rf"""WITH {SENTENCES}, cuts AS (SELECT *, lag(embedding) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM vec),
  topics AS (SELECT doc_id, i, sentence, CAST(sum(CASE WHEN i > 0 AND {COSINE.format(a='before', b='embedding')} < 0.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS topic FROM cuts),
  texts AS (SELECT doc_id, topic, string_agg(sentence, ' ' ORDER BY i) AS text FROM topics GROUP BY doc_id, topic),
  parts AS (SELECT doc_id, topic, list_filter(list_transform(regexp_extract_all(text, '(?s).{{1,599}}(?:\s|\z)|.{{1,600}}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM texts)
  SELECT doc_id, topic, unnest(p) AS content, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part FROM parts""")
def vector_topic_chunks(spark, sf):
    v, n = _sentence_vectors(spark, sf)
    return cohesion.vector_topics(table(spark, sf, "documents"), v, _sentence_key(n), 0.0, 600)


@query(rf"""WITH {SENTENCES}, pairs AS (SELECT a.doc_id, {COSINE.format(a='a.embedding', b='b.embedding')} AS c, CAST(length(a.sentence) * length(b.sentence) AS DOUBLE) AS w FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 3)
  SELECT d.doc_id, CASE WHEN w > 0 THEN round(greatest(0, least(1, 1 - s / w)), 9) END AS dissimilarity FROM (SELECT DISTINCT doc_id FROM sen) d LEFT JOIN (SELECT doc_id, sum(c * w) AS s, sum(w) AS w FROM pairs GROUP BY doc_id) USING (doc_id)""")
def windowed_dissimilarity(spark, sf):
    v, n = _sentence_vectors(spark, sf)
    flat = table(spark, sf, "documents").select("doc_id", F.posexplode(cohesion.sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    rows = flat.withColumn("key", _sentence_key(n)(F.col("sentence"))).join(v, "key", "left")
    return cohesion.dissimilarity(rows.select("doc_id", "i", F.length("sentence").alias("length"), "embedding"))


#: Documents whose lines get references and blank lines between them by their number.
REFER = """CASE i % 5 WHEN 0 THEN x || ' see section ' || i % 3 WHEN 1 THEN 'Figure ' || i % 7 || ' ' || x || ' figure ' || i % 7 WHEN 2 THEN x || ' [ref 4] and (see below)' ELSE x END || CASE WHEN i % 3 = 2 THEN chr(10) ELSE '' END"""
MEASURES = r"""refs AS (SELECT doc_id, string_agg(REFER, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id),
  bl AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM refs),
  blocks AS (SELECT doc_id, unnest(p) AS block, generate_subscripts(p, 1) AS b FROM (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM bl)),
  sets AS (SELECT doc_id, b, i, list_distinct(list_filter(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2)) AS t FROM (SELECT doc_id, b, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, b, list_filter(list_transform(string_split(regexp_replace(block, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM blocks))),
  icc AS (SELECT x.doc_id, avg(coalesce(len(list_intersect(x.t, y.t)) / nullif(len(list_distinct(x.t || y.t)), 0), 0)) AS icc FROM sets x JOIN sets y ON x.doc_id = y.doc_id AND x.b = y.b AND y.i = x.i + 1 GROUP BY x.doc_id),
  toks AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2) AS p FROM refs)),
  gist AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM toks GROUP BY doc_id, t) WHERE r <= 50),
  bt AS (SELECT DISTINCT doc_id, b, unnest(list_filter(regexp_extract_all(lower(block), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2)) AS t FROM blocks),
  dcc AS (SELECT doc_id, avg(c / n) AS dcc FROM (SELECT bt.doc_id, b, count(gist.t) AS c FROM bt LEFT JOIN gist ON bt.doc_id = gist.doc_id AND bt.t = gist.t GROUP BY bt.doc_id, b) JOIN (SELECT doc_id, count(*) AS n FROM gist GROUP BY doc_id) USING (doc_id) GROUP BY doc_id),
  marks AS (SELECT doc_id, unnest(m) AS m, generate_subscripts(m, 1) AS k FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)\b(?:see|cf\.|xem|tham\s+khảo)\s+(?:section|mục|chapter|chương)\s+\d') || regexp_extract_all(text, '(?i)\b(?:figure|hình|table|bảng|equation|công\s+thức)\s+\d+')
    || regexp_extract_all(text, '(?i)\[(?:ref|reference|tham\s+chiếu)?\s*\d+\]') || regexp_extract_all(text, '(?i)\((?:see|xem)\s+\w+\)'), lambda x: lower(trim(x))) AS m FROM refs)),
  rc AS (SELECT doc_id, avg(kept) AS rc FROM (SELECT doc_id, k, max(CASE WHEN length(lower(block)) - length(replace(lower(block), m, '')) >= 2 * length(m) THEN 1 ELSE 0 END) AS kept FROM marks JOIN blocks USING (doc_id) GROUP BY doc_id, k) GROUP BY doc_id),
  bi AS (SELECT doc_id, avg(CASE WHEN length(block) <= 1024 THEN 1 ELSE 0 END) AS bi FROM blocks GROUP BY doc_id),
  sc AS (SELECT doc_id, CASE WHEN n > 0 THEN (n - CASE WHEN r > 0 AND (r < 512 OR r > 2048) THEN 1 ELSE 0 END) / n ELSE 1 END AS sc FROM (SELECT doc_id, ceil(length(text) / 1024) AS n, length(text) % 1024 AS r FROM refs)),
  m AS (SELECT doc_id, round(coalesce(rc, 1), 9) AS rc, round(coalesce(icc, 1), 9) AS icc, round(coalesce(dcc, 1), 9) AS dcc, round(bi, 9) AS bi, round(sc, 9) AS sc FROM sc JOIN bi USING (doc_id) LEFT JOIN rc USING (doc_id) LEFT JOIN icc USING (doc_id) LEFT JOIN dcc USING (doc_id))
  SELECT *, CASE WHEN bi < 0.6 THEN 'semantic' WHEN rc > 0.8 THEN 'proposition' WHEN dcc < 0.5 THEN 'semantic' WHEN sc < 0.7 THEN 'recursive' ELSE 'hybrid' END AS strategy,
    round(CASE WHEN bi < 0.6 THEN bi WHEN rc > 0.8 THEN rc WHEN dcc < 0.5 THEN 1 - dcc WHEN sc < 0.7 THEN sc ELSE 0.8 END, 9) AS sure,
    CASE WHEN bi < 0.6 THEN 'bi' WHEN rc > 0.8 THEN 'rc' WHEN dcc < 0.5 THEN 'dcc' WHEN sc < 0.7 THEN 'sc' ELSE 'balanced' END AS why FROM m"""


def referring(spark, sf):
    return relined(spark, sf, REFER)


@query("WITH " + MEASURES.replace("REFER", REFER))
def intrinsic_metrics(spark, sf):
    return cohesion.choose(cohesion.measures(referring(spark, sf)))


# ---- the first of its like ----


@query()
def first_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), "embedding")
    return firstcome.first_of_alike_vectors(v, 0.6)


@query()
def leader_clusters(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), "embedding")
    return firstcome.leader_clusters(v, 0.5)


@query()
def first_turns(spark, sf):
    """Conversation turns of a role without those like an earlier one."""
    t = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("role").alias("grp"), char_ngrams(F.lower(F.col("text")), 3).alias("grams"))
    return firstcome.first_of_alike_sets(t, 0.85).select("id.conv_id", "id.turn")
