"""Queries on vocabulary, compression and superlatives, on streams with states, and on readers as Spark surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import language
from lakeloom.plans.catalog import query
from lakeloom.plans.relations import relined, table
from lakeloom.sources import surface
from lakeloom.sources.shared import new_path
from lakeloom.streaming import stateful

# ---- vocabulary ----

PHRASES = r"""trimmed AS (SELECT side, id, text, list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g'), '\s+'), lambda t: trim(t, '.,!?;:''"()[]{}/\')) AS t
    FROM (SELECT 'q' AS side, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'v', item_id, text FROM benchmark) WHERE trim(coalesce(text, '')) <> ''),
  runs AS (SELECT side, id, i - 1 AS at_word, n, t[i:i + n - 1] AS w, t[greatest(i - 2, 1):i - 1] AS before FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM trimmed), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(t)),
  grams AS (SELECT side, id, at_word, n, array_to_string(w, ' ') AS phrase, before FROM runs WHERE NOT list_contains(w, '')),
  vocabulary AS (SELECT DISTINCT phrase, [upper(phrase) || '!', 'about $ ' || phrase] AS expansions, CASE WHEN length(phrase) % 2 = 0 THEN 'generic' ELSE 'bot_custom' END AS source FROM grams
    WHERE side = 'v' AND ('0x' || left(md5(phrase), 2))::BIGINT % 3 <> 0),
  met AS (SELECT id, phrase, min(at_word) AS at_word, any_value(n) AS n, any_value(source) AS source, any_value(expansions) AS expansions FROM grams JOIN vocabulary USING (phrase)
    WHERE side = 'q' AND (n = 1 OR NOT list_has_any(before, ['in', 'the', 'de'])) GROUP BY id, phrase),
  matches AS (SELECT id AS query_id, CAST(row_number() OVER (PARTITION BY id ORDER BY n, at_word, phrase) AS INTEGER) AS place, CAST(at_word AS INTEGER) AS "at", CAST(n AS INTEGER) AS n, phrase, source, expansions FROM met QUALIFY place <= 10)"""


#: Letters with one capital, though their upper case by full mapping has several.
ONE_SMALL = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and c.title() != c and len(c.title()) == 1)
ONE_LARGE = "ẞ" + "".join(c.title() for c in ONE_SMALL[1:])


def _asked(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text").where("trim(coalesce(text, '')) <> ''")


def _upper(text):
    """Upper case letter by letter, as the SQL has it: a letter that Spark would spell out in several, such as ß, becomes its one capital or stays."""
    one = F.translate(text, ONE_SMALL, ONE_LARGE)
    return F.array_join(F.transform(F.split(one, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def _vocabulary(spark, sf):
    some = language.phrases(table(spark, sf, "benchmark").select("item_id", "text"), "item_id").select("phrase").distinct()
    code = F.conv(F.substring(F.md5(F.col("phrase").cast("binary")), 1, 2), 16, 10).cast("int")
    source = F.when(F.length("phrase") % 2 == 0, "generic").otherwise("bot_custom")
    return some.where(code % 3 != 0).select("phrase", source.alias("source"), F.array(F.concat(_upper("phrase"), F.lit("!")), F.concat(F.lit("about $ "), "phrase")).alias("expansions"))


NEGATIONS = ["in", "the", "de"]


@query(f'WITH {PHRASES} SELECT query_id, place, "at", n, phrase, source, array_to_string(expansions, \'|\') AS expansions FROM matches')
def vocabulary_matches(spark, sf):
    return language.vocabulary_matches(_asked(spark, sf), _vocabulary(spark, sf), NEGATIONS).withColumn("expansions", F.array_join("expansions", "|"))


@query()
def vocabulary_variants(spark, sf):
    asked = _asked(spark, sf)
    return language.vocabulary_variants(asked, language.vocabulary_matches(asked, _vocabulary(spark, sf), NEGATIONS))


# ---- compression ----

STOPWORDS = ["the", "of", "to", "in", "de", "la", "und", "die", "is", "as"]
NO = ["not", "no", "nicht", "ne", "on"]
#: Documents with markdown, links and boilerplate in their lines by number.
MARKED = """CASE i % 6 WHEN 1 THEN '## **' || x || '**' WHEN 2 THEN '[' || x || '](https://e.org/' || i || ')' WHEN 3 THEN 'Page ' || i || ' of 9' WHEN 4 THEN x || '   costs 20% of $' || i || '  ' ELSE x END"""


def marked(spark, sf):
    return relined(spark, sf, MARKED)


TIDY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
COMPRESSED = (
    r"""marked AS (SELECT doc_id, string_agg(MARKED, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id),
  t1 AS (SELECT doc_id, regexp_replace(TIDY1, '(?m)^Page \d+ of \d+$', '', 'g') AS t FROM marked), t2 AS (SELECT doc_id, TIDY2 AS t FROM t1),
  t3 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\[([^\]]*)\]\([^\)]*\)', '\1', 'g'), '\*{1,3}|_{1,3}|~{2}', '', 'g'), '(?m)^#{1,6}\s+', '', 'g') AS t FROM t2), bare AS (SELECT doc_id, TIDY2 AS text FROM t3),
  parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])\s+|\n+', '\1' || chr(1), 'g'), chr(1) || '+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM bare WHERE length(text) > 500),
  sen AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM parts),
  w AS (SELECT *, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') AS w FROM sen),
  sc AS (SELECT *, round(CASE WHEN len(w) = 0 THEN 0 ELSE least(1.0, len(list_filter(w, lambda x: length(x) > 1 AND NOT list_contains(STOPWORDS, x))) / len(w)
    + CASE WHEN regexp_matches(s, '\d') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(s, '(?i)[$€₫]|\bVND\b|\bUSD\b|\btriệu\b|\btỷ\b|\bnghìn\b') THEN 0.15 ELSE 0 END
    + CASE WHEN regexp_matches(s, '\d{1,2}[/.\-]\d{1,2}|\d{4}') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(s, '\d+\s*%') THEN 0.1 ELSE 0 END + CASE WHEN list_has_any(w, NOWORDS) THEN 0.2 ELSE 0 END) END, 9) AS score FROM w),
  m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(CAST(score >= 0.6 AS INTEGER)) OVER (PARTITION BY doc_id) AS good, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM sc),
  kept AS (SELECT * FROM m WHERE CASE WHEN n = 1 THEN true WHEN good = 1 THEN score >= 0.6 ELSE r <= greatest(1, n // 2) END),
  un AS (SELECT *, coalesce(sum(CAST(regexp_matches(s, '[.!?;]$') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM kept),
  units AS (SELECT doc_id, u, string_agg(s, ' ' ORDER BY i) AS s FROM un GROUP BY doc_id, u),
  used AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY u) - 1 AS used, row_number() OVER (PARTITION BY doc_id ORDER BY u) AS k FROM units)
  SELECT doc_id, text FROM bare WHERE length(text) <= 500 UNION ALL
  SELECT doc_id, string_agg(CASE WHEN used > 500 THEN substring(s, 1, 500) ELSE s END, ' ' ORDER BY u) FROM used WHERE used <= 500 OR k = 1 GROUP BY doc_id"""
    .replace("MARKED", MARKED).replace("TIDY1", TIDY.format("text")).replace("TIDY2", TIDY.format("t")).replace("STOPWORDS", str(STOPWORDS)).replace("NOWORDS", str(NO))
)


@query("WITH " + COMPRESSED)
def compressed_texts(spark, sf):
    return language.compressed(marked(spark, sf), "doc_id", STOPWORDS, NO, least=0.6, boilerplate=[r"(?m)^Page \d+ of \d+$"])


# ---- superlatives ----

#: Price lists of twenty parts each, written in several forms; some with durations, discounts, bonuses, a name twice, or no price at all.
OFFER = """CASE p_partkey % 8 WHEN 0 THEN p_name || ' kit: ' || {price} || 'đ' WHEN 1 THEN p_name || ' set: ' || {price} || ' VND, giảm ' || p_size || '%' WHEN 2 THEN p_name || ' box: ' || {price} || ', tặng ' || p_size % 9 || ' quà'
  WHEN 3 THEN p_name || ' kit: ' || {price} || 'đ. ' || p_name || ' kit ' || p_size || ' phút' WHEN 4 THEN 'no price for ' || p_name WHEN 5 THEN p_name || ' set: ' || {price} || ', lasts about ' || p_size || ' giờ, SALE ' || p_size % 7 || '%'
  WHEN 6 THEN 'Gói VIP: ' || {price} || 'đ, bonus ' || p_size || ' lần' ELSE 'abc: ' || {price} || ' and more' END"""
#: Questions in several forms, one for each list.
ASKS = """CASE doc % 10 WHEN 0 THEN 'Which is the CHEAPEST one?' WHEN 1 THEN 'gói nào đắt nhất vậy' WHEN 2 THEN 'what lasts the longest' WHEN 3 THEN 'Biggest discount today?' WHEN 4 THEN 'smallest discount' WHEN 5 THEN 'most gifts with it'
  WHEN 6 THEN 'is there any price' WHEN 7 THEN 'dịch vụ nhanh nhất' WHEN 8 THEN 'the premium-tier offer' ELSE 'giảm nhiều nhất là gói nào' END"""


def offers(spark, sf):
    line = F.expr(OFFER.format(price="format_number(cast(p_retailprice * 1000 as bigint), 0)"))
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).cast("long").alias("grp"), (F.col("p_partkey") % 20).alias("k"), line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return p.groupBy("grp", F.floor(F.col("k") / 5).cast("int").alias("chunk")).agg(F.array_join(lines, "\n").alias("text"))


SPAN = f"{language.DISCOUNT}|{language.BONUS}|{language.PRICE}|{language.DURATION}"
ITEMS = r"""lists AS (SELECT p_partkey // 20 AS grp, (p_partkey % 20) // 5 AS chunk, string_agg(OFFER, chr(10) ORDER BY p_partkey % 20) AS text FROM part GROUP BY ALL),
  flat AS (SELECT grp, chunk, unnest(regexp_extract_all(text, 'SPAN')) AS span, generate_subscripts(regexp_extract_all(text, 'SPAN'), 1) AS pos FROM lists),
  kinds AS (SELECT *, CASE WHEN regexp_matches(span, 'DISCOUNT\s*$') THEN 'discount' WHEN regexp_matches(span, 'BONUS\s*$') THEN 'bonus' WHEN contains(span, ':') THEN 'price' ELSE 'duration' END AS kind FROM flat),
  found AS (SELECT grp, chunk, pos, kind, regexp_replace(CASE kind WHEN 'price' THEN regexp_extract(span, '(?s)^(.*?):\s*\d', 1) WHEN 'duration' THEN regexp_extract(span, '(?s)^(.*?)\s+\d+\s*\S+$', 1) END, '^\s+|\s+$', '', 'g') AS name,
    CAST(CASE kind WHEN 'price' THEN regexp_replace(regexp_extract(span, ':\s*([\d.,]+)', 1), '[.,]', '', 'g') ELSE regexp_extract(span, '(\d+)[^\d]*$', 1) END AS BIGINT) AS value FROM kinds),
  good AS (SELECT * FROM found WHERE kind <> 'price' OR name <> ''), priced AS (SELECT DISTINCT grp, name FROM good WHERE kind = 'price'),
  owned AS (SELECT g.*, coalesce(p.name, last_value(CASE WHEN kind = 'price' THEN g.name END IGNORE NULLS) OVER (PARTITION BY g.grp ORDER BY chunk, pos)) AS owner FROM good g LEFT JOIN priced p ON g.grp = p.grp AND g.name = p.name),
  items AS (SELECT grp, owner AS name, min((chunk, pos)) FILTER (kind = 'price') AS first, max(value) FILTER (kind = 'price') AS price, arg_min(value, (chunk, pos)) FILTER (kind = 'duration') AS duration,
    arg_min(value, (chunk, pos)) FILTER (kind = 'discount') AS discount, arg_min(value, (chunk, pos)) FILTER (kind = 'bonus') AS bonus FROM owned WHERE owner IS NOT NULL GROUP BY grp, owner),
  placed AS (SELECT * EXCLUDE (first), CAST(row_number() OVER (PARTITION BY grp ORDER BY first) AS INTEGER) AS place FROM items)"""
ITEMS = ITEMS.replace("OFFER", OFFER.format(price="format('{:,}', CAST(p_retailprice * 1000 AS BIGINT))")).replace("SPAN", SPAN).replace("DISCOUNT", language.DISCOUNT).replace("BONUS", language.BONUS)
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{name}'" for name, ps in language.ASKED.items()) + " END"


@query(f"WITH {ITEMS} SELECT * FROM placed")
def offered_items(spark, sf):
    return language.ranked_items(offers(spark, sf))


@query(f"""WITH {ITEMS}, asks AS (SELECT doc AS query_id, doc AS grp, {ASKS} AS text FROM (SELECT DISTINCT p_partkey // 20 AS doc FROM part)), i AS (SELECT query_id, grp, {INTENT} AS intent FROM asks),
  v AS (SELECT query_id, intent, name, place, CASE WHEN intent LIKE '%price' THEN price WHEN intent LIKE '%duration' THEN duration WHEN intent LIKE '%discount' THEN discount ELSE bonus END AS value FROM i JOIN placed USING (grp) WHERE intent IS NOT NULL)
  SELECT query_id, intent, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN intent IN ('min_price', 'shortest_duration', 'min_discount') THEN value ELSE -value END, place) AS INTEGER) AS rank, name, value FROM v WHERE value IS NOT NULL QUALIFY rank <= 5""")
def superlative_answers(spark, sf):
    asks = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).cast("long").alias("doc")).distinct()
    questions = asks.select(F.col("doc").alias("query_id"), F.col("doc").alias("grp"), F.expr(ASKS).alias("text"))
    return language.superlatives(questions, language.ranked_items(offers(spark, sf)))


# ---- streams with states ----

STEP = "CASE event_type WHEN 'signup' THEN 'DRAFT' WHEN 'purchase' THEN 'ACTIVE' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END"


@query()
def step_life_cycle(spark, sf):
    stateful.keep_states(spark)
    return stateful.life_cycle(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.expr(STEP).alias("step")))


#: What a user's conversation settles: a plan and its price with every purchase; the other events are answers that name a plan and a price.
@query("""WITH t AS (SELECT user_id AS key, ts, CASE WHEN event_type = 'purchase' THEN 'plan ' || event_id % 7 END AS name, CASE WHEN event_type = 'purchase' THEN round(value * 100) END AS price,
    'e' || event_id || ': plan ' || event_id % 5 || ' at this price' AS answer, round(value * 100) AS said FROM events),
  l AS (SELECT *, last_value(name IGNORE NULLS) OVER w AS locked_name, last_value(price IGNORE NULLS) OVER w AS locked_price FROM t WINDOW w AS (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT key, answer, locked_name, locked_price, concat_ws(',', CASE WHEN locked_name IS NOT NULL AND NOT contains(answer, locked_name) AND len(list_filter(range(7), lambda i: 'plan ' || i <> locked_name AND contains(answer, 'plan ' || i))) > 0 THEN 'service_drift' END,
    CASE WHEN abs(said - locked_price) > greatest(locked_price * 0.01, 1) THEN 'price_drift' END) AS rules FROM l""")
def conversation_drift(spark, sf):
    stateful.keep_states(spark)
    e = table(spark, sf, "events")
    said, is_buy = F.round(F.col("value") * 100), F.col("event_type") == "purchase"
    answer = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(": plan "), (F.col("event_id") % 5).cast("string"), F.lit(" at this price"))
    turns = e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(is_buy, F.concat(F.lit("plan "), (F.col("event_id") % 7).cast("string"))).alias("name"), F.when(is_buy, said).alias("price"), answer.alias("answer"))
    facts = stateful.settled_facts(turns)
    both = facts.join(e.select(answer.alias("answer"), said.alias("said")), "answer")
    names = F.array(*[F.lit(f"plan {i}") for i in range(7)])
    rules = stateful.drift(F.col("answer"), F.col("locked_name"), F.col("locked_price"), names, F.array("said"))
    return both.select("key", "answer", "locked_name", "locked_price", F.array_join(rules, ",").alias("rules"))


# ---- surfaces ----


@query(r"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part, unnest(p) AS content FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,199}(?:\s|\z)|.{1,200}') AS p FROM documents)""")
def sql_chunk_text(spark, sf):
    surface.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("SELECT * FROM chunk_text(TABLE({docs}), 200)", docs=docs)


#: Documents with every fourth line as a heading.
HEADED = "CASE WHEN i % 4 = 1 THEN repeat('#', 1 + CAST(i % 8 AS INTEGER)) || ' ' || x ELSE x END"


@query(rf"""WITH l AS (SELECT doc_id, i, {HEADED} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN length(regexp_extract(line, '^#+', 0)) ELSE 0 END AS level FROM l), n AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
  g AS (SELECT doc_id, s, CAST(max(level) AS INTEGER) AS level, max(CASE WHEN level > 0 THEN trim(regexp_replace(line, '^#+', ''), chr(32) || chr(9) || chr(10) || chr(12) || chr(13)) END) AS title,
    coalesce(regexp_replace(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY i), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g'), '') AS body FROM n GROUP BY doc_id, s)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS section, level, title, body FROM g WHERE title IS NOT NULL OR body <> ''""")
def sql_markdown_sections(spark, sf):
    surface.register(spark)
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).select("doc_id", "i", F.expr(HEADED).alias("line"))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return spark.sql("SELECT * FROM markdown_sections(TABLE({docs}))", docs=docs)


@query()
def page_files(spark, sf):
    """Every page written as a file, and the folder read by the source of documents."""
    surface.register(spark)
    path = new_path(spark, "page-files")
    pages = table(spark, sf, "pages").where("html IS NOT NULL")
    pages.select("page_id", F.col("html").alias("value")).write.partitionBy("page_id").text(path)
    read = spark.read.format("documents").load(path)
    return read.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "format", "text", "error")
