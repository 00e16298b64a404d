"""Boolean and phrase search with cover density against a loop that writes out every cover."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import lexical

TERM = re.compile(r"[^\W_]+")


def parse(text):
    """Alternatives as lists of (negated, terms of a phrase)."""
    groups = [[]]
    for part in re.findall(r'-?"[^"]*"|[^\s"]+', text or ""):
        if part.lower() == "or":
            groups.append([])
            continue
        found = TERM.findall(part.lower())
        if '"' in part:
            if found:
                groups[-1].append((part.startswith("-"), found))
        else:
            groups[-1] += [(part.startswith("-"), [t]) for t in found]
    return groups


def places(tokens, phrase):
    return [i + 1 for i in range(len(tokens) - len(phrase) + 1) if tokens[i : i + len(phrase)] == phrase]


def brute(text, query, flags):
    tokens = TERM.findall(text.lower())
    groups = parse(query)
    good = [g for g in groups if any(not n for n, _ in g) and all(bool(places(tokens, p)) != n for n, p in g)]
    if not good:
        return None
    asked = {t for g in groups for _, p in g for t in p}
    entries = [i + 1 for i, t in enumerate(tokens) if t in asked]
    holds = lambda a, b: any(all(any(a <= s and s + len(p) - 1 <= b for s in places(tokens, p)) for n, p in g if not n) for g in good)
    # Every stretch between two places of terms that satisfies the query and holds no shorter one that does.
    covers = [(a, b) for i, a in enumerate(entries) for b in entries[i:] if holds(a, b)]
    covers = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
    total = sum(0.1 / (1 + (b - a) - (entries.index(b) - entries.index(a))) for a, b in covers)
    middles = [(a + b) / 2 for a, b in sorted(covers)]
    near = sum(1 / (y - x) for x, y in zip(middles, middles[1:]) if y > x)
    size, different = len(tokens), len(set(tokens))
    if flags & 1:
        total /= math.log(size + 1)
    if flags & 2:
        total /= size
    if flags & 4 and near:
        total /= len(covers) / near
    if flags & 8:
        total /= different
    if flags & 16:
        total /= math.log2(different + 1)
    return total / (total + 1) if flags & 32 else total


QUERIES = [
    "a b", '"a b"', '"a b" c', "a or b c", "a -b", 'a -"b c"', '"a a"', "a a", "a OR", "or a", "-a", "", None, '"" a', "x.y", '"a b" or "c d" e -f', "a b c d", '-"a b" c or d -e',
    "A B", "range(5)", "e_f", '"b a" or b -c', "é à", 'a or b or "c a"', "-a or b",
]


@pytest.mark.parametrize("flags", [0, 5, 2 | 8 | 16 | 32])
def test_covers(spark, flags):
    rng = random.Random(flags)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g.", "x y", "é", "À", "B,"]) for _ in range(rng.choice([0, 1, 3, 8, 20]))) for _ in range(60)] + [None, "", "range(5) is range 5", "a " * 12]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.websearch(queries, lexical.positional_index(chunks), flags).collect()}
    want = {(q, c): s for q, query in enumerate(QUERIES) for c, t in enumerate(texts) if (s := brute(t or "", query, flags)) is not None}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_places_of_the_index(spark):
    chunks = spark.createDataFrame([(1, "B a b. A-b"), (2, None), (3, "..")], "chunk_id long, content string")
    got = {(r.chunk_id, r.term): (r.places, r.size, r.n_terms) for r in lexical.positional_index(chunks).collect()}
    assert got == {(1, "a"): ([2, 4], 5, 2), (1, "b"): ([1, 3, 5], 5, 2)}


@pytest.mark.parametrize(
    ("question", "symbol"),
    [("vòng lặp for trong python với range(5) chạy mấy lần", "range(5)"), ("print(x) làm gì", "print(x)"), ("giá dịch vụ chăm sóc da chuyên sâu", ""), ("", ""), ("math.sqrt(16) bằng bao nhiêu", "math.sqrt(16)"), ("lốp 195/65R15 và 2-R17", "195/65R15")],
)
def test_symbols(spark, question, symbol):
    assert spark.createDataFrame([(question,)], "q string").select(lexical.symbol(F.col("q"))).first()[0] == symbol


def test_a_symbol_is_found_though_its_words_are_not_all_there(spark):
    chunks = spark.createDataFrame([(1, "for i in range(5): print"), (2, "how many times does it run"), (3, "range of 5")], "chunk_id long, content string")
    q = spark.createDataFrame([(7, "how many times does range(5) run")], "query_id long, text string")
    index = lexical.positional_index(chunks)
    assert lexical.websearch(q, index).count() == 0
    assert {(r.chunk_id, r.score) for r in lexical.with_symbols(q, index).collect()} == {(1, 1.0)}


def test_anchors_that_match_nothing_keep_all(spark):
    chunks = spark.createDataFrame([(1, "Chapter 2 of rules"), (2, "Chapter 3 of rules")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "rules"), (2, "rules")], "query_id long, text string")
    found = lexical.websearch(q, lexical.positional_index(chunks))
    got = lexical.anchored(found, chunks, spark.createDataFrame([(1, "%Chapter 3%"), (2, "%Chapter 99%")], "query_id long, pattern string"))
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(1, 2), (2, 1), (2, 2)}


def test_texts_held_against_queries_find_what_the_index_finds(spark):
    """All flags; phrases with a repeated word, alternatives, forbidden phrases, a null query and null text; nothing is shuffled."""
    import random

    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["a", "b", "c", "dd", "e1"]) for _ in range(rnd.randrange(1, 25)))) for i in range(80)] + [(90, None), (91, "..")]
    asks = [(1, '"a b" c'), (2, 'a -b or "c dd" e1'), (3, '"a a" -"b c"'), (4, "-a"), (5, None), (6, "e1(a) or dd -c"), (7, "zz or b b")]
    chunks, queries = spark.createDataFrame(docs, "chunk_id long, content string"), spark.createDataFrame(asks, "query_id long, text string")
    for flags in (lexical.LOG_LENGTH | lexical.DISTANCE, 63):
        got = lexical.websearch_texts(queries, chunks, flags)
        want = {(r.query_id, r.chunk_id): round(r.score, 12) for r in lexical.websearch(queries, lexical.positional_index(chunks), flags).collect()}
        assert want and {(r.query_id, r.chunk_id): round(r.score, 12) for r in got.collect()} == want
        assert {(r.query_id, r.chunk_id): round(r.score, 12) for r in lexical.websearch_texts(queries, chunks, flags, held=1).collect()} == want
        plan = got._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_symbols_held_against_texts_find_what_the_index_finds(spark, monkeypatch):
    """Repeated questions, single words, phrases, alternatives, codes whose words stand apart, null questions; in one block and in many, with few finds gathered; all flags."""
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(["a", "B", "c", "dd", "e1", "f(a)", "dd/c.a", "x f"]) for _ in range(rnd.randrange(1, 25)))) for i in range(80)] + [(90, None), (91, ".."), (92, "a " * 40)]
    asks = ["a", "A", "a ", "zz", None, "", "c f(a)", "dd/c.a", "e1 dd/c.a", '"a b" c', 'a -b or "c dd" e1', "or", "f(a) or dd", "f(zz)", "-a", "a a", "DD/c.a e1", "or a"]
    chunks, queries = spark.createDataFrame(docs, "chunk_id long, content string"), spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")
    index = lexical.positional_index(chunks)
    monkeypatch.setattr(lexical, "GATHERED", 40)
    for flags, k, questions in ((lexical.LOG_LENGTH | lexical.DISTANCE, 5, 50), (63, 100, 4)):
        want = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in lexical.best(lexical.with_symbols(queries, index, flags), k).collect())
        got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in lexical.best_with_symbols(queries, chunks, k, flags, questions=questions).collect())
        assert len({q for q, *_ in want}) > 9 and got == want


def test_a_task_passes_on_the_best_of_each_question(spark):
    """Forty queries that ask for one word of 3,000 texts: one question, and no more rows than are asked for leave a task."""
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word "), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("content")).coalesce(2)
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.lit("Word").alias("text"))
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    got = lexical.best_with_symbols(queries, chunks, 3).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(q, i + 1, 7 * i) for q in range(40) for i in range(3)]
    assert sum(n for i, n in shuffled().items() if i not in before) < 500
