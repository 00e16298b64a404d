"""What is worked out once, where it is read."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lakeloom.functions import text
from lakeloom.operators import chunking, cohesion, language, regions
from lakeloom.plans import catalog, catalog_text


def test_each_different_question_is_read_once(spark, tmp_path, monkeypatch):
    parts = spark.range(4000).select((F.col("id") + 1).alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 5).alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seen = {}
    monkeypatch.setattr(catalog_text, "written", lambda df, name, f=catalog_text.written: seen.setdefault(name, f(df, name)))
    got = catalog.QUERIES["question_price_ranges"](spark, str(tmp_path)).collect()
    assert len(got) == 4000 and {r.p_partkey: r.price_max for r in got}[16] == 26_000_000
    assert seen["readings"].count() == seen["questions"].count() < 1000


def test_neighbours_meet_across_batches(spark):
    """Batches of two rows; nulls, zeros, other lengths and nulls within a vector; no window carries vectors along."""
    vectors = [[1.0, 2.0], None, [0.0, 0.0], [3.0, -1.0], [1.0], [2.0, None], [2.0, 2.0], [1.0, 0.5], [4.0, 1.0]]
    rows = [(d, i, 3 + (i * d) % 4, vectors[(i * d) % 9]) for d in (1, 2, 4) for i in range(9 + d)] + [(7, 0, 5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id int, i int, length int, embedding array<float>")

    def cos(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    want = {7: None}
    for d in (1, 2, 4):
        own = [r for r in rows if r[0] == d]
        pairs = [(cos(own[i][3], own[j][3]), own[i][2] * own[j][2]) for i in range(len(own)) for j in range(i + 1, min(i + 4, len(own)))]
        want[d] = round(max(0.0, min(1.0, 1 - sum(c * w for c, w in pairs) / sum(w for _, w in pairs))), 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = cohesion.dissimilarity(df)
        assert {r.doc_id: None if r.dissimilarity is None else round(r.dissimilarity, 7) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_statements_are_packed_a_few_documents_at_once(spark, sf_dir, monkeypatch):
    """The chunks of the whole column at once; few rows are Python objects at a time; null and empty texts give none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, " ")], "doc_id long, text string"))
    want = chunking._numbered(docs, chunking.packed(chunking.statements(F.col("text")), ". ", 1024, True))
    assert chunking.AT_ONCE <= 200
    got = chunking.by_statement(docs)
    assert got.schema["chunk_index"].dataType == want.schema["chunk_index"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shingles_of_an_item_are_made_once_an_item(spark, sf_dir):
    """Two splits in the plan, and the item's stands below the join."""
    plan = catalog.QUERIES["shingle_overlap"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and plan.index("Join") < plan.rindex("split(")
    row = spark.createDataFrame([("a b c d", "b c d e")], "x string, y string").select(text.shingle_overlap(F.col("x"), F.col("y"), 3)).first()
    assert row[0] == 0.5


def test_a_likeness_is_decided_as_its_bounds_decide_it(monkeypatch):
    """The same side of the bar as the whole ratio, with fewer matches sought."""
    import random
    from difflib import SequenceMatcher

    rnd, sought = random.Random(2), []
    real = SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda self, *a: sought.append(1) or real(self, *a))
    whole = part = 0
    for _ in range(400):
        x, y = ("".join(rnd.choice("abcde fgh") for _ in range(rnd.randrange(1, 260))) for _ in "xy")
        bar = rnd.choice([0.1, 0.4, 0.5, 0.6])
        sought.clear()
        want = SequenceMatcher(None, x, y).ratio() < bar
        whole += len(sought)
        sought.clear()
        assert chunking._ratio_is(lambda r, bar=bar: r < bar, SequenceMatcher(None, x, y), len(x), len(y)) == want
        part += len(sought)
    assert part < whole / 2


def test_a_text_is_measured_where_it_is_read(spark, monkeypatch):
    """Several texts at once, against a loop; nothing is joined or shuffled; texts without a key have no row."""
    texts = [
        "One cat sat. A cat sat. The dog? See section 4\n\nSee section 4 and see section 4. Dogs, dogs!  Cats", "", None, " \n\n ", "a. b. c", "...\n \n? !", "İstanbul ΑΣ. ΑΣΑ! x2 ½½\n\n\v\n(see me) (See ME)",
        " ".join(f"w{i} w{i}" for i in range(60)) + ". w59 w3\n\nw1 w58.\tw1", "[ref 1] [1] [ 1]\n\n" + "y" * 1100,
    ]

    def words(t):
        return [w for w in re.findall(r"\w+", t.lower().replace("̇", " ")) if len(w) >= 2]

    def want(t):
        blocks = [b for b in (b.strip() for b in re.split(r"\n\s*\n", t)) if b] or [t]
        near, parts = [], [[set(words(s)) for s in re.split(r"(?<=[.!?])\s+", b) if s.strip()] for b in blocks]
        for p in parts:
            near += [len(x & y) / len(x | y) if x | y else 0.0 for x, y in zip(p, p[1:], strict=False)]
        gist = {w for w, _ in Counter(words(t)).most_common(50)}
        inside = [len(gist & set(words(b))) / len(gist) for b in blocks if words(b)]
        marks = [m.lower().strip() for r in cohesion.REFERENCES for m in re.findall(r, t)]
        twice = [any(b.lower().count(m) > 1 for b in blocks) for m in marks]
        return [sum(x) / len(x) if x else 1.0 for x in (twice, near, inside, [len(b) <= 1024 for b in blocks])]

    docs = spark.createDataFrame([*enumerate(texts), (None, "no key")], "doc_id long, text string")
    monkeypatch.setattr(cohesion, "AT_ONCE", 4)
    out = cohesion.measures(docs)
    got = {r.doc_id: [r.rc, r.icc, r.dcc, r.bi] for r in out.collect()}
    assert got == {i: [round(x, 9) for x in want(t or "")] for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Window", "Generate"))


def test_a_text_is_compressed_where_it_is_read(spark):
    """Odd marks, blanks and money against the plain patterns in order; nothing is shuffled, and the text is worked out once."""
    filler = "of the to of the to"
    rows = [
        "a~*~b ~~~c *d*_e_ **f**", "x \t\n\n \n\n\ny  z\t\tw", "# h\n#no\n####### seven\n## [l](u) [m] (n)", "Page 1 of 2\nrest [a](b)[c](d", None, "\u0001" * 40, " \u0001\n" * 40,
        f"{filler}; {filler} of. 5 TỶ of the to! 7 usd of the to? {filler}\n{filler} VNDx. {filler}: 3 Triệu of the.", f"{filler} " * 4 + "not. " + f"{filler}. " * 4, "word " * 12 + "\n" + "k " * 9,
    ]

    def tidy(t):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", t))).strip(" \t\n\v\f\r")

    def want(t):
        t = tidy(re.sub(r"(?m)^Page \d+ of \d+$", "", tidy(t or "")))
        t = re.sub(r"\*{1,3}|_{1,3}|~{2}", "", re.sub(r"\[([^\]]*)\]\([^\)]*\)", r"\1", t))
        t = tidy(re.sub(r"(?m)^#{1,6}\s+", "", t))
        if len(t) <= 30:
            return [t]
        parts = [p for p in (p.strip(" \t\n\v\f\r") for p in re.split("\u0001+", re.sub(r"([.!?;])\s+|\n+", "\\1\u0001", t))) if p]

        def score(p):
            w = re.findall(r"\w+", p.lower())
            gain = [0.1 * bool(re.search(r"\d", p)), 0.15 * bool(re.search(r"(?ia)[$€₫]|\bVND\b|\bUSD\b|\btriệu\b|\btỷ\b|\bnghìn\b", p)), 0.1 * bool(re.search(r"\d{1,2}[/.\-]\d{1,2}|\d{4}", p)), 0.1 * bool(re.search(r"\d+\s*%", p)), 0.2 * ("not" in w)]
            return round(min(1.0, sum(len(x) > 1 and x not in ("of", "the", "to") for x in w) / len(w) + sum(gain)), 9) if w else 0.0

        kept = [p for p in parts if score(p) >= 0.2] or [parts[i] for i in sorted(sorted(range(len(parts)), key=lambda i: (-score(parts[i]), i))[: max(1, len(parts) // 2)])]
        kept = parts if len(parts) == 1 else kept
        units = [""]
        for p in kept:
            units[-1] = f"{units[-1]} {p}".strip(" ")
            units += [""] * (p[-1] in ".!?;")
        units = [u for u in units if u]
        fits = [" ".join(units[: k + 1]) for k in range(len(units)) if len(" ".join(units[: k + 1])) <= 30]
        return [fits[-1] if fits else units[0][:30]] if units else []

    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    out = language.compressed(df, "id", ["of", "the", "to"], ["not"], 30, 0.2, [r"(?m)^Page \d+ of \d+$"])
    assert sorted(map(tuple, out.collect())) == [(i, t) for i, row in enumerate(rows) for t in want(row)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Window", "Filter")) and plan.count("Page") == 1


def test_tables_are_read_where_their_document_is(spark):
    """Surroundings as from lines and rows; neither windows, joins nor shuffles; documents without a key have none."""
    long = "A line that is long enough to tell something about the table"
    texts = [
        f"{long}\na,b\n1,2\n3,4\n5,6\n7,8\n{long}", None, "", f"a,b\n{long}\n1,2,3\n4,5,6\n,,x\n\n \t\n7,8,9\nshort\n{long}é", f"h,k\nh,k\n, ,\n{long}", f"{long}\n1,2\n3,4\n5,6,7\n8,9,0\n{long}",
        f"{long}\n" * 30 + "a,b\nc,d\ne,f", "x, \ny, \na,b,\nc,d,",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    lines = regions.table_lines(docs)
    got = regions.surroundings(docs)
    want = regions.surrounding_chunks(lines, regions.data_rows(lines))
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and [r[:3] for r in rows] == [(0, 1, "after"), (0, 1, "before"), (3, 1, "after"), (3, 1, "before"), (5, 1, "before"), (5, 2, "after")]
    assert rows[0][3] == f"a,b\n3,4\n5,6\n7,8\n{long}" and rows[2][3] == f"a,b\n1,2,3\n4,5,6\n,,x\n7,8,9\nshort\n{long}é"
    for df in (got, regions.data_rows(lines)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Join", "Aggregate", "Window", "Sort"))
