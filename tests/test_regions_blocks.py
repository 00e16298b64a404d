"""Table regions, whole blocks, places of chunks, topics and measures on written cases and against loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import blocks, cohesion, regions
from lakeloom.plans import catalog, catalog_chunks

TWO_TABLES = """Retail prices of all the services that are offered here
Name,Price,Minutes
Wash,100,30
Cut,200,45
- a bullet with stray commas,,,

The combo prices follow in the table below this long line
Wash,Cut,Both,300
Cut,Dry,Both,400
All prices include the tax that applies at the time of sale"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_table_is_a_region_under_the_document_header(spark):
    lines = regions.table_lines(docs(spark, TWO_TABLES, "no table here", "a,b\nc,d", None, "one,row\nprose"))
    rows = regions.data_rows(lines)
    got = sorted((r.doc_id, r.region, r.row, r.content) for r in regions.row_chunks(rows).collect())
    assert got == [
        (0, 1, 1, "Name,Price,Minutes\nWash,100,30"), (0, 1, 2, "Name,Price,Minutes\nCut,200,45"), (0, 2, 1, "Name,Price,Minutes\nWash,Cut,Both,300"),
        (0, 2, 2, "Name,Price,Minutes\nCut,Dry,Both,400"), (2, 1, 1, "a,b\nc,d"),
    ]
    near = {(r.region, r.kind): r.content for r in regions.surrounding_chunks(lines, rows).collect()}
    assert near[1, "before"] == "Retail prices of all the services that are offered here\nName,Price,Minutes\nWash,100,30\nCut,200,45"
    between = "- a bullet with stray commas,,,\nThe combo prices follow in the table below this long line"
    assert near[1, "after"] == f"Name,Price,Minutes\nWash,100,30\nCut,200,45\n{between}"
    assert near[2, "before"].startswith(between) and near[2, "after"].endswith("at the time of sale")
    assert len(near) == 4


def test_groups_fill_up_and_a_last_row_joins_the_one_before(spark):
    table = "h,k\n" + "\n".join(f"{i:04},x" for i in range(9))
    rows = regions.data_rows(regions.table_lines(docs(spark, table)))
    got = sorted((r.part, r.first_row, r.last_row) for r in regions.group_chunks(rows, 3 + 4 * 7).collect())
    assert got == [(0, 1, 4), (1, 5, 9)]
    assert [(r.part, r.first_row, r.last_row) for r in regions.group_chunks(rows).collect()] == [(0, 1, 9)]
    whole = regions.group_chunks(rows).first().content
    assert whole == table


MIXED = "\n\n".join([
    "# Title", "Intro prose.", "$$E = mc^2$$", "Text after the formula with inline $x$ in it.", "![Diagram](https://e.org/1.png)", "| A | B |\n|---|---|\n| 1 | 2 |", "$$\nmulti\n\nline\n$$", "```py\n| not a table |\n$$\n```", "$\\sum_i i$", "The end.",
])


def test_blocks_stay_whole_and_nothing_is_lost(spark):
    long = "word " * 100
    texts = [MIXED, "", "plain " * 300, "```\nnever closed\n" + "x" * 900, "$$\nopen", None, "y" * 950, f"{long}\n![a](b)\n{long}"]
    found = blocks.atomic_chunks(docs(spark, *texts), 200).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        parts = [r for r in found if r.doc_id == i]
        at, by, last = 0, {}, 1
        for r in parts:
            at, last = at + r.block - last, r.block  # a line end before each further block; empty ones give no chunk
            by.setdefault(r.block, []).append(r)
            assert r.start == at and (t or "")[at : at + len(r.content)] == r.content
            at += len(r.content)
        assert at == len(t or "")
        assert all(len(r.content) <= 200 for r in parts if r.kind == "text")
        assert all(len(p) == 1 for p in by.values() if p[0].kind != "text")
    kinds = [r.kind for r in found if r.doc_id == 0 and r.kind != "text"]
    assert kinds == ["formula", "image", "table", "formula", "code", "formula"]
    assert [r.content for r in found if r.doc_id == 0 and r.kind == "code"] == ["```py\n| not a table |\n$$\n```"]


def brute_located(text, parts):
    bare, at = "", []
    for m in re.finditer(r"\S+", text):
        if bare:
            bare += " "
            at.append(at[-1] + 1)
        bare += m[0]
        at += range(m.start(), m.end())
    out, seen = [], 0
    for p in parts:
        want = " ".join(p.split())
        place = -1 if len(want) < 2 else bare.find(want, seen)
        place = bare.find(want) if place < 0 and len(want) >= 2 else place
        if place < 0:
            out.append((None, None))
        else:
            seen = place + len(want)
            out.append((at[place], at[seen - 1] + 1))
    return out


def test_chunks_are_found_again(spark):
    text = "  Alpha beta\n\ngamma.  Alpha beta gamma.\tAlpha end "
    parts = ["Alpha beta gamma.", "Alpha  beta\ngamma.", "nothing", "Alpha end", "beta gamma", "A", ""]
    chunks = spark.createDataFrame([(0, i, p) for i, p in enumerate(parts)], "doc_id long, chunk_index int, content string")
    got = [(r.start, r.end) for r in blocks.located(chunks, docs(spark, text)).orderBy("chunk_index").collect()]
    assert got == brute_located(text, parts) and got[0] == (2, 20) and got[2] == (None, None)
    assert text[got[3][0] : got[3][1]] == "Alpha end"


def test_registered_places_and_gaps(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in catalog_chunks.dressed(spark, sf_dir).collect()}
    parts = {}
    for r in catalog_chunks._trimmed_chunks(spark, sf_dir).orderBy("doc_id", "chunk_index").collect():
        parts.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    want = {(i, c): s for i, p in parts.items() for (c, _), s in zip(p, brute_located(texts[i], [x for _, x in p]))}
    assert {(r.doc_id, r.chunk_index): (r.start, r.end) for r in catalog.QUERIES["located_chunks"](spark, sf_dir).collect()} == want
    gaps = {}
    for i, t in texts.items():
        held = np.zeros(len(t), bool)
        for (d, _), (a, b) in want.items():
            if d == i and a is not None:
                held[a:b] = True
        letters = np.array([not c.isspace() for c in t], bool)
        runs = [m for m in re.split("\0+", "".join("\0" if h else c for h, c in zip(held, t))) if m.strip()]
        n = int((letters & ~held).sum())
        gaps[i] = (int(letters.sum()), n, len(runs), n <= letters.sum() * 0.02)
    assert {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["chunk_gaps"](spark, sf_dir).collect()} == gaps


def test_topics_by_vectors(spark):
    text = "One cat. Two cats!  A dog? " + "A long dog " * 30 + ". New"
    vectors = spark.createDataFrame([("One cat.", [1.0, 0.0]), ("Two cats!", [0.9, 0.1]), ("A dog?", [0.0, 1.0])], "key string, embedding array<double>")
    got = cohesion.vector_topics(docs(spark, text, None), vectors, lambda s: s, 0.65, 100).orderBy("topic", "part").collect()
    assert [r.content for r in got[:2]] == ["One cat. Two cats!", "A dog?"] and all(len(r.content) <= 100 for r in got)
    assert got[-1].content == "New" and [r.topic for r in got][-1] == 3


@pytest.mark.parametrize(
    ("text", "strategy", "why"),
    [("x" * 3000, "semantic", "bi"), ("See section 4 in words. More of section 4.", "hybrid", "balanced"), ("Figure 3 shows it. As figure 3 says, it is short.", "proposition", "rc"), ("", "proposition", "rc")],
)
def test_measures_choose(spark, text, strategy, why):
    d = docs(spark, text if why != "balanced" else (text + " " + "alpha beta gamma delta " * 60).strip())
    got = cohesion.choose(cohesion.measures(d)).first()
    if why == "balanced":
        assert got.rc == 0.0 and got.strategy in ("hybrid", "semantic", "recursive")
    else:
        assert (got.strategy, got.why) == (strategy, why)


def test_dissimilarity_of_a_single_chunk_is_unknown(spark):
    rows = spark.createDataFrame([(1, 0, 5, [1.0, 0.0]), (2, 0, 2, [1.0, 0.0]), (2, 1, 3, [0.0, 1.0]), (2, 2, 4, [1.0, 0.0])], "doc_id long, i int, length int, embedding array<double>")
    got = {r.doc_id: r.dissimilarity for r in cohesion.dissimilarity(rows).collect()}
    assert got == {1: None, 2: round(1 - 8 / (6 + 12 + 8), 9)}
    assert rows.select(F.count("*")).first()[0] == 4
