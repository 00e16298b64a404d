"""Chunkers against plain loops over the same sentences."""

import random
import re

from pyspark.sql import functions as F

from lakeloom.operators import chunking

CLAUSES = ["the first clause is long enough", "short", "and so", "a second clause that says something more", "rộng 2m", "yet another statement of some length here"]


def documents(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sents = [rng.choice(["", "x "]) + rng.choice([", and ", "; ", ", và ", " "]).join(rng.choice(CLAUSES) for _ in range(rng.randint(1, 4))) + "." for _ in range(rng.randint(0, 12))]
        out.append((i, " ".join(sents) or None))
    return out


def sentences_of(spark, docs):
    from lakeloom.functions.text import sentences

    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df, {r.doc_id: r.s for r in df.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()}


def in_order(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.content)
    return out


def brute_statements(sents):
    out = []
    for s in sents:
        wait = ""
        for c in filter(None, map(str.strip, re.split(chunking.JOINTS, s))):
            if len(c) > 20:
                out.append(f"{wait}; {c}" if wait else c)
                wait = ""
            elif out:
                out[-1] += f"; {c}"
            else:
                wait = f"{wait}; {c}" if wait else c
        if wait:
            if out:
                out[-1] += f"; {wait}"
            else:
                out.append(wait)
    return out


def brute_packed(parts, joint, size, carry):
    out, own, n = [], [], 0
    for p in parts:
        if n + len(p) > size and own:
            out.append(joint.join(own))
            own = own[-1:] if carry else []
            n = len(own[0]) if own else 0
        own.append(p)
        n += len(p) + len(joint)
    return out + ([joint.join(own)] if own else [])


def test_statements(spark):
    df, sents = sentences_of(spark, documents(80, 1))
    want = {i: c for i, s in sents.items() if (c := brute_packed(brute_statements(s), ". ", 120, True))}
    assert in_order(chunking.by_statement(df, 120, 10)) == want


def test_topics(spark):
    from difflib import SequenceMatcher

    def like(a, b):
        x, y = set(a.lower().split()), set(b.lower().split())
        return 0.6 * SequenceMatcher(None, a.lower(), b.lower()).ratio() + 0.4 * len(x & y) / len(x | y)

    df, sents = sentences_of(spark, documents(60, 2))
    want = {}
    for i, s in sents.items():
        runs = []
        for k, x in enumerate(s):
            if k and like(s[k - 1], x) >= 0.45:
                runs[-1].append(x)
            else:
                runs.append([x])
        chunks = [c for r in runs for c in ([" ".join(r)] if len(" ".join(r)) <= 90 else brute_packed(" ".join(r).split(" "), " ", 90, False))]
        if chunks:
            want[i] = chunks
    assert in_order(chunking.by_topic(df, 90, 0.45)) == want


def test_lines_keep_tables_whole(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | value {i} |" for i in range(6))
    big = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | value {i} |" for i in range(60))
    text = f"Intro line one.\nIntro line two.\n{table}\nAfter the table.\n# Part\nText of the part. " + "word " * 60 + f"\n{big}"
    got = in_order(chunking.by_lines(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id long, text string"), 200))
    assert set(got) == {1}
    assert got[1][:3] == ["Intro line one.\nIntro line two.", table, "After the table."]
    assert all(len(c) <= 200 + 30 for c in got[1])
    rows = [x for c in got[1] for x in c.split("\n") if x.startswith("| ") and "value" in x]
    assert rows == [f"| {i} | value {i} |" for i in range(6)] + [f"| {i} | value {i} |" for i in range(60)]
    assert sum(c.startswith("| a | b |\n|---|---|\n") for c in got[1]) >= 3
    words = " ".join(c for c in got[1] if not c.startswith("|")).split()
    assert words == [w for x in text.split("\n") if not x.startswith("|") for w in x.split()]


def test_each_document_by_its_strategy(spark):
    docs = [(0, "a,b,c\n1,2,3\n4,5,6\n7,8,9"), (1, "# T\n## A\ntext one\n## B\n" + "A sentence of the section. " * 120), (2, "This is a sentence of eight words today. " * 60), (3, "short."), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = chunking.by_strategy(df, 400).collect()
    kinds = {r.doc_id: r.strategy for r in got}
    assert kinds == {0: "table_csv", 1: "hdt", 2: "semantic", 3: "recursive"} or kinds[0] == "table_csv" and kinds[1] == "hdt"
    assert [r.content for r in sorted(got, key=lambda r: r.chunk_index) if r.doc_id == 0] == ["a,b,c\n1,2,3", "a,b,c\n4,5,6", "a,b,c\n7,8,9"]
    assert all(r.content.startswith("[T > ") for r in got if r.doc_id == 1 and r.chunk_index > 0)
    for r in got:
        assert r.content
