"""Threshold-scaled sketches against loops over the texts, on odd rows and on documents of very unequal sizes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import fingerprints

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hashes(text):
    w = WORD.findall(text.translate({65 + i: 97 + i for i in range(26)}))
    return sorted({hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))}) if w else []


def brute_sketch(text):
    h = brute_hashes(text)
    low = [x for x in h if x < "1"]
    return low if len(low) >= 64 else h[:64]


def brute_likeness(a, b):
    top = min("g" if len(s) < 64 else max("1", s[-1]) for s in (a, b))
    x, y = ({h for h in s if h <= top} for s in (a, b))
    return 1.0 if a == b else len(x & y) / min(len(x), len(y)) if x and y else 0.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        s, e, n = (brute_sketch(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(s), "".join(e), brute_likeness(s, e), brute_likeness(s, n), len(s)))
    return out


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gam2ma", "délta", "日本", "x"]) + str(rng.randint(0, 30)) for _ in range(n))


SCHEMA = "doc_id long, text string, range int, head int, answers string, s int, e int, next_text string, _at int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, "y", 5) for i, t in rows], SCHEMA)


def test_fingerprints_match_loops(spark):
    rng = random.Random(5)
    rows = [(i * 3 - 20, words(rng, rng.choice([1, 3, 4, 5, 6, 40, 400]))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "!?."), (504, "🎉 né"), (505, words(rng, 30_000)), (506, rows[3][1]), (506, rows[3][1]), (506, "another text"), (None, "no id"), (None, None)]
    got = made(fingerprints.fingerprints(table(spark, rows)))
    assert got == sorted(brute(rows), key=repr)
    by = {}
    for r in got:
        by.setdefault(r[3], set()).add(r[0])
    assert any({506, rows[3][0]} <= ids for ids in by.values())  # equal texts have equal fingerprints


@pytest.mark.parametrize("rows", [[], [(7, "only one here of its kind")], [(7, "a b c d e f"), (7, "a b c d e f")], [(1, None), (2, "x")]])
def test_few_rows(spark, rows):
    assert made(fingerprints.fingerprints(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_containment_between_very_unequal_documents(spark):
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 10**9)}" for _ in range(40_000)]
    part = long[5000:7000]
    docs = spark.createDataFrame([(" ".join(part), " ".join(long))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    got = docs.select(a.alias("a"), b.alias("b")).select(
        fingerprints.containment(F.col("a"), F.col("b")).alias("ab"), fingerprints.containment(F.col("b"), F.col("a")).alias("ba"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), F.size("b").alias("n")
    ).first()
    assert got.ab == 1.0 and abs(got.ba - 0.05) < 0.03 and abs(got.j - 0.05) < 0.03
    assert abs(got.n / 40_000 - 1 / 16) < 0.01  # the sketch grows with the text


def test_sketches_merge_by_union(spark):
    rng = random.Random(2)
    for n, m in ((3, 10), (50, 80), (3000, 60), (2000, 2500)):
        x, y = words(rng, n), words(rng, m)
        got = spark.createDataFrame([(x, y)], "x string, y string").select(fingerprints.merged(fingerprints.sketch(F.col("x")), fingerprints.sketch(F.col("y"))).alias("m")).first().m
        both = sorted(set(brute_hashes(x)) | set(brute_hashes(y)))
        low = [h for h in both if h < "1"]
        assert got == (low if len(low) >= 64 else both[:64])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert made(fingerprints.fingerprints(docs)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
