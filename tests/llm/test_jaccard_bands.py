"""Similar sets any number of bands apart meet; rows that share an id are judged by their texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import jaccard
from tests.llm.test_text_operators import brute_components, table


@pytest.mark.parametrize(("num", "den"), [(1, 2), (1, 4), (1, 10)])
def test_sets_far_apart_in_size(spark, num, den):
    docs, n = [], 0
    for size in (9, 20, 47, 110):
        for part in (1, num / den, num / den - 0.03):
            docs.append((n := n + 1, " ".join(f"v{size}x{i}" for i in range(max(1, -int(-size * part // 1))))))
    got = sorted(map(tuple, jaccard.components(table(spark, docs), 1, num, den).collect()), key=repr)
    assert got == brute_components(docs, 1, num, den)


def test_keep_one_looks_at_the_text(spark):
    docs = table(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text"), (2, None)])
    assert sorted([(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()], key=repr) == [(1, "a b c d e f g"), (2, "quite another text"), (2, None)]


def test_keys_that_many_sets_share_are_dealt_out(spark, monkeypatch):
    """A fifth of the sets have nothing in one segment, and a third are near copies: with parts and several copies of hubs no link is lost."""
    rng = random.Random(7)
    docs = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(6, 14)))) for i in range(150)]
    docs += [(200 + i, " ".join([*(f"c{x}" for x in range(40)), f"q{i}"])) for i in range(80)]
    want = brute_components(docs, 2, 4, 5)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    monkeypatch.setattr(jaccard, "PARTNERS", 7)
    monkeypatch.setattr(jaccard, "BROADCAST_PICKS", 0)
    df = table(spark, docs).repartition(3)
    rows = jaccard.key_rows(df, 2, jaccard.Scheme(4, 5), np.zeros(jaccard.COUNTERS, np.int64)).groupBy("key", "part").count()
    assert rows.where("part > 0").count() > 10
    assert rows.agg({"count": "max"}).first()[0] < 60
    got = sorted(map(tuple, jaccard.components(df, 2, 4, 5).collect()), key=repr)
    assert got == want


def test_words_whose_polynomials_meet_modulo_two_to_the_64(spark):
    """The Thue-Morse sequence over two letters and its complement are different words; so are texts that differ in such a word only."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    rows, n = [], 0
    for size in (512, 1024, 2048, 4096):
        for letters in ("ab", "ba"):
            rows.append((n, "".join(letters[b] for b in bits[:size])))
            rows.append((n + 100, f"one two {rows[-1][1]} three four"))
            n += 1
    docs = spark.createDataFrame([*rows, (300, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.components(docs, 3, 9, 10).collect()}
    assert got == {i: i for i, _ in rows} | {300: 0}
    assert jaccard.keep_one(docs).count() == len(rows)


def test_pairs_are_verified_on_words():
    rng = random.Random(7)
    shingles = lambda t, k: {tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} if t else set()
    for _ in range(500):
        a, b = ([rng.choice("abC") for _ in range(rng.randint(0, 14))] for _ in range(2))
        k = rng.randint(1, 5)
        x, y = (shingles([w.lower() for w in t], k) for t in (a, b))
        assert jaccard.same_shingles(" ".join(a).encode(), "  ".join(b).encode(), k) == (len(x), len(y), len(x & y))


def test_long_words_and_texts_hash_alike_in_pieces():
    word = "q" * 9_000_000
    one = jaccard.Shingler(3)
    assert len(one(f"x {word} y z")) == 2 and not set(one(f"x {word} y z").tolist()) & set(one(f"x {word}q y z").tolist())
    text = " ".join(f"w{i}" for i in range(400_000))
    assert set(one(text).tolist()) == set(jaccard.Shingler(3).batch(pa.array(["x", text]))[1].tolist())
