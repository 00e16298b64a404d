"""Importance resampling and lexical search against loops over the rows, with odd texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeloom.llm import resampling, search
from lakeloom.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, buckets):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute_resample(docs, target, buckets=10_000, least=20, percent=5):
    own = [features(t, buckets) for _, t in docs]
    s, t = (sum(x, Counter()) for x in (own, [features(x, buckets) for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for (i, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items())
        rows.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(text)) >= least))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = may[: percent * len(may) // 100]
    left = Counter()
    for k, r in enumerate(drawn, 1):
        left[r[:4], k] += 1
    out = [(*r, k) for r, k in left]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(out + [(*r, None) for r in rest.elements()], key=repr)


def texts(rng, n):
    letters = ["one", "Two", "thrée", "日本", "x9", "the", "the", "of"]
    return [" ".join(rng.choice(letters) + rng.choice(["", "", str(rng.randint(0, 50))]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(n)]


SCHEMA = "doc_id long, text string, n_words int, weight string, part int, starts string, shard int, term string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, "z") for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, n int")


def test_resampling_matches_loops(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts(rng, 300))]
    docs += [(400, None), (401, ""), (402, "?!\n"), (403, "word " * 30_000 + "é" * 2_000_000), (404, docs[5][1]), (405, "A" * 3000 + " b" * 25), (None, "no id " * 10), (5, docs[5][1]), (5, docs[5][1])]
    target = [*texts(rng, 20), None, ""]
    found = resampling.resample(table(spark, docs), items(spark, list(enumerate(target))))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute_resample(docs, target)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resampling_of_nothing(spark):
    rng = random.Random(4)
    docs = list(enumerate(texts(rng, 50)))
    assert resampling.resample(table(spark, []), items(spark, [(1, "x")])).count() == 0
    got = sorted((tuple(r) for r in resampling.resample(table(spark, docs), items(spark, [])).collect()), key=repr)
    assert got == brute_resample(docs, [])


def test_long_texts_are_counted_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}é" for i in range(5000)).encode()
    want = features(text.decode(), 10_000)
    real = resampling.word_runs
    for most in (1, 7, 100, 5000):
        monkeypatch.setattr(resampling, "word_runs", lambda t, most=most: real(t, most))
        n, at, counts = resampling.features(text)
        assert n == 5000 and dict(zip(at.tolist(), counts.tolist())) == dict(want)


def test_blocks_hold_the_matrix(spark):
    rng = random.Random(6)
    docs = list(enumerate(texts(rng, 80)))
    matrix = resampling.blocks(table(spark, docs), "doc_id", Scratch(spark), "test")
    seen = {}
    for r in matrix.collect():
        at, columns, counts = resampling._block(len(r.docs), bytes(r.starts), bytes(r.gaps), bytes(r.counts))
        for k, i in enumerate(r.docs):
            seen[i] = Counter(dict(zip(columns[at[k] : at[k + 1]].tolist(), counts[at[k] : at[k + 1]].tolist())))
    assert seen == {i: features(t, 10_000) for i, t in docs}


# ---- search ----


def brute_search(docs, asked, k=50):
    own = [(i, Counter(words_of(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    queries = defaultdict(set)
    for i, t in asked:
        if i is not None:
            queries[i] |= set(words_of(t))
    out = []
    for q, terms in queries.items():
        found = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("shard_bytes", "query_terms", "seeds"), [(1 << 25, 1000, 4), (600, 1000, 1), (600, 12, 1)])
def test_search_matches_loops(spark, shard_bytes, query_terms, seeds):
    rng = random.Random(8)
    docs = [(i, t) for i, t in enumerate(texts(rng, 400))]
    docs += [(500, None), (501, ""), (502, "..."), (503, "the " * 5000 + "rare"), (504, "rare Rare raRE"), (505, "word" * 4000), (3, docs[3][1]), (3, "the of"), (None, "rare the"), (None, "the of")]
    asked = [(i, t) for i, t in enumerate(texts(rng, 12))] + [(20, None), (21, ""), (22, "RARE the"), (22, "of x9"), (23, "unknown"), (None, "the"), (24, "the the the")]
    index = search.build(table(spark, docs), shard_bytes=shard_bytes)
    got = made(search.search(index, items(spark, asked), 10, query_terms, seeds))
    assert got == brute_search(docs, asked, 10)


def test_search_of_nothing(spark):
    assert search.ranked(table(spark, []), items(spark, [(1, "x")])).count() == 0
    assert search.ranked(table(spark, [(1, "x")]), items(spark, [])).count() == 0
    assert search.ranked(table(spark, [(1, None)]), items(spark, [(1, "x")])).count() == 0


def test_whole_table(spark, sf_dir):
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in asked.collect()])
    assert made(search.ranked(docs, asked)) == want
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in asked.collect()])
    assert made(resampling.resample(docs, asked)) == want


def _postings(rng, n_docs, df, strong=()):
    """A term's postings over n_docs documents; those in strong have a high count."""
    docs = np.array(sorted(rng.sample(range(n_docs), df)), np.int64)
    tfs = np.array([50 if d in strong else 1 for d in docs.tolist()], np.int64)
    m = np.full(n_docs, 100, np.int64)
    starts = np.arange(0, df, search.BLOCK)
    ends = np.append(starts[1:], df)
    pack = lambda v: search._varints(v)[0].tobytes()
    gaps = [np.diff(docs[a:b], prepend=docs[a]) for a, b in zip(starts, ends)]
    top = np.array([search.impact(tfs[a:b], m[docs[a:b]]).max() for a, b in zip(starts, ends)])
    return search.Postings((ends - starts).tolist(), docs[starts], docs[ends - 1], top, [pack(g) for g in gaps], [pack(tfs[a:b] - 1) for a, b in zip(starts, ends)], m), dict(zip(docs.tolist(), search.impact(tfs, m[docs]).tolist()))


def test_blocks_below_the_threshold_stay_compressed():
    rng = random.Random(1)
    strong = set(range(100, 160))
    lists = [(5, *_postings(rng, 50_000, 20_000, strong)), (3, *_postings(rng, 50_000, 15_000, strong))]
    docs, scores = search.best([(w, p) for w, p, _ in lists], 20)
    all_scores = Counter()
    for w, _, g in lists:
        for d, x in g.items():
            all_scores[d] += w * x
    want = sorted(all_scores.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert list(zip(docs.tolist(), scores.tolist())) == want
    opened, blocks = sum(len(p.open) for _, p, _ in lists), sum(len(p.n) for _, p, _ in lists)
    assert opened < blocks / 3  # the strong documents come first, and most blocks stay below them
    fresh = [(w, search.Postings(p.n, p.first, p.last, p.top, *p.packed, p.m)) for w, p, _ in lists]
    docs, scores = search.best(fresh, 20, least=want[-1][1])
    assert list(zip(docs.tolist(), scores.tolist())) == want
    assert sum(len(p.open) for _, p in fresh) <= opened


def test_varints_come_back():
    rng = random.Random(2)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1] + [rng.randint(0, 2**31) for _ in range(500)], np.int64)
    data, starts = search._varints(values)
    assert search._numbers(data.tobytes()).tolist() == values.tolist() and len(starts) == len(values) + 1
