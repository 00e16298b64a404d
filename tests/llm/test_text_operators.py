"""Decontamination, line dedup, Jaccard join and BPE against brute force, with nulls, empties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import bpe, contamination, jaccard, lines

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key long, node long, k long, start int, spans string, n_words string"


def table(spark, rows):
    """rows: (doc_id, text[, source])"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, 2, 3, 4, "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_bpe_matches_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = "  \n\t\r\x1c\x85\xa0 abcdeTHE'stvrelmd.,!?0123²Ⅷéß日本한🎉_-<|>"
    texts = [None, "", " ", "a" * 5000, "ha" * 4000, "<|endoftext|>a <|endoftext|> b", " a  b\n  c ", "the the"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    docs = table(spark, [*enumerate(texts), (7, "the the"), (None, "x")])
    got = bpe.encode_documents(docs, bpe.load(PATH), with_ids=True).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert by[i].token_ids == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(table(spark, []), bpe.load(PATH)).count() == 0


MACHINE = bpe.Automaton(bpe.load(PATH))
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehint gs'\n", max_size=80))
def test_bpe_round_trip(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    found, spelt = MACHINE.encode(text)
    assert found == ",".join(map(str, ids))
    assert spelt.decode() == text == MACHINE.decode(ids)


def words13(text):
    low = (text or "").translate({65 + i: 97 + i for i in range(26)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, bench):
    wins = defaultdict(set)
    for item, t in bench:
        w = words13(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            wins[tuple(w[i : i + 13])].add(item)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, items = words13(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        names = ",".join(sorted(map(str, items)))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(5)
    vocab = ["a", "of", "Über", "the", "x1", "longword", "ÉÉ", "zz-top"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(12)] + [(20, None), (21, ""), (22, "!!"), (10, "the x1 of"), (3, "the x1 of")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, "pre, " + t.upper().replace(" ", "  ") + " post" if t else t) for i, t in bench] + [(5, None), (6, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "the x1 of"), (None, "the X1 of"), (900, "longword " * 3000 + bench[0][1])]
    d = table(spark, docs)
    b = spark.createDataFrame([(i, t, "q", 1) for i, t in bench], "item_id long, text string, word string, doc_id long")
    got = [tuple(r) for r in contamination.contamination(d, b).drop("hit_spans").collect()]
    assert sorted(got, key=repr) == brute_contamination(docs, bench)
    plain = contamination.contamination(d, b, size=13)
    small = contamination.occurrences(d.select("doc_id", "text"), b, broadcast_windows=0)  # by shuffle instead of broadcast
    assert small.count() == contamination.occurrences(d.select("doc_id", "text"), b).count()
    blocks = contamination.occurrences(d.select("doc_id", "text"), b, broadcast_windows=0, broadcast_anchors=3)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(blocks) == as_set(small) == as_set(contamination.occurrences(d.select("doc_id", "text"), b))
    clean = contamination.decontaminate(d, b)
    assert clean.columns == d.columns
    assert clean.count() == plain.where("NOT contaminated").count()
    assert contamination.contamination(d, b.limit(0)).where("contaminated OR n_hit > 0").count() == 0
    assert contamination.contamination(d.limit(0), b).count() == 0


def test_contamination_ships_no_text(spark, sf_dir):
    """Beyond the broadcast, documents send windows of thirteen words through the exchange: no array and no text."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = contamination.occurrences(docs, bench, broadcast_windows=0)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    sent = [re.findall(r"(\w+)#", x) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert ["doc_id", "text_key", "start", "window"] in sent
    assert not {"w", "words", "text", "word"} & {x for names in sent for x in names}


@pytest.mark.parametrize("near", [0.1, 0.9])
def test_line_dedup(spark, near):
    rows = [(i, f"common line\nown {i}\n  common line \n\nlast", f"s{i % 12}") for i in range(30)]
    rows += [(40, None, "s1"), (41, "", "s1"), (42, "common line", None), (3, rows[3][1], "s3"), (50, "nine\nten", "s0")] + [(60 + i, "nine" if i < 9 else "x", f"s{i}") for i in range(10)] + [(80 + i, "ten", f"s{i}") for i in range(10)] + [(None, "common line", "s2")]
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if s is not None and (b := line.strip(" \t\r")):
                sites[b].add(s)
    got = lines.drop_boilerplate(table(spark, rows), min_sites=10, near=near)
    assert got.columns == table(spark, []).columns + ["n_lines", "n_removed"]
    gone = {b for b, s in sites.items() if len(s) >= 10}
    assert gone == {"common line", "last", "ten"}
    kept = defaultdict(int)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        for line in (r.text or "").split("\n"):
            if line.strip() in gone and r.source is not None:
                kept[line.strip()] += 1
        assert (r.text is None) == (r.doc_id == 40)
        if r.doc_id is not None and r.doc_id < 30:
            assert f"own {r.doc_id}" in r.text
    assert all(1 <= v <= 2 for v in kept.values())  # a repeated row keeps what its twin keeps
    assert lines.drop_boilerplate(table(spark, []).limit(0)).count() == 0
    del first


def test_one_bar_for_lines_of_any_length(spark):
    """A line on four of twenty sites stays once, of 50, 51 words or one, whichever site is hot; on three sites it stays everywhere."""
    many, few = [" ".join(f"p{n}w{i}" for i in range(n)) for n in (1, 50, 51)], [" ".join(f"q{n}w{i}" for i in range(n)) for n in (1, 50, 51)]
    rows = [(i, "\n".join([f"own {i}", *many]), f"s{i % 4}") for i in range(8)] + [(20 + i, "\n".join([f"own {20 + i}", *few]), f"s{i % 3}") for i in range(9)]
    rows += [(100 + i, f"own {100 + i}", "s0") for i in range(60)]
    out = {r.doc_id: r.text.split("\n") for r in lines.drop_boilerplate(table(spark, rows)).collect()}
    for line in many:
        assert [i for i in range(8) if line in out[i]] == [0]  # the first occurrence
    assert all(line in out[20 + i] for i in range(9) for line in few)
    assert all(t[0] == f"own {i}" for i, t in out.items())


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({65 + i: 97 + i for i in range(26)})) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k, num, den):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in docs]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), (find(i) if s else i) if i is not None else None) for i, s in sets), key=repr)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(spark, k, num, den):
    rng = random.Random(k)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (5, 12, 20, 40, 90, 200, 400)]
    docs, n = [], 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 21):
            w = list(b)
            for _ in range(edits):
                at = rng.randrange(len(w))
                kind = rng.random()
                w[at : at + 1] = [] if kind < 0.3 else [f"e{rng.randint(0, 9999)}"] if kind < 0.7 else [w[at], "new"]
            docs.append((n := n + 1, " ".join(w).upper() if edits == 1 else "\t".join(w)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "one"), (None, docs[0][1]), (1, docs[0][1])]
    docs += [(600 + i, " ".join([*base[5][:190], f"q{i}"])) for i in range(25)]  # a large group of near copies
    got = sorted(map(tuple, jaccard.components(table(spark, docs), k, num, den).collect()), key=repr)
    assert got == brute_components(docs, k, num, den)


def test_jaccard_empty_and_keep_one(spark):
    assert jaccard.components(table(spark, []), 3, 90, 100).count() == 0
    docs = table(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "z"), (4, None), (None, "a b c d e f g"), (1, "a b c d e f g")])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == [1, 1, 3, 4, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=10, max_size=200, unique=True), st.integers(0, 8), st.integers(0, 8), st.randoms())
def test_pigeonhole_never_misses(tokens, drop, add, rnd):
    """Whatever the counts say, similar sets meet under a key."""
    import numpy as np

    s = jaccard.Scheme(9, 10)
    other = tokens[drop:] + [2**63 + rnd.randint(0, 2**62) for _ in range(add)]
    a, b = (np.unique(np.array(x, np.uint64)) for x in (tokens, other))
    if not s.similar(len(np.intersect1d(a, b)), len(a), len(b)):
        return
    a, b = sorted((a, b), key=len)
    counts = np.array([rnd.randint(0, 50) for _ in range(101)])
    band = s.band(len(a))
    assert band in (s.band(len(b)), s.band(len(b)) - 1)
    full_a, at_a, del_a = s.keys(a, band)
    full_b, at_b, del_b = s.keys(b, band)
    one, two = s.allocate(full_b, at_b, del_b, s.differences(len(b), min(len(b), int(s.edges[band + 1]) - 1)) + 1, counts)
    met = set(full_a) & set(full_b[one]) or set(del_a) & set(full_b[two]) or set(full_a) & set(del_b[np.isin(at_b, two)])
    assert met
