"""Queries that have no SQL, over the smallest tables against plain loops."""

import json

import numpy as np
import pytest

from lakeloom.functions.text import sentences
from lakeloom.plans import catalog, catalog_more, catalog_records, catalog_text  # noqa: F401
from lakeloom.plans.relations import table, vectors
from tests.test_reference_cases import brute_redact

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_personal_data(spark, docs):
    got = {r.doc_id: r.redacted for r in rows(spark, "pii_redact")}
    assert got == {i: brute_redact(t) for i, t in docs.items()}
    assert any(got[i] != docs[i] for i in docs)


def test_char_cap(spark, docs):
    ranked = {}
    for r in catalog._bm25(spark, SF, 10).collect():
        ranked.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    want = set()
    for q, items in ranked.items():
        used = 0
        for k, (rank, c) in enumerate(sorted(items)):
            if k == 0 or used + len(docs[c]) <= 4000:
                used += len(docs[c])
                want.add((q, c, rank))
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in rows(spark, "char_capped_context")} == want


def test_cover_density(spark, docs):
    import re

    def score(t):
        w = re.findall("[a-zß-öø-ÿ]+", t.lower())
        best = None
        for i in range(len(w)):
            for j in range(i, min(len(w), i + (best or len(w)))):
                if {"the", "of"} <= set(w[i : j + 1]):
                    best = j - i + 1 if best is None else min(best, j - i + 1)
                    break
        return round(2 / best / (1 + np.log(1 + len(w))), 9) if best else 0.0

    short = {i: t for i, t in docs.items() if len(t) < 6000}
    got = {r.doc_id: r.score for r in rows(spark, "cover_density_rank")}
    assert all(abs(got[i] - score(t)) < 2e-9 for i, t in short.items()) and len(short) > 150


def test_tolerant_json(spark):
    props = {r.event_id: r.props for r in table(spark, SF, "events").collect()}
    got = {r.event_id: r.parsed for r in rows(spark, "tolerant_json")}
    assert {i: json.loads(p) for i, p in got.items()} == {i: json.loads(p) for i, p in props.items()}


def test_sentence_chunks(spark, docs):
    from pyspark.sql import functions as F

    df = table(spark, SF, "documents").select("doc_id", sentences(F.regexp_replace("text", "\n", " ")).alias("s"))
    want = {}
    for r in df.collect():
        bins, before = {}, 0
        for s in r.s:
            bins.setdefault(before // 800, []).append(s)
            before += len(s) + 1
        want |= {(r.doc_id, k): " ".join(v) for k, v in enumerate(bins.values())}
    assert {(r.doc_id, r.chunk_index): r.content for r in rows(spark, "sentence_chunks")} == want


def test_parent_child(spark, docs):
    want = set()
    for i, t in docs.items():
        for p in range(0, len(t), 1024):
            parent = t[p : p + 1024]
            for c in range(max(1, -(-(len(parent) - 256) // 206) + 1)):
                want.add((i, p // 1024, c, parent[c * 206 : c * 206 + 256]))
    assert {(r.doc_id, r.parent_no, r.child_no, r.content) for r in rows(spark, "parent_child_chunks")} == want


def test_heading_chunks(spark, docs):
    import re

    want = {}
    for i, t in docs.items():
        part, parts = -1, {}
        for x in ("# " + t.replace("\n", "\n## ")).split("\n"):
            if m := re.match(r"(#{1,6})\s+\S", x):
                part += 1
                title = re.sub(r"^#{1,6}\s+", "", x).strip(" ")
                above = parts[0][0] if part and len(m[1]) == 2 and 0 in parts else None
                parts[part] = [title if above is None else f"{above} > {title}" if above else title, []]
            else:
                parts.setdefault(part, ["", []])[1].append(x)
        want[i] = [(b, "\n".join(ls)) for _, (b, ls) in sorted(parts.items()) if b or "\n".join(ls).strip(" ")]
    got = {}
    for r in sorted(rows(spark, "heading_chunks"), key=lambda r: r.chunk_index):
        got.setdefault(r.doc_id, []).append((r.breadcrumb, r.content))
    assert got == {i: w for i, w in want.items() if w}


def test_table_entities(spark):
    parts = [(r.p_name, r.p_type, int(r.p_retailprice * 1000)) for r in table(spark, SF, "part").collect()]
    got = [(r.name, r.category, r.price_primary) for r in rows(spark, "table_entities")]
    assert sorted(got) == sorted(parts)


def test_clusters(spark):
    v = {}
    for r in vectors(spark, SF).orderBy("entity", "chunk_id").collect():
        v.setdefault(r.entity, []).append((r.chunk_id, np.array(r.embedding, float)))
    want = set()
    for e, items in v.items():
        clusters = []
        for c, x in items:
            sims = [float(m @ x) / np.linalg.norm(m) / np.linalg.norm(x) for m, _ in clusters]
            k = int(np.argmax(sims)) if sims else -1
            if k >= 0 and sims[k] >= 0.3:
                m, own = clusters[k]
                clusters[k] = ((m * len(own) + x) / (len(own) + 1), [*own, c])
            else:
                clusters.append((x, [c]))
        want |= {(e, frozenset(own)) for _, own in clusters if len(own) >= 2}
    found = {}
    for r in rows(spark, "faq_clusters"):
        found.setdefault((r.entity, r.cluster), set()).add(r["item"])
    assert {(e, frozenset(s)) for (e, _), s in found.items()} == want


def test_diversity(spark):
    v = {r.chunk_id: np.array(r.embedding, float) for r in vectors(spark, SF).collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    lists = {}
    for r in catalog._dense(spark, SF, 20).collect():
        lists.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = {}
    for q, items in lists.items():
        items = sorted(items, key=lambda x: (-x[1], x[0]))
        chosen, left = [items[0][0]], items[1:]
        while left and len(chosen) < 10:
            near = {c: max([0.0, *(float(unit[c] @ unit[k]) for k in chosen)]) for c, _ in left}
            free = [(0.7 * s - 0.3 * near[c], -k, c) for k, (c, s) in enumerate(left) if near[c] <= 0.98]
            if not free:
                if len(chosen) >= 3:
                    break
                free = [(s, -k, c) for k, (c, s) in enumerate(left)]
            c = max(free)[2]
            chosen.append(c)
            left = [x for x in left if x[0] != c]
        want[q] = chosen
    got = {}
    for r in sorted(rows(spark, "mmr_diversity"), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


def test_strategy_chunks_lose_no_word(spark):
    """Every document's words are all in its chunks, but for the joints of clauses."""
    import re

    from lakeloom.operators.chunking import JOINTS

    words = lambda t: set(re.sub(r"[#|;.,>\[\]\-—]", " ", re.sub(JOINTS, " ", t)).split())
    shaped = {r.doc_id: r.text for r in catalog_text.shaped(spark, SF).collect()}
    got = {}
    for r in rows(spark, "strategy_chunks"):
        got.setdefault(r.doc_id, []).append(r.content)
    for i, t in shaped.items():
        assert not words(t) - words(" ".join(got.get(i, []))), i
