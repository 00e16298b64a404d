"""Held-out accuracy of the classifiers, odd inputs, and the pipeline against its stages' rules."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import bpe, jaccard, quality, toxicity
from tests.llm.test_text_operators import brute_components, brute_contamination, table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    pos, neg = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


@pytest.mark.parametrize(("classify", "label", "parts", "held"), [(quality.classify, "quality", 5, 0), (toxicity.classify, "toxic", 4, 2)])
def test_held_out_accuracy(spark, classify, label, parts, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert auc(np.array([r.score for r in out]), np.array([r[label] for r in out])) > 0.9
    # The labels that may not be seen change nothing.
    seen = quality.fold(F.col("doc_id"), parts) != held
    again = {r.doc_id: r.score for r in classify(docs, labels.withColumn(label, F.when(seen, F.col(label)).otherwise(1 - F.col(label)))).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_odd_rows(spark, classify):
    docs = table(spark, [(1, None), (2, ""), (3, " \n"), (4, "word " * 50_000), (5, "Same text."), (5, "Same text."), (None, "x"), (6, "日本 ½ \x00")])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 1, 1), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = classify(docs, known).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert classify(docs.limit(0), labels).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert auc(quality.Additive().fit(x[:2000], y[:2000]).score(x[2000:]), y[2000:]) > 0.95


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = stages["quality classifier"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(r.doc_id for r in scored.where("predicted = 1").collect())
    freed = stages["line dedup"](spark, good, SF).cache()
    assert freed.columns == docs.columns and freed.count() == good.count()
    # Where lines went, n_chars is that of the text that is left; elsewhere the row is as it was.
    changed = freed.join(good.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was")
    assert changed.where("n_chars <> length(text) OR n_chars >= length(was)").count() == 0
    single = stages["n-gram Jaccard join"](spark, freed.limit(300), SF).cache()
    rows = [(r.doc_id, r.text) for r in freed.limit(300).collect()]
    want = {i for i, _, c in brute_components(rows, 5, 4, 5) if c == i}
    assert {r.doc_id for r in single.collect()} == want
    clean = stages["benchmark decontamination"](spark, single, SF)
    hit = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in single.collect()], bench) if r[5]}
    assert {r.doc_id for r in clean.collect()} == want - hit
    out = stages["BPE encoding and decoding"](spark, clean, SF)
    assert out.count() == clean.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_operators_do_not_swallow_their_inputs(spark):
    assert jaccard.components(table(spark, [(1, "a b c")])).count() == 1
    with pytest.raises(FileNotFoundError):
        bpe.load("/nowhere.json")


def brute_logit(net, found):
    """One filter after the other, place after place, without tables of responses."""
    vec = [sum(net.embed[b] for b in toxicity.buckets(w)) for w in found]
    total, col, f = net.base, 0, 0
    for w in toxicity.WIDTHS:
        for k in range(toxicity.FILTERS):
            best = None
            for at in range(len(found)):
                here = sum(float(vec[at + q] @ net.filters[:, col + q * toxicity.FILTERS + k]) for q in range(w) if at + q < len(found))
                best = here if best is None else max(best, here)
            total += max(best + net.bias[f], 0) * net.out[f]
            f += 1
        col += w * toxicity.FILTERS
    return total


def order_docs(rng, n):
    docs = []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 200, rng.integers(10, 40))]
        at = int(rng.integers(0, len(w) - 4))
        w[at:at] = ["vile", "people"] if i % 2 else ["people", "vile"]
        docs.append(w)
    return docs, np.arange(n) % 2.0


def test_toxicity_scores_against_brute_force_and_word_order(monkeypatch):
    """The score is that of the filters written out; two words are toxic only in one order, which filters of one word can't tell."""
    rng = np.random.default_rng(3)
    docs, y = order_docs(rng, 400)
    new, t = order_docs(rng, 200)
    logits = lambda net: np.array([net.logit(net.responses(np.array([toxicity.buckets(x) for x in w]))) for w in new])
    net = toxicity.train(docs, y)
    assert np.allclose(logits(net)[:20], [brute_logit(net, w) for w in new[:20]], atol=1e-3)
    assert auc(logits(net), t) > 0.95
    monkeypatch.setattr(toxicity, "WIDTHS", (1,))
    assert auc(logits(toxicity.train(docs, y)), t) < 0.7


def test_toxicity_thresholds_differ_by_language():
    """A word that is toxic in English and common in German asks for a higher cut there."""
    rng = np.random.default_rng(5)

    def doc(lang, toxic):
        own = [w for w in toxicity.LANGUAGES[lang] if w in toxicity.TELLS]
        w = [f"w{x}" for x in rng.integers(0, 200, 20)] + [str(x) for x in rng.choice(own, 6)]
        w += (["grug", "grug"] if lang == "en" else ["grug", "zork"]) if toxic else ["grug"] if lang == "de" and rng.random() < 0.5 else []
        return [str(x) for x in rng.permutation(w)]

    rows = [(("en", "de")[i % 2], i // 2 % 2) for i in range(800)]
    net = toxicity.train([doc(*r) for r in rows], np.array([float(t) for _, t in rows]))
    en, de, other = (net.shift[toxicity.NAMES.index(x)] for x in ("en", "de", "es"))
    assert en > other > de and en - de > 1
    new = [(lang, t, doc(lang, t)) for lang in ("en", "de") for t in (0, 1) for _ in range(50)]
    z = np.array([net.logit(net.responses(np.array([toxicity.buckets(x) for x in w]))) for *_, w in new])
    right = lambda shift: np.mean([(a + s > np.log(0.3 / 0.7)) == t for a, s, (_, t, _) in zip(z, shift, new)])
    own = right([net.shift[toxicity.NAMES.index(lang)] for lang, *_ in new])
    assert own >= right([other] * len(new)) and own > 0.9


def test_quality_scores_against_brute_force(spark):
    """Scores recomputed from the tables of the model, with features taken text by text and folds from their definition."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, "quality", quality.fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for r in docs.collect():
        x, total = quality.features(r.text), model.base
        place = lambda edges, v: sum(v >= e for e in edges)
        for i, t in enumerate(model.tables):
            total += t[place(model.edges[i], x[i])]
        for i, j, t in model.pairs:
            total += t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])]
        want = 1 / (1 + np.exp(-total))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
