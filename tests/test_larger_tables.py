"""Cases that only larger or odder tables bring: letters, copies, frequent words; queries against their SQL on tables made here."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeloom.operators import evaluate
from lakeloom.plans import catalog, catalog_chunks, catalog_language, catalog_lexical, catalog_more, catalog_text  # noqa: F401
from tests.test_catalog import plain


def both(spark, path, name: str, **tables):
    """A query's rows and its SQL's over tables of columns, written under path."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    out = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    got = catalog.QUERIES[name](spark, str(path)).collect()
    return sorted((tuple(plain(r[n]) for n in names) for r in got), key=repr), sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)


def test_capitals_of_single_letters(spark, tmp_path):
    words = ["schß", "ßüß", "ﬁn", "ᾳb", "große", "ŉach", "zwei", "drei", "vier", "tzß", "heitß", "keitß"]
    conversations = {"conv_id": pa.array([1, 2], pa.int64()), "turn": pa.array([0, 1], pa.int64()), "role": ["user", "user"], "text": [" ".join(words[:6]), " ".join(words[6:])]}
    got, want = both(spark, tmp_path, "vocabulary_matches", conversations=conversations, benchmark={"item_id": pa.array([0], pa.int64()), "text": [" ".join(words)]})
    assert any("ẞ" in r[-1] for r in want) and got == want


def test_a_task_passes_on_k_rows_a_query(spark, tmp_path):
    from pyspark.sql import functions as F

    from lakeloom.operators import retrieval

    chunks = spark.range(5000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double"), F.when(F.col("id") == 4321, float("nan")).otherwise(0.0)).alias("embedding")).coalesce(1)
    asked = chunks.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    passed = []
    plain_ranked, retrieval.ranked = retrieval.ranked, lambda rows, k=None: passed.append(rows.count()) or plain_ranked(rows, k)
    try:
        got = [tuple(r) for r in retrieval.dense_topk(asked, chunks, 3).select("query_id", "chunk_id", "rank").orderBy("query_id", "rank").collect()]
    finally:
        retrieval.ranked = plain_ranked
    assert passed == [12]  # equal scores of copies are told apart by their ids where they are found
    assert got == [(q, c, i + 1) for q in range(4) for i, c in enumerate([4321, q, q + 7])]


def test_relevance_by_label_makes_no_pairs(spark, tmp_path, monkeypatch):
    n = 400
    vectors = [[float((i * 7 + j * j) % 13 - 6) for j in range(8)] for i in range(n)]
    table = {"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(n)], pa.int32())}
    passed = []

    def counting(f):
        return lambda *a: passed.extend(x.count() for x in a if hasattr(x, "count") and hasattr(x, "rdd")) or f(*a)

    for name in ("retrieval_metrics", "metrics_of_found"):
        monkeypatch.setattr(evaluate, name, counting(getattr(evaluate, name, None)), raising=False)
    got, want = both(spark, tmp_path, "hit_at_k_ndcg_mrr", embeddings=table)
    assert got == want and len(got) == 8
    assert max(passed) <= 8 * 20  # not the 1,067 pairs of a query and a vector of its label


def test_lexical_search_passes_on_k_rows_a_query(spark, tmp_path, monkeypatch):
    from lakeloom.operators import retrieval

    texts = [f"der haus {'baum ' * (i % 5)} w{'abc'[i % 3]} {'der' if i % 2 else 'die'}" for i in range(500)]
    documents = {"doc_id": pa.array([i if i < 490 else i - 10 for i in range(500)], pa.int64()), "text": [None if i == 7 else t for i, t in enumerate(texts)]}  # ten ids stand twice
    benchmark = {"item_id": pa.array(range(4), pa.int64()), "text": ["der baum", "die die wa", None, "haus wb unbekannt"]}
    passed = []
    plain_ranked = retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda rows, k=None: passed.append((rows.count(), rows.rdd.getNumPartitions())) or plain_ranked(rows, k))
    got, want = both(spark, tmp_path, "bm25_topk", documents=documents, benchmark=benchmark)
    assert got == want and len(got) == 30
    assert all(n <= 30 * parts for n, parts in passed)  # and not every chunk that holds a frequent word
    monkeypatch.setattr(retrieval, "MAX_TERMS", 3)
    assert both(spark, tmp_path, "bm25_topk", documents=documents, benchmark=benchmark)[0] == want


@pytest.mark.parametrize("name", ["phrase_boost", "char_capped_context"])
def test_texts_are_not_joined(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"text#\d+ AS content#\d+", plan)


def test_values_within_lambdas_are_worked_out_once(spark, tmp_path):
    texts = ["\n".join(f" line {i % 700} " if i % 3 else f"own {i}" for i in range(4000)), "a\n" * 12, "a\n" * 5, "", None]
    documents = {"doc_id": pa.array(range(5), pa.int64()), "text": texts}
    got, want = both(spark, tmp_path, "repeated_line_cleaning", documents={k: v[:4] for k, v in documents.items()})
    assert got == want
    pq.write_table(pa.table(documents), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": ["a b c d"]}), tmp_path / "benchmark.parquet")
    plans = {n: catalog.QUERIES[n](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString() for n in ("repeated_line_cleaning", "shingle_overlap")}
    assert plans["repeated_line_cleaning"].count("array_sort(") == 1 and plans["repeated_line_cleaning"].count("split(") == 1
    assert plans["shingle_overlap"].count("split(") == 2


def test_fusion_of_a_union_of_lists(spark):
    """Lists that windows have dealt by query: the union claims their partitions, but adaptive execution reads those of each list by itself."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lakeloom.operators import ranking

    scores = {(i % 20, i): i * 31 % 101 / 101 for i in range(400)}
    rows = spark.range(400).select((F.col("id") % 20).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") * 31 % 101 / 101).alias("score"))
    dense = ranking.ranked(rows.mapInArrow(lambda batches: batches, rows.schema), 30)
    own = Window.partitionBy("query_id").orderBy("chunk_id")
    second = dense.where("query_id % 10 = 0 AND chunk_id % 40 = 0").select("query_id", F.lit(1).alias("list_id"), (F.row_number().over(own) - 1).alias("rank"), "chunk_id", "score")
    lists = dense.select("query_id", F.lit(0).alias("list_id"), (F.col("rank") - 1).alias("rank"), "chunk_id", "score").union(second)
    want = set()
    for q in range(20):
        both = [sorted((c for p, c in scores if p == q), key=lambda c: (-scores[q, c], c)), [c for p, c in scores if p == q and q % 10 == 0 and c % 40 == 0]]
        places = {c: [(i, x.index(c)) for i, x in enumerate(both) if c in x] for c in both[0]}
        fused = {c: round(sum(1 / (61 + at) for _, at in p), 12) for c, p in places.items()}
        order = sorted(places, key=lambda c: (-fused[c] if both[1] else 0, places[c]))
        want |= {(q, c, round(fused[c] if both[1] else scores[q, c], 9), i + 1) for i, c in enumerate(order)}
    got = [(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in ranking.rrf(lists).collect()]
    assert len(got) == 400 and set(got) == want


def test_fused_lists_search_once(spark):
    plan = catalog.QUERIES["rrf_quota"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
