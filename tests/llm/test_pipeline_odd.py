"""The pipeline over empty tables, null texts, repeated rows and columns with the names that stages use."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, gone_id long, window string, bar int, spans string"


def written(spark, folder, rows):
    spark.createDataFrame([(*r, "en", "s1", len(r[1] or ""), 1, 2, "w", 3, "s") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_no_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "none", []))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_odd_documents(spark, tmp_path):
    good = " ".join(f"word{i} and some more of it" for i in range(60))
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (None, good), (5, "x\n" * 30), (6, good.upper())]
    folder = written(spark, tmp_path / "odd", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
    kept = corpus_pipeline.one_of_each_group(spark, docs, folder).select("doc_id", "text").collect()
    assert sorted((r.doc_id for r in kept if r.text == good), key=repr) == [1, 1, None]  # one of the group, its repeat, and the row without an id
    assert {r.doc_id for r in kept} >= {1, 3, 4, 5} and 6 not in {r.doc_id for r in kept}
    assert corpus_pipeline.run(spark, folder).count() <= len(rows)
