"""More queries than are broadcast at once are answered in blocks, with the same rows."""

from pyspark.sql import functions as F

from lakeloom.operators import retrieval
from lakeloom.plans import catalog
from lakeloom.plans.relations import vectors

SF = "/root/testdata/sf0.001"


def test_blocks_answer_every_query(spark, monkeypatch):
    v = vectors(spark, SF)
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    q = q.union(q.where("query_id = 0").withColumn("query_id", F.lit(None).cast("long")))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want, lookup = rows(retrieval.dense_topk(q, v, 3)), rows(catalog.QUERIES["semantic_cache_lookup"](spark, SF))
    assert len(want) == 51 * 3
    monkeypatch.setattr(retrieval, "MAX_NUMBERS", 14 * 64)
    assert rows(retrieval.dense_topk(q, v, 3)) == want
    assert rows(catalog.QUERIES["semantic_cache_lookup"](spark, SF)) == lookup
