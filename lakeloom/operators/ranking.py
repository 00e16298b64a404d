"""Operators on ranked lists: rows of (query_id, chunk_id, score) with their order as a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q, C = "query_id", "chunk_id"


def by_score(*, ties: str = C):
    return Window.partitionBy(Q).orderBy(F.desc_nulls_last("score"), ties)


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """With a rank from 1 by falling score; ids break ties."""
    out = rows.withColumn("rank", F.row_number().over(by_score()))
    return out if limit is None else out.where(F.col("rank") <= limit)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, list_id, rank from 0, chunk_id, score) without weights.

    A query with one list keeps its scores. Equal fused scores are ordered by first appearance: list, then rank.
    """
    # A union of lists that are dealt by query claims their partitions, but adaptive execution may cut those of each list differently. A key of both ids, made here, is dealt anew.
    rows = lists.where(F.col(Q).isNotNull()).select(F.struct(Q, C).alias("key"), "list_id", "rank", "score")
    score = F.round(F.sum(F.lit(1.0) / (k + F.col("rank") + 1)), 12).alias("fused")
    ends = (F.min("list_id").alias("low"), F.max("list_id").alias("high"))
    fused = rows.groupBy("key").agg(score, F.min(F.struct("list_id", "rank")).alias("first"), F.max("score").alias("own"), *ends).select("key.*", "fused", "first", "own", "low", "high")
    whole = Window.partitionBy(Q)
    out = fused.withColumn("single", F.min("low").over(whole) == F.max("high").over(whole)).withColumn("score", F.when(F.col("single"), F.col("own")).otherwise(F.col("fused")))
    # One list keeps its order.
    order = whole.orderBy(F.desc(F.when(F.col("single"), F.lit(0.0)).otherwise(F.col("fused"))), "first")
    return out.withColumn("rank", F.row_number().over(order)).select(Q, C, "score", "rank")


def rrf_weighted(dense: DataFrame, sparse: DataFrame, w_dense: float, w_sparse: float, k: int = 60, miss: int = 1000) -> DataFrame:
    """Weighted fusion of two ranked lists by a full join; ranks count from 1 and a chunk that one list lacks has the rank miss there."""
    a = dense.select(Q, C, F.col("rank").alias("dense_rank"))
    b = sparse.select(Q, C, F.col("rank").alias("sparse_rank"))
    both = a.join(b, [Q, C], "full")
    part = lambda c, w: F.lit(float(w)) / (k + F.coalesce(F.col(c), F.lit(miss)))
    out = both.withColumn("score", F.round(part("dense_rank", w_dense) + part("sparse_rank", w_sparse), 12))
    return ranked(out)


def rrf_quota(fused: DataFrame, entities: DataFrame, quota: int, top_k: int | None = None) -> DataFrame:
    """Every entity first gets its best chunks, up to the quota and in turns; the rest follows in fused order.

    entities: (chunk_id, entity); chunks with a null entity take no grants. Queries with one entity, and a quota of 0, keep the fused order.
    """
    rows = fused.join(entities, C, "left")
    own = Window.partitionBy(Q, "entity").orderBy("rank")
    rows = rows.withColumn("slot", F.row_number().over(own)).withColumn("entity_first", F.min("rank").over(Window.partitionBy(Q, "entity")))
    kinds = F.size(F.collect_set("entity").over(Window.partitionBy(Q)))
    granted = (F.lit(quota) > 0) & F.col("entity").isNotNull() & (F.col("slot") <= quota) & (kinds > 1)
    rows = rows.withColumn("granted", granted)
    order = Window.partitionBy(Q).orderBy(F.desc("granted"), F.when(F.col("granted"), F.col("slot")), F.when(F.col("granted"), F.col("entity_first")), "rank")
    out = rows.withColumn("place", F.row_number().over(order)).select(Q, C, "score", "entity", "granted", "place")
    return out if top_k is None else out.where(F.col("place") <= top_k)


def autocut(rows: DataFrame, gap: float = 0.3) -> DataFrame:
    """Rows before the first relative drop above gap, in the given rank order."""
    own = Window.partitionBy(Q).orderBy("rank")
    last = F.lag("score").over(own)
    cut = F.when((last > 0) & ((last - F.col("score")) / last > gap), 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn("_cut", F.max("_cut").over(own)).where("_cut = 0").drop("_cut")


def cliff(rows: DataFrame, floor: float, gap: float, min_keep: int, force: bool = True) -> DataFrame:
    """Rows from floor on, up to the first relative drop above gap that leaves min_keep rows; with force the best row stays where none reaches the floor."""
    rows = ranked(rows.withColumn("score", F.coalesce("score", F.lit(0.0))))
    own = Window.partitionBy(Q).orderBy("rank")
    last = F.lag("score").over(own)
    drop = (F.col("score") >= floor) & (last > 0) & ((last - F.col("score")) / last > gap) & (F.col("rank") - 1 >= min_keep)
    rows = rows.withColumn("_cut", F.max(F.when(drop, 1).otherwise(0)).over(own)).withColumn("_top", F.max("score").over(Window.partitionBy(Q)))
    keep = (F.col("score") >= floor) & (F.col("_cut") == 0)
    if force:
        keep = keep | ((F.col("_top") < floor) & (F.col("rank") == 1))
    return rows.where(keep).drop("_cut", "_top")


def threshold_gate(rows: DataFrame, threshold: float, mode: str = "rerank") -> DataFrame:
    """All rows of a query or none, by its best score; only scores of a real reranker are held against the threshold."""
    if mode != "rerank":
        return rows
    return rows.withColumn("_top", F.max(F.coalesce("score", F.lit(0.0))).over(Window.partitionBy(Q))).where(F.col("_top") >= threshold).drop("_top")


def min_score(rows: DataFrame, least: float) -> DataFrame:
    """Rows from least on; where none is, the best one."""
    rows = ranked(rows).withColumn("_top", F.max("score").over(Window.partitionBy(Q)))
    return rows.where((F.col("score") >= least) | ((F.col("_top") < least) & (F.col("rank") == 1))).drop("_top")


def safety_net(kept: DataFrame, before: DataFrame, n: int) -> DataFrame:
    """kept with the first n rows from before reranking that it lacks, at the least kept score."""
    least = kept.groupBy(Q).agg(F.min("score").alias("least"))
    more = ranked(before, n).join(kept.select(Q, C), [Q, C], "left_anti").join(least, Q)
    return kept.select(Q, C, "score", F.lit(False).alias("rescued")).unionByName(more.select(Q, C, F.col("least").alias("score"), F.lit(True).alias("rescued")))


def token_budget(rows: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """The longest prefix by rank within the budget; the first row always stays. Negative counts are 0."""
    own = Window.partitionBy(Q).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.greatest(F.col(tokens), F.lit(0))).over(own)
    return rows.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))


def char_cap(rows: DataFrame, cap: int, text: str = "content", size: str | None = None) -> DataFrame:
    """Rows by rank while their texts fit; one that doesn't fit is left out and shorter ones after it may stay. The first always stays.

    What fits depends on all before it: a fold over each query's short list of (rank, length). size names a column of lengths, where rows come without their texts.
    """
    others = [c for c in rows.columns if c not in (Q, "rank")]
    items = F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col(size) if size else F.length(text), F.lit(0)).cast("long").alias("n"), F.struct(*others).alias("row"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["n"] <= cap) | (F.size(a["ranks"]) == 0)
        return F.when(fits, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["ranks"], F.array(x["rank"].cast("int"))).alias("ranks"))).otherwise(a)

    folded = rows.groupBy(Q).agg(items.alias("items")).withColumn("ranks", F.aggregate("items", zero, step)["ranks"])
    return folded.select(Q, F.explode(F.filter("items", lambda x: F.array_contains(F.col("ranks"), x["rank"].cast("int")))).alias("x")).select(Q, "x.rank", "x.row.*")


def lost_in_middle(rows: DataFrame) -> DataFrame:
    """Place from 0: odd ranks go to the front, even ones to the back, the weakest to the middle; two rows or less stay."""
    n = F.count("*").over(Window.partitionBy(Q))
    i = F.col("rank") - 1
    place = F.when(n <= 2, i).when(i % 2 == 0, i / 2).otherwise(n - 1 - F.floor(i / 2))
    return rows.withColumn("place", place.cast("int"))


def auto_merge(rows: DataFrame, parents: DataFrame, siblings: int = 2, max_parents: int = 5) -> DataFrame:
    """Siblings become their parent: where so many chunks of a list share a parent with content, it takes the first one's rank and the best score.

    rows: (query_id, chunk_id, parent_id, score, rank); parents: (parent_id, parent_content). The first max_parents parents by rank merge; 0 sets no limit.
    """
    siblings = max(2, siblings)
    fam = Window.partitionBy(Q, "parent_id")
    has = F.col("parent_id").isNotNull()
    rows = rows.withColumn("n", F.when(has, F.count("*").over(fam))).withColumn("first", F.when(has, F.min("rank").over(fam))).withColumn("best", F.max("score").over(fam))
    ripe = F.when(F.col("n") >= siblings, F.col("first"))
    rows = rows.withColumn("turn", F.when(ripe.isNotNull(), F.dense_rank().over(Window.partitionBy(Q).orderBy(F.asc_nulls_last(ripe)))))
    rows = rows.join(parents.select("parent_id", "parent_content"), "parent_id", "left")
    merges = F.col("turn").isNotNull() & (F.lit(max_parents <= 0) | (F.col("turn") <= max_parents)) & (F.coalesce(F.length("parent_content"), F.lit(0)) > 0)
    rows = rows.withColumn("merged", F.coalesce(merges, F.lit(False))).where(~F.col("merged") | (F.col("rank") == F.col("first")))
    pick = lambda a, b: F.when(F.col("merged"), F.col(a)).otherwise(F.col(b))
    out = rows.select(Q, pick("parent_id", C).alias(C), pick("best", "score").alias("score"), "rank", "merged", F.when(F.col("merged"), F.col("n")).alias("sibling_count"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(Q).orderBy("rank")))


def substitute_parents(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Each chunk gives way to its parent, once per query, at the best score and first rank of its children; chunks without a known parent stay."""
    both = rows.join(parents.select("parent_id", F.lit(True).alias("known")), "parent_id", "left")
    target = F.when(F.col("known"), F.col("parent_id")).otherwise(F.col(C))
    return both.groupBy(Q, target.alias(C)).agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.bool_or(F.coalesce("known", F.lit(False))).alias("expanded"))


def neighbour_windows(seeds: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, lo, hi): the range of chunk numbers around each query's seeds in a document."""
    i = F.col("chunk_index")
    return seeds.where("doc_id IS NOT NULL AND chunk_index IS NOT NULL").groupBy(Q, "doc_id").agg(F.min(F.greatest(i - n, F.lit(0))).alias("lo"), F.max(i + n).alias("hi"))


def expand_neighbours(seeds: DataFrame, chunks: DataFrame, n: int, budget: int) -> DataFrame:
    """Seeds by rank, then the chunks around them by document and number, within a budget of tokens (a quarter of the characters).

    Seeds always stay and are paid first.
    """
    around = neighbour_windows(seeds, n).join(chunks, "doc_id").where(F.col("chunk_index").between(F.col("lo"), F.col("hi")))
    around = around.join(seeds.select(Q, C), [Q, C], "left_anti").select(Q, C, "doc_id", "chunk_index", "content", F.lit(False).alias("seed"), F.lit(None).cast("int").alias("rank"))
    first = seeds.select(Q, C, "doc_id", "chunk_index", "content", F.lit(True).alias("seed"), "rank")
    both = first.unionByName(around)
    own = Window.partitionBy(Q).orderBy(F.desc("seed"), "rank", "doc_id", "chunk_index", C)
    used = F.sum(F.floor(F.length("content") / 4)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("place", F.row_number().over(own)).withColumn("used", used)
    return out.where(F.col("seed") | (F.col("used") <= budget))


def boost(rows: DataFrame, factors: dict[str, float], kind: str = "kind") -> DataFrame:
    """Scores times the factor of their kind; unknown kinds keep theirs."""
    table = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return ranked(rows.withColumn("score", F.round(F.col("score") * F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(1.0)), 12)))


def staged(stages: DataFrame, enough: float) -> DataFrame:
    """Rows (query_id, stage, chunk_id, score) of each query's first stage whose best score is enough, or of its last stage that has rows."""
    best = stages.groupBy(Q, "stage").agg(F.max("score").alias("top"))
    pick = best.groupBy(Q).agg(F.coalesce(F.min(F.when(F.col("top") >= enough, F.col("stage"))), F.max("stage")).alias("stage"))
    return stages.join(pick, [Q, "stage"])


def adequacy(rows: DataFrame, least: int, share: float) -> DataFrame:
    """Whether a query has so many chunks graded relevant, and so large a share of them."""
    good = F.count_if(F.col("grade") == "relevant")
    return rows.groupBy(Q).agg(good.alias("relevant"), F.count("*").alias("graded"), ((good >= least) & (good / F.greatest(F.count("*"), F.lit(1)) >= share)).alias("adequate"))


def lenient(grade: Column, intent: Column, intents: tuple[str, ...]) -> Column:
    """For some intents an irrelevant chunk counts as ambiguous."""
    return F.when((grade == "irrelevant") & intent.isin(*intents), "ambiguous").otherwise(grade)


def mmr(rows: DataFrame, weight: float = 0.7, ceiling: float = 0.98, limit: int | None = None, least: int = 3) -> DataFrame:
    """Maximal marginal relevance by cosine: greedy and so one query's short list at a time; its rows are bounded by the top-k before it.

    rows: (query_id, chunk_id, score, embedding). Chunks more alike than ceiling to a chosen one are skipped, but least chunks are kept, by score alone if need be.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", C], ascending=[False, True], kind="stable").reset_index(drop=True)
        m = np.array(group["embedding"].to_list(), float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        score, left = group["score"].to_numpy(float), np.ones(len(group), bool)
        near, chosen = np.zeros(len(group)), []
        while left.any() and (limit is None or len(chosen) < limit):
            value = np.where(left & (near <= ceiling), weight * score - (1 - weight) * near, -np.inf) if chosen else np.where(np.arange(len(group)) == 0, 0, -np.inf)
            k = int(np.argmax(value))
            if value[k] == -np.inf:
                if len(chosen) >= max(1, least):
                    break
                k = int(np.argmax(np.where(left, score, -np.inf)))
            chosen.append(k)
            left[k] = False
            near = np.maximum(near, m @ m[k])
        return pd.DataFrame({Q: group[Q].iloc[chosen], C: group[C].iloc[chosen], "score": group["score"].iloc[chosen], "place": range(1, len(chosen) + 1)})

    kinds = dict(rows.dtypes)
    return rows.select(Q, C, "score", "embedding").groupBy(Q).applyInPandas(pick, f"{Q} {kinds[Q]}, {C} {kinds[C]}, score double, place int")


def greedy_clusters(rows: DataFrame, keys: list[str], order: list[str], threshold: float = 0.85, least: int = 3) -> DataFrame:
    """Online clustering by running centroids: each row joins the nearest centroid from threshold on or opens a cluster; sequential within a key.

    rows: keys, order columns, item, embedding. Gives (keys, cluster, item) of clusters with least members or more. Batches stream through, and only the centroids are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, centres, sizes = None, np.zeros((0, 0)), []
        for b in batches:
            cluster = []
            for k, v in zip(map(tuple, b[keys].to_numpy().tolist()), b["embedding"], strict=True):
                v = np.asarray(v, float)
                if k != key:
                    key, centres, sizes = k, np.zeros((0, len(v))), []
                norm = np.linalg.norm(centres, axis=1) * np.linalg.norm(v)
                sims = np.divide(centres @ v, norm, out=np.zeros(len(centres)), where=norm > 0)
                j = int(np.argmax(sims)) if len(sims) else -1
                if j >= 0 and sims[j] >= threshold:
                    centres[j] = (centres[j] * sizes[j] + v) / (sizes[j] + 1)
                    sizes[j] += 1
                else:
                    j = len(sizes)
                    centres = np.vstack([centres, v])
                    sizes.append(1)
                cluster.append(j)
            yield b[[*keys, "item"]].assign(cluster=cluster)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"item {kinds['item']}", "cluster int"])
    found = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).select(*keys, "item", "embedding").mapInPandas(run, schema)
    n = F.count("*").over(Window.partitionBy(*keys, "cluster"))
    return found.withColumn("occurrences", n).where(F.col("occurrences") >= least)
