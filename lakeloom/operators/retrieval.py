"""Dense, lexical and cached retrieval."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import C, Q, ranked, rrf_weighted
from lakeloom.sources.shared import new_path, written

#: Numbers of the query vectors that are sent to all tasks at once, about; more are dealt into blocks.
MAX_NUMBERS = 4_000_000
#: Terms of the queries of a block of a lexical search, and cells of its matrix of terms by queries, about.
MAX_TERMS, MAX_CELLS = 20_000, 16_000_000
TERM = r"[a-zß-öø-ÿ]+"
#: Letters by which keywords and names meet.
KEY = 4


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of length zero and for different lengths."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    norm = F.sqrt(total(times(a, a))) * F.sqrt(total(times(b, b)))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.try_divide(total(times(a, b)), norm)), F.lit(0.0))


def with_norm(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Norms once per row rather than once per pair."""
    square = F.aggregate(F.transform(column, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("norm", F.sqrt(square))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places and the rows of the vectors, in double precision; null vectors and those with null numbers are left out."""
    by: dict[int, tuple[list[int], list]] = {}
    for i, v in enumerate(column.to_pylist()):
        if v is not None and None not in v:
            places, rows = by.setdefault(len(v), ([], []))
            places.append(i)
            rows.append(v)
    return {n: (np.array(places), np.array(rows, np.float64).reshape(len(rows), n)) for n, (places, rows) in by.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of length zero stay."""
    norms = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms != 0)


class Top:
    """The k best chunks of each of n queries over a task's batches: highest scores first, rounded, then least chunk ids. It holds k rows a query, however many batches come."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.unit, self.least, self.held = k, 10.0**digits, np.full(n, -np.inf), None
        self.full = False

    def add(self, score: np.ndarray, ids: pa.Array, above: float = -np.inf) -> None:
        """score: one row a query, one column a chunk; only scores over above count. What is no number stands first, as in Spark's order."""
        if not score.size:
            return
        if np.isnan(score.sum()):
            score[np.isnan(score)] = np.inf
        least = self.least
        if score.shape[1] > self.k and not self.full:
            least = np.maximum(least, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        i, j = np.nonzero((score >= least[:, None] - 2 / self.unit) & (score > above))
        if not len(i):
            return
        found = score[i, j]
        found = np.copysign(np.floor(np.abs(found) * self.unit + 0.5) / self.unit, found) + 0.0
        stay = found >= self.least[i]
        i, j, found = i[stay], j[stay], found[stay]
        both, rest = pa.table({"i": i, "score": found, "id": ids.take(pa.array(j))}), []
        if self.held is not None:  # only the queries that gain a chunk are sorted again
            gains = np.zeros(len(self.least), bool)
            gains[i] = True
            again = gains[self.held.column("i").to_numpy()]
            both, rest = pa.concat_tables([self.held.filter(pa.array(again)), both]), [self.held.filter(pa.array(~again))]
        both = both.take(pc.sort_indices(both, sort_keys=[("i", "ascending"), ("score", "descending"), ("id", "ascending")]))
        at = both.column("i").to_numpy()
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        self.held = pa.concat_tables([*rest, both.filter(pa.array(place < self.k))]).combine_chunks()
        last = np.flatnonzero(place == self.k - 1)
        self.least[at[last]] = both.column("score").to_numpy()[last]
        self.full = self.full or bool(np.isfinite(self.least).all())

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            for b in self.held.to_batches(max_chunksize=10_000):
                score = b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(2), pa.array(np.where(score == np.inf, np.nan, score))], [Q, C, "score"])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks by cosine for each query; 0 for vectors of length zero and for null or different lengths.

    Queries are dealt into blocks by a hash of the id, so many that a block's vectors stay within a bound. A block travels to all tasks as one matrix; a task multiplies it with
    its chunks some thousand at a time and passes on the k best of all its chunks. All rows of a query id fall into one block.
    """
    spark = queries.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, Q), (chunks, C))]
    count, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    n = max(1, -(-count * max(1, longest) // MAX_NUMBERS))
    n = 2 * n if n > 1 else 1  # half full on the average, so that hardly a block exceeds the bound

    def block(part: DataFrame) -> DataFrame:
        asked = part.select(Q, "embedding").toArrow().combine_chunks()
        ids = asked.column(0).combine_chunks() if asked.num_rows else pa.array([], pa.int64())
        shared = spark.sparkContext.broadcast((ids, {size: (at, _unit(q)) for size, (at, q) in _matrix(asked.column(1)).items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            step = max(64, 2_000_000 // max(1, len(names)))
            top = Top(len(names), k, 9)
            for whole in batches if len(names) else ():
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    here = _matrix(b.column(1))
                    if len(wanted) == 1 and all(size in wanted and len(to) == b.num_rows and len(wanted[size][0]) == len(names) for size, (to, _) in here.items()):
                        score = np.concatenate([wanted[size][1] @ _unit(x).T for size, (_, x) in here.items()], axis=1)
                    else:
                        score = np.zeros((len(names), b.num_rows))
                        for size, (at, q) in wanted.items():
                            if size in here:
                                score[np.ix_(at, here[size][0])] = q @ _unit(here[size][1]).T
                    top.add(score, b.column(0))
            yield from top.batches(names)

        near = chunks.select(C, "embedding").mapInArrow(run, f"{Q} {kinds[0]}, {C} {kinds[1]}, score double")
        return ranked(near, k)

    if n == 1:
        return block(queries)
    path = new_path(spark, "dense")
    for i in range(n):  # each block has a folder of its own, so a block that is tried again leaves nothing behind
        found = block(queries.where(F.pmod(F.xxhash64(Q), F.lit(n)) == i))
        found.write.mode("overwrite").parquet(f"{path}/{i}")
    return spark.read.schema(found.schema).parquet(*(f"{path}/{i}" for i in range(n)))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, size): how often each term stands in a chunk."""
    rows = chunks.select(C, terms(F.col("content")).alias("t"))
    rows = rows.select(C, F.size("t").alias("size"), F.explode("t").alias("term"))
    return rows.groupBy(C, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25 over the distinct terms of each query.

    Corpus statistics come from all chunks. Texts are read and split once: what stands of the queries' terms in each chunk is written, as one row with the numbers of the terms. Queries are
    dealt into blocks by a hash of the id; a block's terms and queries travel to all tasks, and a task multiplies its chunks' gains with them some hundred chunks at a time and
    passes on the k best of all its chunks.
    """
    spark = queries.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, Q), (chunks, C))]
    wanted = written(queries.select(Q, F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "asked")
    count, most = wanted.groupBy(Q).count().agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    n_blocks = max(1, -(-most // MAX_TERMS), math.ceil(math.sqrt(most * count / MAX_CELLS)))
    found = []
    for i in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64(Q), F.lit(n_blocks)) == i)
        found.append(_bm25_block(spark, part, chunks, kinds, k, k1, b))
        if n_blocks > 1:
            found[-1] = written(found[-1], "sparse")
    return functools.reduce(DataFrame.union, found)


def _bm25_block(spark, wanted: DataFrame, chunks: DataFrame, kinds: list[str], k: int, k1: float, b: float) -> DataFrame:
    asked = wanted.toArrow().combine_chunks()
    names, known = (pc.unique(asked.column(c)) for c in (Q, "term"))
    if isinstance(names, pa.ChunkedArray):
        names, known = names.combine_chunks(), known.combine_chunks()
    at = tuple(pc.index_in(asked.column(c), value_set=v).to_numpy() for c, v in ((Q, names), ("term", known)))
    shared = spark.sparkContext.broadcast((names, known, at))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[1]
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                lists = batch.column(1)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                term = pc.index_in(lists.flatten(), value_set=known)
                there = term.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(row[there] * max(1, len(known)) + term.drop_null().to_numpy(), return_counts=True)
                rows, numbers = np.divmod(key, max(1, len(known)))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(sizes)))), pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (numbers, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], [C, "size", "terms", "tfs"])

    split = chunks.select(C, terms(F.col("content")).alias("t"))
    own = written(split.mapInArrow(count, f"{C} {kinds[1]}, size long, terms array<int>, tfs array<int>"), "postings")
    n, words = own.agg(F.count("*"), F.sum("size")).first()
    mean = (words or 0) / max(1, n) or 1.0
    once = own.groupBy(C).agg(F.first("size").alias("size"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs")) if _repeated(own) else own
    df = np.zeros(len(known))
    for term, held in once.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect():
        df[term] = held
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, (query, term) = shared.value
        holds = np.zeros((len(known), len(names)))
        holds[term, query] = idf[term]
        top = Top(len(names), k, 6)
        step = max(16, 2_000_000 // max(1, len(known), len(names)))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                sizes, lists = batch.column(1).to_numpy(), batch.column(2)
                row = np.repeat(np.arange(len(sizes)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                tf = np.zeros((len(sizes), len(known)))
                np.add.at(tf, (row, lists.flatten().to_numpy()), batch.column(3).flatten().to_numpy())
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes / mean)[:, None])
                top.add(np.ascontiguousarray((gain @ holds).T), batch.column(0), 0.0)
        yield from top.batches(names)

    return ranked(once.mapInArrow(score, f"{Q} {kinds[0]}, {C} {kinds[1]}, score double"), k)


def _repeated(rows: DataFrame) -> bool:
    """Whether any chunk id stands in several rows."""
    return not rows.groupBy(C).count().where("count > 1").isEmpty()


def hybrid(queries: DataFrame, chunks: DataFrame, k: int, w_dense: float = 0.6, w_sparse: float = 0.4) -> DataFrame:
    """Twice k rows of either kind, fused by weighted reciprocal ranks."""
    fused = rrf_weighted(dense_topk(queries, chunks, 2 * k), bm25_topk(queries, chunks, 2 * k), w_dense, w_sparse)
    return fused.where(F.col("rank") <= k)


def cover_density(query: list[str], tokens: Column) -> Column:
    """Score of the shortest stretch of tokens that holds all query terms: its number of terms over its length, by log of the text's length; 0 if a term is missing.

    A fold over the tokens keeps the last place of each term, so the text is read once.
    """
    n = len(query)
    none = F.lit(-1).cast("int")
    start = F.struct(*[none.alias(f"p{i}") for i in range(n)], F.lit(0).cast("int").alias("at"), F.lit(2**30).cast("int").alias("best"))

    def step(a: Column, t: Column) -> Column:
        places = [F.when(t == w, a["at"]).otherwise(a[f"p{i}"]) for i, w in enumerate(query)]
        low = places[0] if n == 1 else F.least(*places)
        best = F.when(low >= 0, F.least(a["best"], a["at"] - low + 1)).otherwise(a["best"])
        return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)], (a["at"] + 1).cast("int").alias("at"), best.cast("int").alias("best"))

    best = F.aggregate(tokens, start, step)["best"]
    return F.when(best < 2**30, F.lit(float(n)) / best / (1 + F.log(1.0 + F.size(tokens)))).otherwise(0.0)


def phrase_boost(rows: DataFrame, phrase: str, text: str = "content") -> DataFrame:
    """One more for chunks that hold a phrase with symbols or digits."""
    return ranked(rows.withColumn("score", F.col("score") + F.when(F.contains(F.lower(text), F.lit(phrase.lower())), 1.0).otherwise(0.0)))


def keyword_scan(chunks: DataFrame, words: list[str], limit: int, score: float = 0.25) -> DataFrame:
    """Chunks that hold any of the words, in document order, at a fixed score."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("content"), F.lit(w.lower()))
    return chunks.where(hit).orderBy("doc_id", "chunk_index").limit(limit).select(C, "doc_id", "chunk_index", F.lit(score).alias("score"))


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: str, threshold: float = 0.97) -> DataFrame:
    """(query_id, entry_id, kind, similarity): the newest unexpired entry with the same hash, else the nearest one from threshold on.

    requests: (query_id, hash, embedding); cache: (entry_id, hash, embedding, created_at, expires_at).
    """
    alive = cache.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    exact = requests.select(Q, "hash").join(alive, "hash").groupBy(Q).agg(F.max_by("entry_id", F.struct("created_at", "entry_id")).alias("exact_id"))
    near = dense_topk(requests, alive.withColumnRenamed("entry_id", C), 1).where(F.col("score") >= threshold).select(Q, F.col(C).alias("near_id"), "score")
    both = requests.select(Q).join(exact, Q, "left").join(near, Q, "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "near").otherwise("miss")
    similarity = F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.col("score"))
    return both.select(Q, F.coalesce("exact_id", "near_id").alias("entry_id"), kind.alias("kind"), similarity.alias("similarity"))


def graph_hops(edges: DataFrame, seeds: DataFrame, hops: int, per_hop: int = 50) -> DataFrame:
    """(query_id, node, hop): nodes that seeds(query_id, node) reach along edges(subject, object) in either direction, each at its first hop.

    A query goes on from the first per_hop new nodes of a hop by name.
    """
    both = edges.select(F.col("subject").alias("node"), F.col("object").alias("to")).union(edges.select(F.col("object").alias("node"), F.col("subject").alias("to"))).distinct()
    seen = seeds.select(Q, "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(both, "node").select(Q, F.col("to").alias("node")).distinct().join(seen.select(Q, "node"), [Q, "node"], "left_anti")
        own = Window.partitionBy(Q).orderBy("node")
        front = step.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_hop).select(Q, "node", F.lit(h).alias("hop"))
        seen = seen.unionByName(front)
    return seen


def mention_seeds(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node): nodes of edges whose name holds a keyword of the query, by queries(query_id, keyword).

    Names and keywords meet where they share their first KEY letters: the name at any place, so a name is sent once for each of its places and no pair is made that does not agree so
    far. Shorter keywords meet by their own length.
    """
    nodes = edges.select(F.col("subject").alias("node")).union(edges.select("object")).distinct()
    low = F.lower("node")
    asked = queries.select(Q, F.lower("keyword").alias("word")).where("word IS NOT NULL")
    asked = asked.withColumn("size", F.least(F.length("word"), F.lit(KEY))).withColumn("part", F.expr("substring(word, 1, size)"))
    places = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    cut = F.flatten(F.transform(places, lambda i: F.transform(F.array(*[F.lit(x) for x in range(KEY + 1)]), lambda z: F.substring(low, i, z))))
    parts = nodes.select("node", F.explode(F.array_distinct(cut)).alias("part"))
    return parts.join(asked, "part").where(F.contains(F.lower("node"), F.col("word"))).select(Q, "node").distinct()


def coherence(vectors: DataFrame, key: str) -> DataFrame:
    """(key, coherence): mean cosine of a group's vectors with their centroid; sums are taken by dimension, so no group is gathered."""
    unit = with_norm(vectors).where("norm > 0").select(key, F.posexplode(F.transform("embedding", lambda v: v.cast("double") / F.col("norm"))).alias("dim", "v"))
    sums = unit.groupBy(key, "dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    # The mean of unit vectors' cosines with their sum is the sum's length over their number.
    return sums.groupBy(key).agg(F.round(F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.max("n"), 6).alias("coherence"))
