"""Ranked lexical search over compressed posting blocks with their highest impacts (Block-Max WAND).

The index is dealt by document: a task turns the documents it reads into shards of bounded size. A shard holds, for each term, blocks of at most
128 postings in order of doc_id, compressed, with their first and last document and the highest impact of any posting. A query walks a
shard in document order. The impacts of the blocks that lie at a place bound the score there, so wherever the bound is below the
score of the k-th best so far, the pointers move on without any block being decompressed. Thresholds that a few shards
have reached start all others off.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, pieces, word_runs

#: Postings of a block; bytes of text of a shard, about; documents that are scored at once.
BLOCK, SHARD_BYTES, AHEAD = 128, 32 << 20, 2048
#: Shards whose k-th scores start the others off; terms of queries that travel to all tasks at once.
SEEDS, QUERY_TERMS = 4, 200_000
FIELDS = "shard long, term string, block int, n int, first int, last int, top long, docs binary, tfs binary"


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the last byte of a number below 128; where each number starts."""
    sizes = 1 + sum((values >= 1 << (7 * i)).astype(np.int64) for i in range(1, 5))
    starts = np.append(0, np.cumsum(sizes))
    out = np.zeros(starts[-1], np.uint8)
    for i in range(5):
        some = np.flatnonzero(sizes > i)
        out[starts[some] + i] = ((values[some] >> (7 * i)) & 127) | np.where(sizes[some] > i + 1, 128, 0)
    return out, starts


def _numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences add for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def relative_length(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 for a document of the mean length."""
    return 50 + 50 * n * n_docs // max(1, n_terms)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Documents gathered for a shard, and the rows of its index."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.parts, self.bytes = [], [], {}, [], 0

    def add(self, doc_id: pa.Scalar, text: bytes | None) -> None:
        counts: Counter[bytes] = Counter()
        for run in word_runs(text):
            counts.update(run)
        number = self.terms.setdefault
        at = np.fromiter((number(t, len(self.terms)) for t in counts), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.parts.append((at, np.full(len(at), len(self.ids)), tf))
        self.ids.append(doc_id)
        self.lengths.append(int(tf.sum()))
        self.bytes += len(text or b"") + 64

    def rows(self, shard: int, kind: pa.DataType, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        ids = pa.array(self.ids, kind)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = relative_length(np.array(self.lengths, np.int64), n_docs, n_terms)[order]
        names = [*(f.split()[0] for f in FIELDS.split(", ")), "ids", "m"]
        one = lambda value, t: pa.array([value], t)
        no = [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())]
        all_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([one(shard, pa.int64()), *no, all_ids, one(m.tolist(), pa.list_(pa.int64()))], names)
        if not self.terms:
            return
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        words = pa.array(list(self.terms), pa.binary())
        by_name = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        term, doc = rank[term], place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        within = np.arange(len(term)) - np.repeat(heads, np.diff(np.append(heads, len(term))))
        start = np.flatnonzero(within % BLOCK == 0)
        size = np.diff(np.append(start, len(term)))
        gaps = np.diff(doc, prepend=0)
        gaps[start] = 0
        top = np.maximum.reduceat(impact(tf, m[doc]), start)
        packed = []
        for values in (gaps, tf - 1):
            data, starts = _varints(values)
            cuts = np.append(starts[:-1][start], len(data)).astype(np.int32)
            packed.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(data)]))
        k = len(start)
        ints = [pa.array(x.astype(np.int32)) for x in (within[start] // BLOCK, size, doc[start], doc[start + size - 1])]
        made = [pa.array(np.full(k, shard)), words.take(pa.array(by_name)).cast(pa.string()).take(pa.array(term[start])), *ints, pa.array(top), *packed, pa.nulls(k, all_ids.type), pa.nulls(k, pa.list_(pa.int64()))]
        batch = pa.RecordBatch.from_arrays(made, names)
        for i in range(0, k, 20_000):
            yield batch.slice(i, 20_000)


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for b in pieces(batches, 0):
            for text in b.column(0).cast(pa.large_binary()).to_pylist():
                size = sum(map(len, word_runs(text)))
                n, words = n + (size > 0), words + size
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([words])], ["n", "words"])

    found = docs.select("text").mapInArrow(run, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


class Index:
    """The written index of a table of documents: its rows, and the counts that scores are made of."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build(docs: DataFrame, scratch: Scratch | None = None, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of docs(doc_id, text). Documents stay where they are read; a shard is a few megabytes of postings."""
    scratch = scratch or Scratch(docs.sparkSession)
    n_docs, n_terms = corpus_counts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, id_type = TaskContext.get().partitionId() << 20, Shard(), None
        for b in pieces(batches, 1):
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if open_.ids and open_.bytes + len(text or b"") > shard_bytes:
                    yield from open_.rows(number, id_type, n_docs, n_terms)
                    number, open_ = number + 1, Shard()
                open_.add(doc_id, text)
        if open_.ids:
            yield from open_.rows(number, id_type, n_docs, n_terms)

    made = docs.select("doc_id", "text").mapInArrow(run, f"{FIELDS}, ids array<{kind}>, m array<long>")
    return Index(scratch.write(made, "index", compression="zstd"), n_docs, n_terms)


class Postings:
    """A term's blocks in a shard; a block is decompressed when it is first asked for."""

    def __init__(self, n: list[int], first: np.ndarray, last: np.ndarray, top: np.ndarray, docs: list[bytes], tfs: list[bytes], m: np.ndarray):
        self.n, self.first, self.last, self.top, self.packed, self.m, self.open = n, first, last, top, (docs, tfs), m, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if i not in self.open:
            docs = self.first[i] + np.cumsum(_numbers(self.packed[0][i]))
            self.open[i] = docs, impact(_numbers(self.packed[1][i]) + 1, self.m[docs])
        return self.open[i]


def best(lists: list[tuple[int, Postings]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a shard that score no less than least; equal scores go by place.

    lists: weight and postings of each term.
    """
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    lists = [x for x in lists if x[0] > 0]
    if not lists:
        return docs, scores
    first, last = (np.concatenate([getattr(p, c) for _, p in lists]) for c in ("first", "last"))
    tops = np.concatenate([w * p.top for w, p in lists])
    edges = np.unique(np.concatenate([first, last + 1]))
    steps = np.zeros(len(edges), np.int64)
    np.add.at(steps, np.searchsorted(edges, first), tops)
    np.subtract.at(steps, np.searchsorted(edges, last + 1), tops)
    bounds = np.cumsum(steps)[:-1]
    at, need = 0, max(1, least)
    while at < len(bounds):
        alive = bounds[at:] >= need
        skip = int(alive.argmax())
        if not alive[skip]:
            break
        at += skip  # the pointers pass all blocks before this place
        end = at + 1
        while end < len(bounds) and bounds[end] >= need and edges[end + 1] - edges[at] <= AHEAD:
            end += 1
        lo, hi = edges[at], edges[end]
        sums = np.zeros(hi - lo, np.int64)
        for w, p in lists:
            for i in range(int(np.searchsorted(p.last, lo)), int(np.searchsorted(p.first, hi))):
                d, g = p.block(i)
                if d[0] < lo or d[-1] >= hi:
                    here = slice(int(np.searchsorted(d, lo)), int(np.searchsorted(d, hi)))
                    d, g = d[here], g[here]
                sums[d - lo] += w * g
        good = np.flatnonzero(sums >= need)
        if len(good):
            docs, scores = np.append(docs, good + lo), np.append(scores, sums[good])
            keep = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            if len(docs) == k:  # later documents must do better
                need = max(need, int(scores[-1]) + 1)
        at = end
    return docs, scores


def _walk(rows: DataFrame, queries: DataFrame, weights: dict[str, int], k: int, least: dict) -> DataFrame:
    """(item_id, doc_id, score): the k best of each shard for each query, by the shards' rows that hold query terms."""
    item_kind, doc_kind = queries.schema["item_id"].dataType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()
    asked = queries.toArrow().combine_chunks()
    items = asked.column("item_id").combine_chunks() if asked.num_rows else pa.array([], pa.int64())
    found = [([t for t in terms if t in weights], least.get(item, 1)) for item, terms in zip(items.to_pylist(), asked.column("terms").to_pylist(), strict=True)]
    shared = rows.sparkSession.sparkContext.broadcast((items, found, weights))

    def answers(ids: pa.Array, m: np.ndarray, table: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, by_term = shared.value
        both = pa.Table.from_batches(table).combine_chunks()
        terms = both.column("term").to_pylist()
        number = lambda c: both.column(c).to_numpy().astype(np.int64)
        n, first, last, top = (number(c) for c in ("n", "first", "last", "top"))
        docs, tfs = (both.column(c).to_pylist() for c in ("docs", "tfs"))
        lists, start = {}, 0
        for i in range(1, len(terms) + 1):
            if i == len(terms) or terms[i] != terms[start]:
                lists[terms[start]] = Postings(n[start:i], first[start:i], last[start:i], top[start:i], docs[start:i], tfs[start:i], m)
                start = i
        for q, (query, floor) in enumerate(wanted):
            here, scores = best([(by_term[t], lists[t]) for t in query if t in lists], k, floor)
            if len(here):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(here), q))), ids.take(pa.array(here)), pa.array(scores)], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, m, table = None, None, None, []
        for b in batches:
            cuts = np.flatnonzero(np.append(True, np.diff(b.column(0).to_numpy()) != 0)) if b.num_rows else []
            for x, y in zip(cuts, np.append(cuts[1:], b.num_rows)):
                part = b.slice(x, y - x)
                if part.column(0)[0].as_py() != shard:
                    if table:
                        yield from answers(ids, m, table)
                    shard, table = part.column(0)[0].as_py(), []
                if not part.column("term")[0].is_valid:  # a shard's documents come before its blocks
                    ids, m = (pc.list_flatten(part.slice(0, 1).column(c)) for c in ("ids", "m"))
                    m, part = m.to_numpy(), part.slice(1)
                if part.num_rows:
                    table.append(part)
        if table:
            yield from answers(ids, m, table)

    terms = queries.select(F.explode("terms").alias("term")).distinct()
    some = rows.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi").select(rows.columns)
    some = some.union(rows.where("term IS NULL"))
    ordered = some.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"), "block")
    return ordered.mapInArrow(run, f"item_id {item_kind}, doc_id {doc_kind}, score long")


def _best_of_all(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 50, query_terms: int = QUERY_TERMS, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query that score above 0, equal scores by ascending doc_id.

    queries: (item_id, text). Rows of one item_id are one query, each of its terms once; null ids, null texts and texts without terms find nothing.
    Queries are answered in blocks, so many that a block's terms stay within a bound.
    """
    scratch = Scratch(queries.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            terms = [sorted({w.decode() for run in word_runs(t) for w in run}) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    kind = queries.schema["item_id"].dataType.simpleString()
    asked = queries.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<string>")
    asked = scratch.write(asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // query_terms)
    n = 2 * n if n > 1 else 1  # half full on the average, so that hardly a block exceeds the bound
    out = None
    for i in range(n):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        terms = some.select(F.explode("terms").alias("term")).distinct()
        df = index.rows.select("term", "n").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("df"))
        weights = {r["term"]: weight(index.n_docs, r["df"]) for r in df.collect()}  # one row a query term
        least: dict = {}
        shards = [r[0] for r in index.rows.where("term IS NULL").select("shard").orderBy("shard").limit(4 * seeds + 1).collect()]
        if len(shards) > 4 * seeds:  # the k-th best of some documents is no better than that of all
            tried = _walk(index.rows.where(F.col("shard").isin(shards[:seeds])), some, weights, k, least)
            kth = _best_of_all(tried, k).where(F.col("rank") == k)
            least = {r["item_id"]: r["score"] for r in kth.collect()}  # one row a query
        found = scratch.write(_best_of_all(_walk(index.rows, some, weights, k, least), k), f"found-{i}")
        out = found if out is None else out.union(found)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of docs(doc_id, text) for each of queries(item_id, text).

    Null, empty and wordless texts are never found and count neither as documents nor in lengths. Rows that share a doc_id are documents of their
    own; those without one are found and come last among equal scores. Empty tables give no rows. Other columns are not read.
    """
    return search(build(docs), queries, k)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''))) AS term FROM benchmark
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL
), c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n
), m AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM n, c
), f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs
), s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
