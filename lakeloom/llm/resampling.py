"""Importance resampling toward a target distribution over hashed n-grams.

Runs of one to three words are hashed to buckets and counted document by document; the sparse matrix of documents by buckets is written as
blocks of compressed sparse rows. Its column sums, and those of the target's matrix, give two distributions; each bucket's gain is the log of their
ratio, and the matrix times the gains weighs the documents. With a Gumbel number from each id's hash added, the highest scores are
a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, pieces, word_runs

BUCKETS = 10_000
#: Words of a feature at most; words of a document that may be drawn at least; per cent of these that are drawn.
LONGEST, LEAST_WORDS, PERCENT = 3, 20, 5
SEED = "42"
#: Bytes of text of a block of the matrix, and of a row group of its file: a reader holds a row group whole, unpacked.
BLOCK_BYTES, ROW_GROUP = 1 << 18, 8 << 20


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, most of them zero, compressed, so that a block is small wherever it is held."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def features(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words; the buckets that the features fall into, ascending, and how many fall into each.

    The check sum of a longer run goes on from that of the run without its last word, so no run is ever put together.
    """
    n, carry, found = 0, [], None
    at, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for run in word_runs(text):
        words = carry + run
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        parts = [np.array(sums[len(carry) :], np.int64)]
        for size in range(1, LONGEST):
            sums = list(map(crc32, islice(spaced, size, None), sums))
            parts.append(np.array(sums[max(0, len(carry) - size) :], np.int64))
        here, times = np.unique(np.concatenate(parts) % buckets, return_counts=True)
        if found is None:
            at, counts = here, times
        else:  # a long text: add up by bucket
            both = np.bincount(np.concatenate([at, here]), np.concatenate([counts, times]), buckets).astype(np.int64)
            at = np.flatnonzero(both)
            counts = both[at]
        n, carry, found = n + len(run), words[-(LONGEST - 1) :], True
    return n, at, counts


def blocks(rows: DataFrame, key: str, scratch: Scratch, name: str, buckets: int = BUCKETS) -> DataFrame:
    """The written matrix: blocks of rows (docs, n_words, starts, gaps, counts) in compressed sparse form, columns as gaps within a row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, BLOCK_BYTES):
            n_words, gaps, counts, starts = [], [], [], [0]
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                n, at, times = features(text, buckets)
                n_words.append(n)
                gaps.append(np.diff(at, prepend=0))
                counts.append(times)
                starts.append(starts[-1] + len(at))
            one = lambda values, t: pa.array([values], t)
            docs = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            data = [one(_packed(np.concatenate(x)), pa.binary()) for x in ([np.array(starts)], gaps, counts)]
            yield pa.RecordBatch.from_arrays([docs, one(n_words, pa.list_(pa.int64())), *data], ["docs", "n_words", "starts", "gaps", "counts"])

    made = rows.select(key, "text").mapInArrow(run, f"docs array<{kind}>, n_words array<long>, starts binary, gaps binary, counts binary")
    return scratch.write(made, name, **{"parquet.block.size": str(ROW_GROUP)})


def _block(n_docs: int, starts: bytes, gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the rows; the column and the count of each entry."""
    at = _numbers(starts, n_docs + 1)
    gap, count = (_numbers(x, int(at[-1])) for x in (gaps, counts))
    ends = np.append(0, np.cumsum(gap))
    return at, ends[1:] - np.repeat(ends[at[:-1]], np.diff(at)), count


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket. A task passes on one row a bucket; the driver gets one number a bucket, however many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                _, columns, count = _block(*(c[i].as_py() for c in b.columns))
                total += np.bincount(columns, count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = matrix.select(F.size("n_words"), "starts", "gaps", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed ratio of target to source, by bucket, rounded down."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, weight): the matrix times the gains."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)
    kind = matrix.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, n = (pc.list_flatten(b.slice(i, 1).column(j)) for j in (0, 1))
                at, columns, count = _block(len(docs), *(b.column(j)[i].as_py() for j in (2, 3, 4)))
                sums = np.append(0, np.cumsum(shared.value[columns] * count))
                yield pa.RecordBatch.from_arrays([docs, n, pa.array(np.diff(sums[at]))], ["doc_id", "n_words", "weight"])

    return matrix.mapInArrow(run, f"doc_id {kind}, n_words long, weight long")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number drawn by the hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with place, from 1 on in the order given: sorted by ranges, numbered within them, the numbers of the ranges before added."""
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows) + 1)], [*b.schema.names, "part", "within"])
            n += b.num_rows

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, part int, within long"), "placed")
    before, total = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        before.append((r["part"], total))
        total += r["n"]
    before = rows.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(before), "part").withColumn("place", F.col("within") + F.col("before")).drop("part", "within", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank, from 1 on, for the drawn ones.

    docs: (doc_id, text); target: (text). Null, empty and wordless texts have no features and a weight of 0; an empty target has no features, and
    an empty table gives no rows. Equal scores go by doc_id, rows without one last and scored as if it were empty; repeated rows count
    and are drawn each for itself. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    matrix = blocks(docs, "doc_id", scratch, "matrix", buckets)
    wanted = blocks(target.withColumn("_none", F.lit(0)), "_none", scratch, "target", buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    n = F.col("n_words")
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    may = n >= least_words
    scored = weights(matrix, gain).select("doc_id", sum((F.greatest(n - i, F.lit(0)) for i in range(1, LONGEST)), n).alias("n_features"), "weight", score.alias("score"), may.alias("may"))
    scored = scratch.write(scored, "scored")
    drawn = scored.where("may").count() * percent // 100
    placed = numbered(scored, [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id")], scratch)
    scratch.drop("matrix", "target", "scored")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: The same rows for DuckDB. The check sums of all features go on byte by byte together.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT 'd' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), g AS (
  SELECT side, doc_id, array_to_string(w[i:i + z - 1], ' ') AS f, count(*) AS n
  FROM (SELECT side, doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS z) WHERE len(w) >= z) GROUP BY ALL
), one AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))) AS t
), crc AS (
  SELECT f, hex(encode(f)) AS h, 0 AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM g)
  UNION ALL SELECT f, h, pos + 1, xor(c >> 8, t[xor(c & 255, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) + 1]) FROM crc, one WHERE 2 * pos < length(h)
), k AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * pos = length(h)
), c AS (SELECT side, doc_id, bucket, sum(n) AS n FROM g JOIN k USING (f) GROUP BY ALL
), s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c GROUP BY bucket
), a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM s
), v AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS gain FROM s, a
), x AS (SELECT doc_id, sum(n * gain) AS weight FROM c JOIN v USING (bucket) WHERE side = 'd' GROUP BY doc_id
), y AS (
  SELECT w.doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || w.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM w LEFT JOIN x USING (doc_id) WHERE side = 'd'
), z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n_may FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n_may // 100 THEN place END AS rank FROM z
"""
