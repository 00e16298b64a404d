"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many fixed random directions. Around a vector's value on a direction lies a window; a pair collects a collision
for each of DIRECTIONS where one lies in the other's window, and pairs with enough collisions are verified by their cosine in double
precision. Window and count follow from the recall wanted for a pair at the very threshold.

A window on one direction holds a share of all vectors, so counting alone is quadratic. Therefore windows are counted among vectors that stand
together in a cell: tables of a few directions each cut the sphere by the signs of their projections. Two vectors part on one direction with a
probability of their angle over pi, whatever the other vectors are like, so the number of tables follows from the recall too. A cell that
is full beyond BLOCK is cut into blocks which meet in pairs of blocks. A pair that meets in several tables counts in the first of them
only, so no pair is ever sent anywhere: a cell gives back a number of links for each vector and its least partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, connected_components

#: Directions whose windows are counted, and half the window in standard deviations of the difference of a pair at the threshold.
DIRECTIONS, HALF_WINDOW = 16, 2.0
#: Expected share of pairs at the very threshold that reach the count, and that stand in a cell together; above the threshold, more.
RECALL, CELL_RECALL = 0.9999, 0.99
#: Vectors compared at once; what it costs to send a vector to one more table, in comparisons; directions of a table at most.
BLOCK, SENDING, DEEPEST = 1024, 64, 31


def directions(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """Orthonormal rows, the same everywhere; more than dim of them start another basis."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-count // dim))]
    return np.concatenate(bases)[:count]


def collisions_needed(count: int, half: float, recall: float) -> int:
    """The largest number of collisions that a pair at the threshold reaches with the probability recall."""
    p = math.erf(half / math.sqrt(2))
    tail = 0.0
    for k in range(count, 0, -1):
        tail += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if tail >= recall:
            return k
    return 0


def tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Directions of a table and number of tables that cost least for n vectors, so that a pair at the threshold meets with the probability recall."""
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    best = (math.inf, 0, 1)
    for deep in range(DEEPEST + 1):
        count = 1 if p**deep >= recall else math.ceil(math.log(1 - recall) / math.log1p(-(p**deep)))
        best = min(best, (count * (1 + n / 2**deep / SENDING), deep, count))
    return best[1:]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): the bytes of the vector's numbers; nulls if it can link with nothing."""
    id_type, element = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.array(x if x is not None and i is not None and None not in x else [], np.float64)
                good = len(a) and np.isfinite(a).all() and a.any()
                dims.append(len(a) if good else None)
                vecs.append(a.astype(kind).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_type}, dim int, vec binary")


def _cells(reps: DataFrame, kind: type, threshold: float, recall: float) -> DataFrame:
    """(dim, at, cell, node, copies, vec, codes): each vector once for each table, with its cell there and its cells in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                dims, ns = b.column(0).to_numpy(), b.column(1).to_numpy()
                vecs = b.column(4).to_pylist()
                for dim, n in sorted(set(zip(dims.tolist(), ns.tolist(), strict=True))):
                    if (dim, n) not in known:
                        deep, count = tables(n, threshold, recall)
                        known[dim, n] = deep, count, directions(dim, max(1, deep * count), 11)
                    deep, count, basis = known[dim, n]
                    rows = np.flatnonzero((dims == dim) & (ns == n))
                    x = _unit(np.frombuffer(b"".join(vecs[i] for i in rows), kind).reshape(-1, dim))
                    bits = (x @ basis[: deep * count].T > 0).reshape(len(rows), count, deep)
                    codes = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(deep, dtype=np.uint32)) if deep else np.zeros((len(rows), count), np.uint32)
                    back = pa.array(np.repeat(rows, count))
                    at = pa.array(np.tile(np.arange(count, dtype=np.int32), len(rows)))
                    own = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), count)))
                    whose = [b.column(i).take(back) for i in (0, 2, 3, 4)]
                    out = [whose[0], at, pa.array(codes.astype(np.int64).ravel()), *whose[1:], own]
                    yield pa.RecordBatch.from_arrays(out, ["dim", "at", "cell", "node", "copies", "vec", "codes"])

    sizes = reps.groupBy("dim").agg(F.count("*").alias("n"))
    rows = reps.join(sizes, "dim").select("dim", "n", "node", "copies", "vec")
    return rows.mapInArrow(run, "dim int, at int, cell long, node long, copies long, vec binary, codes binary")


class Comparer:
    """Links between two blocks of unit vectors of one dimension."""

    def __init__(self, dim: int, threshold: float, count: int, half: float, recall: float):
        self.threshold = threshold
        self.basis = directions(dim, min(count, dim))
        self.window = half * math.sqrt(max(0.0, 2 - 2 * threshold) / dim) + 1e-6
        self.need = collisions_needed(len(self.basis), half, recall) if dim >= 16 else 0  # few dimensions: the normal law doesn't hold, verify all

    def pairs(self, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the linked pairs; of a block with itself each pair once."""
        near = np.ones((len(x), len(y)), bool)
        if self.need and near.size > 16:
            count = np.zeros(near.shape, np.uint8)
            for p, q in zip((x @ self.basis.T).T.astype(np.float32), (y @ self.basis.T).T.astype(np.float32), strict=True):
                d = np.subtract.outer(p, q)
                count += np.abs(d, out=d) <= self.window
            near = count >= self.need
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        hit = np.zeros(len(i), bool)
        for k in range(0, len(i), 20_000):
            part = slice(k, k + 20_000)
            hit[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= self.threshold
        return i[hit], j[hit]


def _compared(dealt: DataFrame, kind: type, threshold: float, count: int, half: float, recall: float) -> DataFrame:
    """(node, links, root): for each vector with links in a group, their number and the least vector that they reach there.

    Groups come sorted and one after the other; one holds two blocks at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers: dict[int, Comparer] = {}

        def links(t: pa.Table) -> list[np.ndarray] | None:
            dim, at, low, high = (t.column(c)[0].as_py() for c in ("dim", "at", "low", "high"))
            if dim not in workers:
                workers[dim] = Comparer(dim, threshold, count, half, recall)
            x = _unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(-1, dim))
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint32).reshape(len(x), -1)
            block, node, copies = (t.column(c).to_numpy() for c in ("block", "node", "copies"))
            a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
            i, j = workers[dim].pairs(x[a], x[b], low == high)
            i, j = a[i], b[j]
            new = ~(codes[i, :at] == codes[j, :at]).any(axis=1)  # else an earlier table has the pair
            i, j = i[new], j[new]
            if not len(i):
                return None
            total, root = np.zeros(len(x), np.int64), node.copy()
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
            while True:
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                if (before == root).all():
                    break
            own = np.flatnonzero(total)
            return [node[own], total[own], root[own]]

        def results(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            found = [x for x in map(links, groups) if x]
            if found:
                arrays = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "links", "root"])

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("dim", "at", "cell", "low", "high")], 1)
            start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            yield from results([t.slice(i, j - i) for i, j in zip(start, start[1:])])
            rest = t.slice(start[-1])
        if rest is not None:
            yield from results([rest])

    key = ["dim", "at", "cell", "low", "high"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "block", "node", "copies", "vec", "codes")
    return ordered.mapInArrow(run, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, count: int = DIRECTIONS, half: float = HALF_WINDOW, recall: float = RECALL, cell_recall: float = CELL_RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    Rows link if their cosine reaches the threshold; a pair at the very threshold is found with the probability recall * cell_recall, and none below
    is. Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different lengths or
    rows whose vec_id is null or no whole number (their component is null and they are kept). Equal vectors are compared once and all link with each
    other; rows that repeat a vec_id are vectors of their own, and equal by 128 bits of their bytes. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    rows = prepared(vectors.withColumn("vec_id", F.col("vec_id").cast("long"))).withColumn("name", F.unhex(F.md5("vec")))
    rows = scratch.write(rows, "vectors")
    reps = rows.where("dim IS NOT NULL").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = scratch.write(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    cells = _cells(reps, kind, threshold, cell_recall)
    full = cells.groupBy("dim", "at", "cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    full = scratch.write(full.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size"), "full")
    dealt = cells.join(full, ["dim", "at", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = scratch.write(_compared(dealt, kind, threshold, count, half, recall), "found")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("name", "node", "rep", "copies").join(counts, "node", "left").join(comps, "node", "left")
    known = scratch.write(known.withColumn("component", F.coalesce("component", "node")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    known = scratch.write(known.join(least, "component").select("name", links.alias("links"), F.col("least").alias("component")), "named")
    scratch.drop("reps", "full", "found", "known")
    out = rows.join(known, "name", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
