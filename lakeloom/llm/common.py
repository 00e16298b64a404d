"""Helpers shared by the operators: the shared folder, lineage cuts, hashing and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python works on at once; Spark's own bound on the bytes of an Arrow batch stands before it.
PIECE_BYTES = 1 << 20
#: Spark deletes the shuffle files of a query that has ended; nothing here runs the same query twice.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a folder of this machine is made only where that is unset and all runs on it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


class Scratch:
    """Tables written to the shared folder and read back: their lineage ends there, and any executor can read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df with the writer's options and read it back; a table of the same name goes once its successor is written."""
        path = f"{shared_dir(self.spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; the copy stays."""
    return Scratch(df.sparkSession).write(df, name)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a column hold about so many bytes; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


#: Fixed value: A-Z become a-z, and every ASCII byte but digits and letters becomes a blank.
WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def word_runs(text: bytes | None, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, as lists that follow each other; a long text is split piece by piece, so its words are never all there at once."""
    if not text:
        return
    bare, at = text.translate(WORD_BYTES), 0
    while at < len(bare):
        end = bare.find(b" ", min(len(bare), at + most))
        end = len(bare) if end < 0 else end
        yield bare[at:end].split()
        at = end


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that links reach.

    Alternating large-star and small-star contractions, until a round changes no edge. Minima come from map-side combined aggregates, and each
    join reads two written tables through plain exchanges, so a hub with any share of the edges is split by adaptive execution. Null ends and
    loops are dropped; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    last, seen = None, print_of(now)
    while seen[0] and seen != last:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = scratch.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, "large")
        lowest = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.write(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, seen = seen, print_of(now)
    scratch.drop("stars", "large")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
