"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counted over whole texts by Spark and binned by quantiles. Shallow trees are boosted feature by feature in a cycle; the trees of a
feature add up to one lookup table over its bins, and the strongest pairs of features get tables of their own from what is left. A
score is a sum of table entries, looked up for a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import pieces

#: Labelled rows that a model is learnt from at most: the first by a hash of their id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 150, 80, 0.1, 8.0
#: Scores from here on are predicted as good.
CUT = 0.3
FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeats", "repeated_pairs", "upper", "digits", "symbols", "marks", "pipes", "bangs", "other_bytes", "lines", "distinct_lines",
    "line_length", "compressed", "stops_per_word", "capitals", "commas",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256)
    table[[ord(c) for c in chars]] = 1
    return table


UPPER, LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
DIGITS, SYMBOLS = _class("0123456789"), _class("#$%&*+/<=>@[\\]^_`{|}~")


def features(text: str | None) -> list[float]:
    """Shares and means of a whole text; all are 0 for null, empty and blank ones."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    letters = float(count @ (UPPER + LOWER)) + float(count[128:].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    freq = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 15).mean()), len(freq) / n, max(freq.values()) / n, same / n, 1 - pairs / max(n - 1, 1),
        float(count @ UPPER) / max(letters, 1), float(count @ DIGITS) / size, float(count @ SYMBOLS) / size, sum(not w[-1].isalnum() for w in words) / n, count[124] / n, count[33] / n, float(count[128:].sum()) / size,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(size / len(lines))), len(zlib.compress(raw, 1)) / size, (count[46] + count[63]) / n, sum(w[0].isupper() for w in words) / n, count[44] / n,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _tree(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over ordered bins, by their sums of gradients, curvatures and rows: its value in each bin."""
    out = np.zeros(len(g))

    def split(a: int, b: int, depth: int) -> None:
        cg, ch, cw = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(w[a:b])
        base = cg[-1] ** 2 / (ch[-1] + 1)
        gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - base
        gain[(cw[:-1] < LEAST) | (cw[-1] - cw[:-1] < LEAST)] = 0
        if depth and len(gain) and (k := int(np.argmax(gain))) >= 0 and gain[k] > 1e-6:
            split(a, a + k + 1, depth - 1)
            split(a + k + 1, b, depth - 1)
        else:
            out[a:b] = cg[-1] / (ch[-1] + 1)

    split(0, len(g), 2)
    return out


def _corner(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table into four quarters: its gain and its value in each cell."""
    cum = lambda x: np.cumsum(np.cumsum(x, 0), 1)
    cg, ch, cw = cum(g), cum(h), cum(w)

    def quarters(c: np.ndarray) -> tuple[np.ndarray, ...]:
        a = c[:-1, :-1]
        right, down = c[:-1, -1:], c[-1:, :-1]
        return a, right - a, down - a, c[-1, -1] - right - down + a

    qg, qh, qw = quarters(cg), quarters(ch), quarters(cw)
    gain = sum(x**2 / (y + 1) for x, y in zip(qg, qh, strict=True))
    gain[np.minimum.reduce(qw) < LEAST] = 0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    if gain[i, j] > 1e-6:
        v = [x[i, j] / (y[i, j] + 1) for x, y in zip(qg, qh, strict=True)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


@dataclass
class Additive:
    """base + a table entry for each feature + one for each pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def _bin(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        """Learn from rows of features and labels 0 or 1; without both labels the score is the smoothed share of ones."""
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        if not 0 < y.sum() < len(y):
            return self
        cut = lambda k: [np.unique(np.quantile(c, np.arange(1, k) / k)) for c in x.T]
        self.edges, self.coarse = cut(BINS), cut(PAIR_BINS)
        fine, rough = self._bin(self.edges, x), self._bin(self.coarse, x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.base)
        sums = lambda at, v, n: np.bincount(at, v, n)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        rows = [np.bincount(fine[:, i], minlength=len(t)) for i, t in enumerate(self.tables)]
        for _ in range(ROUNDS):
            for i, t in enumerate(self.tables):
                g, h = slopes()
                step = RATE * _tree(sums(fine[:, i], g, len(t)), sums(fine[:, i], h, len(t)), rows[i])
                t += step
                f += step[fine[:, i]]
        wide = [len(e) + 1 for e in self.coarse]
        at = {(i, j): rough[:, i] * wide[j] + rough[:, j] for i, j in combinations(range(len(wide)), 2) if min(wide[i], wide[j]) > 1}

        def grid(k: tuple[int, int], v: np.ndarray | None) -> np.ndarray:
            return np.bincount(at[k], v, wide[k[0]] * wide[k[1]]).reshape(wide[k[0]], wide[k[1]]).astype(float)

        g, h = slopes()
        best = sorted(at, key=lambda k: -_corner(grid(k, g), grid(k, h), grid(k, None))[0])[:PAIRS]
        grids = {k: np.zeros((wide[k[0]], wide[k[1]])) for k in best}
        for _ in range(PAIR_ROUNDS):
            for k in best:
                g, h = slopes()
                step = RATE * _corner(grid(k, g), grid(k, h), grid(k, None))[1]
                grids[k] += step
                f += step.ravel()[at[k]]
        self.pairs = [(i, j, t) for (i, j), t in grids.items()]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        fine, rough = self._bin(self.edges, x), self._bin(self.coarse, x)
        for i, t in enumerate(self.tables):
            f += t[fine[:, i]]
        for i, j, t in self.pairs:
            f += t[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-f))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> Additive:
    """A model from the whole texts of a bounded sample of labelled rows; usable says, by doc_id, which labels may be seen."""
    seen = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    picks = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(picks.select("doc_id")), "doc_id")).join(F.broadcast(picks), "doc_id").select("doc_id", "x", "y").toPandas()
    if not len(rows):
        return Additive()
    rows = rows.sort_values("doc_id", kind="stable")
    return Additive().fit(np.stack(rows["x"].to_list()), rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels of documents whose fold is held are never seen; labels other than 0 and 1, and of unknown documents, don't count. Null, empty and blank texts are scored
    by their features, all 0. Without labels every score is 0.5. Repeated rows are scored alike; a null doc_id is not held out. Only doc_id and text
    of docs are read, and only the text makes the score.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, "quality", fold(F.col("doc_id"), parts) != held))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            if b.num_rows:
                scores = model.value.score(np.array([features(t) for t in b.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores)], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, cut: float = CUT) -> DataFrame:
    """docs without the rows whose text is predicted as bad; all columns stay. The model is that of classify()."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, "quality", fold(F.col("doc_id"), parts) != held))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            if b.num_rows:
                good = model.value.score(np.array([features(t) for t in b.column(at).to_pylist()])) >= cut
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
