"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its beginnings. Filters of several widths slide over the words of a
whole text and the largest response of each is kept. A filter's response is a sum of one number per word and place, so responses are
computed once per distinct word and looked up. The language, told from a text's function words, sets the threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import pieces
from lakeloom.llm.quality import fold

#: Labelled rows of each label that a model is learnt from at most: the first by a hash of their id.
SAMPLE = 2000
#: Hash buckets, embedding size, filters of each width, lengths of the beginnings.
BUCKETS, SIZE, FILTERS, WIDTHS, BEGINNINGS = 1 << 16, 8, 6, (1, 2, 3), (3, 4, 5)
#: Steps of the descent, as many for any sample.
STEPS, BATCH, RATE = 800, 32, 0.05
#: From how many standard errors on a bucket's log odds are taken as a start, and what is added to each count for them.
SEED_ERRORS, SEED_PRIOR = 1.5, 1.0
#: Rows of the rarer label that weigh as much as all languages together in a language's threshold.
SHARED_ROWS = 20
CUT = 0.3
#: Distinct words of which a task keeps the responses.
CACHE = 150_000
WORD = re.compile(r"[^\W\d_]+")
#: Function words that tell a language.
LANGUAGES = {
    "en": "the of and to in is that it was for on are with as his they be at this from have or by not but what all were when we there".split(),
    "de": "der die und das den nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für zu aber".split(),
    "fr": "le les et des est que une du dans qui par pour au il sur pas plus ne se ce avec sont mais comme ou si leur y dont aux".split(),
    "es": "el los y que en un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo".split(),
}
NAMES = tuple(LANGUAGES)
#: Words of two languages tell neither.
TELLS = {w: i for i, n in enumerate(NAMES) for w in LANGUAGES[n] if sum(w in v for v in LANGUAGES.values()) == 1}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def buckets(word: str) -> list[int]:
    """The bucket of the word and those of its beginnings; a beginning as long as the word counts as its own."""
    return [zlib.crc32(f"={word}".encode()) % BUCKETS, *(zlib.crc32(f"{n}{word[:n]}".encode()) % BUCKETS for n in BEGINNINGS)]


def language(found: list[str]) -> int:
    """Number of the language whose function words are the most; the number of languages where none is told."""
    count = [0] * len(NAMES)
    for w in found:
        k = TELLS.get(w)
        if k is not None:
            count[k] += 1
    return count.index(max(count)) if any(count) else len(NAMES)


@dataclass
class Network:
    embed: np.ndarray  # BUCKETS x SIZE
    filters: np.ndarray  # SIZE x (places of all widths x FILTERS)
    bias: np.ndarray  # one for each filter of each width
    out: np.ndarray
    base: float
    shift: np.ndarray  # what is added for each language

    def responses(self, at: np.ndarray) -> np.ndarray:
        """For each word, given its buckets: what it adds to each filter at each place."""
        return (self.embed[at].sum(axis=1) @ self.filters).astype(np.float32)

    def pooled(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over a text, and where it is; texts shorter than a filter end in nothing."""
        n, best, where, col = len(r), [], [], 0
        for w in WIDTHS:
            total = np.zeros((n, FILTERS), np.float32)
            for p in range(w):
                total[: n - p] += r[p:, col : col + FILTERS]
                col += FILTERS
            k = total.argmax(axis=0)
            best.append(total[k, np.arange(FILTERS)])
            where.append(k)
        return np.concatenate(best), np.concatenate(where)

    def logit(self, r: np.ndarray) -> float:
        if not len(r):
            return self.base
        return float(np.maximum(self.pooled(r)[0] + self.bias, 0) @ self.out) + self.base

    def score(self, logit: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit + self.shift[lang], -50, 50)))


def _start(docs: list[np.ndarray], table: np.ndarray, y: np.ndarray) -> Network:
    """Embeddings start from noise, and in their first number from the log odds of a bucket's presence where it is significant."""
    rng = np.random.default_rng(11)
    seen = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(table[d])] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    rate = (seen.sum(axis=0) + 1) / n.sum()
    z = (seen[1] - rate * n[1]) / np.sqrt(rate * n[1] + 1)
    odds = np.log((seen[1] + SEED_PRIOR) / (n[1] + 2 * SEED_PRIOR)) - np.log((seen[0] + SEED_PRIOR) / (n[0] + 2 * SEED_PRIOR))
    embed = rng.normal(0, 0.02, (BUCKETS, SIZE))
    embed[:, 0] += np.where(z > SEED_ERRORS, np.clip(odds, 0, 4), 0)
    places = sum(WIDTHS)
    filters = rng.normal(0, 0.1, (SIZE, places * FILTERS))
    filters[0] += 0.5
    m = len(WIDTHS) * FILTERS
    return Network(embed, filters, np.full(m, -0.1), np.abs(rng.normal(0.15, 0.05, m)), -1.0, np.zeros(len(NAMES) + 1))


def train(texts: list[list[str]], y: np.ndarray) -> Network:
    """Learn from the words of whole texts and their labels; a fifth of them calibrates the thresholds by language."""
    names = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    table = np.array([buckets(w) for w in names] or np.zeros((0, 1 + len(BEGINNINGS))), np.int64).reshape(-1, 1 + len(BEGINNINGS))
    docs = [np.fromiter((names[w] for w in t), np.int64, len(t)) for t in texts]
    fit = np.arange(len(docs)) % 5 != 4
    net = _start([d for d, k in zip(docs, fit, strict=True) if k], table, y[fit])
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        net.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return net
    rng = np.random.default_rng(5)
    own = np.flatnonzero(fit)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    squares = {k: np.full(getattr(net, k).shape, 1e-2) for k in ("embed", "filters", "bias", "out")}
    square_base = 1e-2

    def descend(name: str, slope: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        squares[name][at] += slope**2
        getattr(net, name)[at] -= RATE * slope / np.sqrt(squares[name][at])

    at_row = len(own)
    for _ in range(STEPS):
        if at_row >= len(own):
            rng.shuffle(own)
            at_row = 0
        part = [i for i in own[at_row : at_row + BATCH] if len(docs[i])]
        at_row += BATCH
        if not part:
            continue
        used, back = np.unique(np.concatenate([docs[i] for i in part]), return_inverse=True)
        vec = net.embed[table[used]].sum(axis=1)
        r = (vec @ net.filters).astype(np.float32)
        d_vec, d_filters = np.zeros_like(vec), np.zeros_like(net.filters)
        d_bias, d_out, d_base, at = np.zeros_like(net.bias), np.zeros_like(net.out), 0.0, 0
        for i in part:
            mine = back[at : at + len(docs[i])]
            at += len(mine)
            best, where = net.pooled(r[mine])
            act = np.maximum(best + net.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.base, -50, 50)))
            e = weight[i] * (p - y[i]) / len(part)
            d_out += e * act
            d_base += e
            d_act = e * net.out * (act > 0)
            d_bias += d_act
            col = f = 0
            for w in WIDTHS:
                for q in range(w):
                    word = mine[np.minimum(where[f : f + FILTERS] + q, len(mine) - 1)]
                    live = d_act[f : f + FILTERS] * (where[f : f + FILTERS] + q < len(mine))
                    np.add.at(d_vec, word, live[:, None] * net.filters[:, col : col + FILTERS].T)
                    d_filters[:, col : col + FILTERS] += live * vec[word].T
                    col += FILTERS
                f += FILTERS
        moved = np.flatnonzero(np.abs(d_vec).sum(axis=1))
        slope = np.zeros((len(moved) * table.shape[1], SIZE))
        slope[:] = np.repeat(d_vec[moved], table.shape[1], axis=0)
        ids, inv = np.unique(table[used[moved]].ravel(), return_inverse=True)
        summed = np.zeros((len(ids), SIZE))
        np.add.at(summed, inv, slope)
        descend("embed", summed, ids)
        descend("filters", d_filters)
        descend("bias", d_bias)
        descend("out", d_out)
        square_base += d_base**2
        net.base -= RATE * d_base / np.sqrt(square_base)
    _calibrate(net, docs, table, texts, y, ~fit)
    return net


def _calibrate(net: Network, docs: list[np.ndarray], table: np.ndarray, texts: list[list[str]], y: np.ndarray, held: np.ndarray) -> None:
    """The logit with the best F1 on rows that were not trained on becomes the cut.

    A language's cut lies between its own and that of all languages, the nearer to its own the more rows of both labels it has.
    """
    part = np.flatnonzero(held)
    if not len(part):
        return
    logits = np.array([net.logit(net.responses(table[docs[i]])) for i in part])
    lang, want = np.array([language(texts[i]) for i in part]), np.log(CUT / (1 - CUT))

    def cut(mask: np.ndarray) -> float:
        order = np.argsort(-logits[mask], kind="stable")
        z, t = logits[mask][order], y[part][mask][order]
        hits = np.cumsum(t)
        f1 = 2 * hits / (np.arange(1, len(t) + 1) + max(t.sum(), 1))
        k = int(np.argmax(f1))
        # Halfway to the next clear case below, as unseen toxic texts tend to score lower.
        below = z[k + 1] if k + 1 < len(z) else z[k] - 1
        return float((z[k] + below) / 2)

    shared = cut(np.ones(len(part), bool))
    for k in range(len(NAMES) + 1):
        mask = lang == k
        rarer = min(y[part][mask].sum(), (1 - y[part][mask]).sum())
        own = cut(mask) if rarer else shared
        net.shift[k] = want - (rarer * own + SHARED_ROWS * shared) / (rarer + SHARED_ROWS)


def learn(docs: DataFrame, labels: DataFrame, usable) -> Network:
    """Train on a bounded sample of rows whose labels may be seen: of each label the first by a hash of their id."""
    seen = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picks = [seen.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for v in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id").select("doc_id", "text", "y").toPandas()
    rows = rows.assign(k=[zlib.crc32(str(i).encode()) for i in rows["doc_id"]]).sort_values(["k", "doc_id"], kind="stable")
    if not len(rows):
        return train([], np.zeros(0))
    y = rows["y"].to_numpy(float)
    # One copy of a text is enough, and it mustn't stand on both sides of the calibration.
    first = ~rows["text"].duplicated().to_numpy()
    return train([words(t) for t in rows["text"][first]], y[first])


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels of documents whose fold is held are never seen; labels other than 0 and 1 don't count. Null and empty texts get the score of a text without words. Without labels of
    both kinds all scores are alike. Repeated rows are scored alike; a null doc_id is not held out. Only doc_id and text of docs are read, and only the text makes the score.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, fold(F.col("doc_id"), parts) != held))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        rows: dict[str, int] = {}
        kept = np.zeros((0, net.filters.shape[1]), np.float32)
        for b in pieces(batches, 2):
            found = [words(t) for t in b.column(2).to_pylist()]
            new = [w for w in dict.fromkeys(w for t in found for w in t) if w not in rows]
            if len(rows) + len(new) > CACHE:
                rows, kept = {}, kept[:0]
                new = list(dict.fromkeys(w for t in found for w in t))
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            if new:
                at = np.array([buckets(w) for w in new])
                kept = np.concatenate([kept, *(net.responses(at[k : k + 50_000]) for k in range(0, len(at), 50_000))])
            logits = np.array([net.logit(kept[np.fromiter(map(rows.__getitem__, t), np.int64, len(t))]) for t in found])
            scores = net.score(logits, np.array([language(t) for t in found], np.int64)) if len(found) else logits
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
