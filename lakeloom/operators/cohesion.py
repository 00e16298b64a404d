"""How well texts hang together: topic cuts by vectors, dissimilarity within a window, and measures that choose a way of chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import BLANK
from lakeloom.operators.blocks import pieces
from lakeloom.operators.retrieval import cosine

#: Cosine of neighbouring sentences below which a topic ends; places apart that are compared; letters of a chunk.
TOPIC, APART, TARGET = 0.65, 3, 1024
#: Texts whose tokens are counted at once.
AT_ONCE = 200
#: Fixed values of the measures: tokens of a gist, letters of a token at least, shares of the target size between which a chunk's size is good.
GIST, TOKEN, LOW, HIGH = 50, 2, 0.5, 2.0
#: Bars of the measures, and how sure the balanced choice is.
BARS = {"bi": 0.6, "rc": 0.8, "dcc": 0.5, "sc": 0.7}
BALANCED = 0.8
#: References within a text.
REFERENCES = (
    r"(?i)\b(?:see|cf\.|xem|tham\s+khảo)\s+(?:section|mục|chapter|chương)\s+\d",
    r"(?i)\b(?:figure|hình|table|bảng|equation|công\s+thức)\s+\d+",
    r"(?i)\[(?:ref|reference|tham\s+chiếu)?\s*\d+\]",
    r"(?i)\((?:see|xem)\s+\w+\)",
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts that end with a full stop, question or exclamation mark before white space."""
    return _filled(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001", -1))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}_]{{{TOKEN},}})"), 1)


def vector_topics(docs: DataFrame, vectors: DataFrame, key: Callable[[Column], Column], threshold: float = TOPIC, size: int = TARGET) -> DataFrame:
    """(doc_id, topic, part, content): runs of sentences whose neighbours have a cosine from threshold on, cut into pieces of so many letters.

    vectors: (key, embedding), one for each text by a hash of its content, so equal sentences share a vector that is made once. A sentence without a vector is like
    none. Neighbours meet by a window over the document's sentences.
    """
    flat = docs.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    known = flat.withColumn("key", key(F.col("sentence"))).join(vectors, "key", "left")
    own = Window.partitionBy("doc_id").orderBy("i")
    near = F.coalesce(cosine(F.lag("embedding").over(own), F.col("embedding")), F.lit(0.0))
    marked = known.withColumn("near", near).withColumn("cut", ((F.col("i") > 0) & (F.col("near") < threshold)).cast("int"))
    topics = marked.withColumn("topic", F.sum("cut").over(own).cast("int")).groupBy("doc_id", "topic")
    text = topics.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return text.select("doc_id", "topic", F.posexplode(_filled(pieces(F.col("text"), size))).alias("part", "content"))


def dissimilarity(vectors: DataFrame, apart: int = APART) -> DataFrame:
    """(doc_id, dissimilarity): one less the mean cosine of chunks up to so many places apart, weighed by both lengths, between 0 and 1.

    vectors: (doc_id, i, length, embedding), i from 0 on without gaps. Documents of one chunk, or without a weight, give null.
    """
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for b in batches:
            old = last.num_rows if last else 0
            b = pa.concat_batches([last, b]) if last else b
            last = b.slice(max(0, b.num_rows - apart))
            docs, n, lists = pc.dictionary_encode(b.column(0), null_encoding="encode").indices.to_numpy(), b.column(1).to_numpy().astype(float), b.column(2)
            # Vectors as rows, with zeros behind shorter ones; one that is null or holds a null has a cosine of 0 with all.
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            v = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
            v[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = pc.fill_null(flat, 0).to_numpy().astype(float)
            norm = np.sqrt((v * v).sum(axis=1))
            norm[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
            s, w = np.zeros(len(sizes)), np.zeros(len(sizes))
            for k in range(1, min(apart, len(sizes) - 1) + 1):
                # What both stand in the batch before was counted with it.
                same = (docs[k:] == docs[:-k]) & (np.arange(k, len(docs)) >= old)
                both = np.where(same, n[k:] * n[:-k], 0.0)
                scale = np.where((sizes[k:] == sizes[:-k]) & same, norm[k:] * norm[:-k], 0.0)
                dot = (v[k:] * v[:-k]).sum(axis=1)
                s[:-k] += np.divide(dot, scale, out=np.zeros(len(dot)), where=scale != 0) * both
                w[:-k] += both
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(w)], ["doc_id", "s", "w"])

    # A document's chunks stand together in order, so neighbours meet in a task without a copy of any vector.
    rows = vectors.repartition("doc_id").sortWithinPartitions("doc_id", "i").select("doc_id", "length", "embedding")
    sums = rows.mapInArrow(near, f"doc_id {kind}, s double, w double").groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return sums.select("doc_id", F.when(F.col("w") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("s", "w"))), 9)).alias("dissimilarity"))


def _told(target: int) -> Column:
    """bi and sc of a text, and the references that it makes."""
    marks = F.concat(*(F.regexp_extract_all("text", F.lit(f"({p})".replace("((?i)", "(?i)(")), 1) for p in REFERENCES))
    n, rest = F.ceil(F.length("text") / target), F.length("text") % target
    good = n - ((rest > 0) & ((rest < int(target * LOW)) | (rest > int(target * HIGH)))).cast("int")
    bi = F.size(F.filter("blocks", lambda b: F.length(b) <= target)) / F.size("blocks")
    sc = F.when(n > 0, good / n).otherwise(1.0)
    return F.struct(bi.cast("double").alias("bi"), sc.cast("double").alias("sc"), F.transform(marks, lambda m: F.lower(F.btrim(m, F.lit(BLANK)))).alias("marks"))


def _kept(marks: list[str], blocks: list[str]) -> float | None:
    """Share of the references that some block has twice; each different one is looked for once."""
    twice = {m: any(b.count(m) > 1 for b in blocks) for m in set(marks)}
    return sum(twice[m] for m in marks) / len(marks) if marks else None


def _alike(b: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, rc, icc, dcc, bi, sc) of (doc_id, told, low, tokens): a text's blocks, their sentences and their tokens, counted for all texts at once."""
    docs, blocks = b.num_rows, b.column(3).flatten()
    parts = blocks.flatten()
    flat = parts.flatten().dictionary_encode()
    many = lambda lists: pc.list_value_length(lists).to_numpy().astype(np.int64)
    code, most = flat.indices.to_numpy().astype(np.int64), max(1, len(flat.dictionary))
    doc_of = np.repeat(np.arange(docs), many(b.column(3)))
    block_of = np.repeat(np.arange(len(blocks)), many(blocks))
    part = np.repeat(np.arange(len(parts)), many(parts))
    block = block_of[part]

    # The tokens of a text by how often they stand there, equal ones by their first place.
    key, first, which, n = np.unique(doc_of[block] * most + code, return_index=True, return_inverse=True, return_counts=True)
    own = key // most
    order = np.lexsort((first, -n, own))
    gist = np.zeros(len(key), bool)
    gist[order] = np.arange(len(key)) - np.searchsorted(own, own) < GIST
    size = np.bincount(own, gist, docs)
    key, at = np.unique(block * most + code, return_index=True)
    filled = np.bincount(key // most, minlength=len(blocks)) > 0
    of = doc_of[filled]
    dcc, blocks_of = np.bincount(of, np.bincount(key // most, gist[which[at]], len(blocks))[filled] / size[of], docs), np.bincount(of, minlength=docs)

    # A token of a sentence and of the next one: keys that lie one sentence apart.
    key = np.unique(part * most + code)
    n = np.bincount(key // most, minlength=len(parts))
    near = np.searchsorted(key, key + most)
    met = key[near < len(key)][key[near[near < len(key)]] == key[near < len(key)] + most]
    both = np.bincount(met // most, minlength=len(parts))[:-1]
    pairs = block_of[1:] == block_of[:-1]
    union = n[1:] + n[:-1] - both
    of = doc_of[block_of[:-1][pairs]]
    icc, pairs_of = np.bincount(of, np.divide(both, union, out=np.zeros(len(both)), where=union > 0)[pairs], docs), np.bincount(of, minlength=docs)
    mean = lambda s, n: pa.array(np.divide(s, n, out=np.zeros(docs), where=n > 0), mask=n == 0)
    bi, sc, marks = b.column(1).flatten()
    rc = pa.array([_kept(*r) for r in zip(marks.to_pylist(), b.column(2).to_pylist(), strict=True)], pa.float64())
    return pa.RecordBatch.from_arrays([b.column(0), rc, mean(icc, pairs_of), mean(dcc, blocks_of), bi, sc], ["doc_id", "rc", "icc", "dcc", "bi", "sc"])


def measures(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, rc, icc, dcc, bi, sc) of texts(doc_id, text), a text a doc_id, whose blocks stand between blank lines.

    rc: references that stand twice in some block; icc: mean Jaccard similarity of neighbouring sentences within blocks; dcc: mean share of the gist, the
    document's most frequent tokens, in its blocks; bi: blocks no longer than the target; sc: equal pieces whose size is good. Each is 1 where there is nothing to
    measure. A text is measured where it is read: nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = _let(_filled(F.split("text", r"\n\s*\n", -1)), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.col("text"))))
    rows = docs.withColumn("blocks", parts).select("doc_id", _told(target).alias("told"), F.transform("blocks", F.lower).alias("low"))
    # Ends of sentences and blocks part tokens, so those of the sentences are those of the blocks and of the text.
    rows = rows.withColumn("tokens", F.transform("low", lambda b: F.transform(sentences(b), tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                yield _alike(b.slice(i, AT_ONCE))

    found = rows.mapInArrow(run, f"doc_id {kind}, rc double, icc double, dcc double, bi double, sc double")
    return found.select("doc_id", *(F.round(F.coalesce(c, F.lit(1.0)), 9).alias(c) for c in ("rc", "icc", "dcc", "bi", "sc")))


def choose(found: DataFrame, bars: dict[str, float] = BARS) -> DataFrame:
    """found with strategy, sure and why: broken blocks ask for topics, references that hold for statements, blocks off the gist for topics, bad sizes for a recursive cut."""
    rules = [("bi", F.col("bi") < bars["bi"], "semantic", F.col("bi")), ("rc", F.col("rc") > bars["rc"], "proposition", F.col("rc")), ("dcc", F.col("dcc") < bars["dcc"], "semantic", 1 - F.col("dcc")), ("sc", F.col("sc") < bars["sc"], "recursive", F.col("sc"))]
    first = [F.when(hit, F.struct(F.lit(to).alias("strategy"), sure.alias("sure"), F.lit(why).alias("why"))) for why, hit, to, sure in rules]
    pick = F.coalesce(*first, F.struct(F.lit("hybrid").alias("strategy"), F.lit(BALANCED).alias("sure"), F.lit("balanced").alias("why")))
    return found.withColumn("_pick", pick).select(*found.columns, "_pick.strategy", F.round("_pick.sure", 9).alias("sure"), "_pick.why")
