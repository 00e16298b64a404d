"""Boolean and phrase search over a positional index, ranked by cover density.

A query is words that must all be there, "phrases" of adjacent words, -words or -"phrases" that must not, and or between alternatives. The index holds
the places of each term in each chunk. Phrases come from joining places, alternatives from counting the parts of them that a chunk holds, and a chunk's rank is the
sum over all minimal covers, the shortest stretches that satisfy the query.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import C, Q
from lakeloom.sources.shared import new_path, written

#: A term is a run of letters and digits; a part of a query a quoted phrase or what stands between blanks, either with a minus before it.
TERM = r"[\p{L}\p{N}]+"
PART = r'(-?"[^"]*"|[^\s"]+)'
#: Calls and codes such as range(5) and 195/65R15; what a hit on one adds to the rank; the weight of a place.
SYMBOL = r"[A-Za-z_][\w.]*\([^()\s]*\)|[A-Za-z0-9]+(?:[/.\-][A-Za-z0-9]+)+"
SYMBOL_BOOST, PLACE_WEIGHT = 1.0, 0.1
#: Flags of the rank's normalisation, to be added up: divide by the log of the length, the length, the mean harmonic distance of covers, the number
#: of different terms, its log, or rank + 1.
LOG_LENGTH, LENGTH, DISTANCE, DISTINCT, LOG_DISTINCT, SCALED = 1, 2, 4, 8, 16, 32


#: Terms of all queries that are held against each chunk where it is read; different patterns that each text is held against.
HELD, PATTERNS = 20_000, 200
#: Different questions of a block of a search for symbols, and finds that a task gathers before it keeps the best.
QUESTIONS, GATHERED = 50_000, 500_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def positional_index(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, places, size, n_terms): where each term stands in each chunk, the chunk's terms and its different ones.

    A chunk's places are gathered where it is read; the rows are then sorted by term and written, so a reader of few terms skips most of the file, and a
    very frequent term takes as many partitions as it needs.
    """
    kind = chunks.schema[C].dataType.simpleString()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(lists.flatten())
            if not len(words):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes) + 1
            key = row * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            at = order[starts]
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            rows, different = row[at], np.bincount(row[at], minlength=len(sizes))
            columns = [words.dictionary.take(words.indices.take(pa.array(at))), b.column(0).take(pa.array(rows)), places, pa.array(sizes[rows], pa.int32()), pa.array(different[rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["term", C, "places", "size", "n_terms"])

    split = chunks.select(C, terms(F.col("content")).alias("t")).where(F.size("t") > 0)
    rows = split.mapInArrow(group, f"term string, {C} {kind}, places array<int>, size int, n_terms int")
    return written(rows.repartitionByRange("term", C).sortWithinPartitions("term", C), "positional")


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, grp, lit, at, n, negated, term): the terms of queries(query_id, text).

    Alternatives are groups; a group's literals are its words and phrases; at is a word's place in a phrase of n words. An unquoted part of several
    terms, such as range(5), stands for all of them.
    """
    parts = queries.select(Q, F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PART), 1)).alias("i", "part"))
    split = F.lower("part") == "or"
    own = Window.partitionBy(Q).orderBy("i")
    parts = parts.withColumn("grp", F.sum(split.cast("int")).over(own)).where(~split)
    parts = parts.select(Q, "grp", "i", F.startswith("part", F.lit("-")).alias("negated"), F.contains("part", F.lit('"')).alias("quoted"), terms(F.col("part")).alias("t"))
    found = parts.select("*", F.posexplode("t").alias("k", "term"))
    lit = F.col("i") * 1_000_000 + F.when(F.col("quoted"), 0).otherwise(F.col("k"))
    return found.select(
        Q, F.col("grp").cast("int").alias("grp"), lit.cast("long").alias("lit"), F.when(F.col("quoted"), F.col("k")).otherwise(0).alias("at"),
        F.when(F.col("quoted"), F.size("t")).otherwise(1).alias("n"), "negated", "term",
    )


def cover_score(groups: list[list[tuple[int, list[int]]]], entries: list[int], size: int, n_terms: int, flags: int) -> float:
    """The sum over minimal covers of a place's weight by one more than the places in it that the query doesn't name, normalised.

    groups: for each alternative, each literal's words and the places where it starts; entries: all places of the query's terms.
    """
    nexts = [[0] * len(g) for g in groups]
    index = {p: i for i, p in enumerate(entries)}
    total, low, n, middle, nearness = 0.0, 0, 0, None, 0.0
    for end in entries:
        best = 0
        for g, at in zip(groups, nexts, strict=True):
            begin = end + 1
            for j, (words, starts) in enumerate(g):
                while at[j] < len(starts) and starts[at[j]] + words - 1 <= end:
                    at[j] += 1
                begin = min(begin, starts[at[j] - 1] if at[j] else 0)
            best = max(best, begin)
        if best > low:
            low = best
            total += PLACE_WEIGHT / (1 + (end - low) - (index[end] - index[low]))
            here = (end + low) / 2
            if middle is not None and here > middle:
                nearness += 1 / (here - middle)
            middle, n = here, n + 1
    if flags & LOG_LENGTH and size:
        total /= math.log(size + 1)
    if flags & LENGTH and size:
        total /= size
    if flags & DISTANCE and n and nearness:
        total /= n / nearness
    if flags & DISTINCT and n_terms:
        total /= n_terms
    if flags & LOG_DISTINCT and n_terms:
        total /= math.log2(n_terms + 1)
    return total / (total + 1) if flags & SCALED else total


def websearch(queries: DataFrame, index: DataFrame, flags: int = LOG_LENGTH | DISTANCE) -> DataFrame:
    """(query_id, chunk_id, score): the chunks of a positional index that satisfy each of queries(query_id, text).

    An alternative holds where all its literals stand and none of the forbidden ones; one without a literal that must stand finds nothing. Covers are those of the
    alternatives that hold. Places aren't capped. Null and empty queries find nothing.
    """
    asked = written(parsed(queries), "parsed")
    hits = written(index.join(asked, "term").select(Q, "grp", "lit", "at", "n", "negated", C, "places", "size", "n_terms"), "hits")
    key = [Q, C, "grp", "lit", "n", "negated"]
    ones = hits.where("n = 1").select(*key, F.col("places").alias("starts"))
    runs = hits.where("n > 1").select(*key, F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start")).groupBy(*key, "start").count().where("count = n")
    found = written(ones.unionByName(runs.groupBy(*key).agg(F.array_sort(F.collect_list("start")).alias("starts"))), "literals")
    must = asked.where("NOT negated").groupBy(Q, "grp").agg(F.count_distinct("lit").alias("must"))
    held = found.groupBy(Q, C, "grp").agg(F.count_if(~F.col("negated")).alias("has"), F.count_if("negated").alias("bad"))
    good = written(held.join(must, [Q, "grp"]).where("has = must AND bad = 0").select(Q, C, "grp"), "good")
    literals = found.join(good, [Q, C, "grp"], "left_semi").groupBy(Q, C).agg(F.collect_list(F.struct("grp", "n", "starts")).alias("literals"))
    chunk = good.select(Q, C).distinct()
    places = hits.join(chunk, [Q, C], "left_semi").groupBy(Q, C).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("entries"), F.first("size").alias("size"), F.first("n_terms").alias("n_terms"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for literals, entries, size, n_terms in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                groups: dict[int, list] = {}
                for x in literals:
                    groups.setdefault(x["grp"], []).append((x["n"], x["starts"]))
                scores.append(cover_score(list(groups.values()), entries, size, n_terms, flags))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], [Q, C, "score"])

    kinds = [hits.schema[c].dataType.simpleString() for c in (Q, C)]
    return literals.join(places, [Q, C]).select(Q, C, "literals", "entries", "size", "n_terms").mapInArrow(rank, f"{Q} {kinds[0]}, {C} {kinds[1]}, score double")


def _starts(literal: dict[int, int], places: dict[int, list[int]]) -> list[int]:
    """Where a word or phrase {place in it: term} starts, by the places of terms."""
    if len(literal) == 1:
        return [p - at for at, t in literal.items() for p in places.get(t, ())]
    common = set.intersection(*({p - at for p in places.get(t, ())} for at, t in literal.items()))
    return sorted(common)


def websearch_texts(queries: DataFrame, chunks: DataFrame, flags: int = LOG_LENGTH | DISTANCE, held: int = HELD) -> DataFrame:
    """websearch of chunks(chunk_id, content) without an index: each chunk is read once and held against all queries where it is read, so neither places nor hits are shuffled.

    Presence of words decides first, for all queries at once. Queries of more than held terms in all go by the index.
    """
    asked = written(parsed(queries), "parsed")
    if asked.count() > held:
        return websearch(queries, positional_index(chunks), flags)
    rows = asked.collect()
    known = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(known)}
    # By query and alternative: its literals as {place in the phrase: term}, those that must stand and those that must not.
    literals: dict = {}
    for r in rows:
        literals.setdefault((r[Q], r["grp"]), {}).setdefault((r["negated"], r["lit"]), {})[r["at"]] = number[r["term"]]
    groups = [(q, [x for (no, _), x in own.items() if not no], [x for (no, _), x in own.items() if no]) for (q, _), own in literals.items()]
    groups = [g for g in groups if g[1]]
    terms_of: dict = {}
    for r in rows:
        terms_of.setdefault(r[Q], set()).add(number[r["term"]])
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, Q), (chunks, C))]
    query_type = pa.array([r[Q] for r in rows[:1]]).type if rows else pa.int64()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        must = np.zeros((len(known), len(groups)), np.float32)
        for k, (_, whole, _) in enumerate(groups):
            must[[t for x in whole for t in x.values()], k] = 1
        least, value_set = must.sum(axis=0), pa.array(known, pa.string())
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                lists = b.column(1)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                words = pc.dictionary_encode(lists.flatten())
                if not len(words):
                    continue
                to = pc.fill_null(pc.index_in(words.dictionary, value_set=value_set), -1).to_numpy()
                code = words.indices.to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                n_terms = np.bincount(np.unique(row * len(words.dictionary) + code) // len(words.dictionary), minlength=len(sizes)) if flags & (DISTINCT | LOG_DISTINCT) else sizes
                term = to[code]
                some = term >= 0
                term, at, place = term[some], row[some], place[some]
                present = np.zeros((len(sizes), len(known)), np.float32)
                present[at, term] = 1
                met = np.argwhere(present @ must == least)
                order = np.lexsort((place, term, at))
                term, at, place = term[order], at[order], place[order]
                cuts = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(term) != 0)))
                ends, by_row = np.append(cuts[1:], len(at)), np.searchsorted(at[cuts], np.arange(len(sizes) + 1))
                out: tuple[list, list, list] = ([], [], [])
                for i, of in groupby(met.tolist(), key=lambda x: x[0]):
                    places = {int(term[cuts[j]]): place[cuts[j] : ends[j]].tolist() for j in range(by_row[i], by_row[i + 1])}
                    good: dict = {}
                    for _, k in of:
                        q, stand, denied = groups[k]
                        found = [(len(x), _starts(x, places)) for x in stand]
                        if all(s for _, s in found) and not any(_starts(x, places) for x in denied):
                            good.setdefault(q, []).append(found)
                    for q, found in good.items():
                        entries = sorted({p for t in terms_of[q] for p in places.get(t, ())})
                        out[0].append(q)
                        out[1].append(i)
                        out[2].append(cover_score(found, entries, int(sizes[i]), int(n_terms[i]), flags))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], query_type), b.column(0).take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.float64())], [Q, C, "score"])

    split = chunks.select(C, terms(F.col("content")).alias("t")).where(F.size("t") > 0)
    return split.mapInArrow(search, f"{Q} {kinds[0]}, {C} {kinds[1]}, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best, equal scores by chunk_id."""
    own = Window.partitionBy(Q).orderBy(F.desc("score"), C)
    return found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def symbol(text: Column) -> Column:
    """The first call or code of a text; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), SYMBOL, 0)


def with_symbols(queries: DataFrame, index: DataFrame, flags: int = LOG_LENGTH | DISTANCE, boost: float = SYMBOL_BOOST) -> DataFrame:
    """(query_id, chunk_id, score): websearch, and also chunks with the query's symbol as a phrase, which gain a boost."""
    coded = queries.select(Q, F.concat(F.lit('"'), symbol(F.col("text")), F.lit('"')).alias("text")).where("text <> '\"\"'")
    plain = websearch(queries, index, flags)
    exact = websearch(coded, index, flags).select(Q, C, F.lit(boost).alias("gain"))
    both = plain.join(exact, [Q, C], "full")
    return both.select(Q, C, (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))


class Best:
    """The k best finds of each of n questions over a task's batches: highest scores first, rounded, then least chunk ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.size = k, np.full(n, -np.inf), [], 0

    def add(self, question: np.ndarray, score: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """Finds of the ids in the places at."""
        score = np.floor(score * 1e9 + 0.5) / 1e9
        some = score >= self.least[question]
        if some.any():
            self.parts.append(pa.table({"q": question[some].astype(np.int32), "score": score[some], "id": ids.take(pa.array(at[some]))}))
            self.size += int(some.sum())
            if self.size > GATHERED:
                self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        both = pa.concat_tables(self.parts)
        both = both.take(pc.sort_indices(both, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        q = both.column("q").to_numpy()
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = np.flatnonzero(place == self.k - 1)
        self.least[q[last]] = both.column("score").to_numpy()[last]
        # What stays counts towards the next time only by half of the bound, so that many questions don't settle with each batch.
        self.parts = [both.filter(pa.array(place < self.k)).combine_chunks()]
        self.size = min(self.parts[0].num_rows, GATHERED // 2)


def best_with_symbols(queries: DataFrame, chunks: DataFrame, k: int, flags: int = LOG_LENGTH | DISTANCE, boost: float = SYMBOL_BOOST, questions: int = QUESTIONS) -> DataFrame:
    """(query_id, chunk_id, score, rank): best of with_symbols over chunks(chunk_id, content) without an index.

    Queries that ask for the same words are one question. Each chunk is read once and held against all questions where it is read: those of a single word are answered for all of the chunk's
    words at once, the others where their words stand, and a task passes on the k best of each. Beyond so many questions, they are answered in blocks.
    """
    named = written(queries.select(Q, F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.lower(symbol(F.col("text"))).alias("code")), "asked")
    different = named.select("text", "code").distinct()
    n = max(1, -(-different.count() // questions))
    found = []
    for i in range(n):
        part = different.where(F.pmod(F.xxhash64("text", "code"), F.lit(n)) == i)
        numbers, finds = _symbol_block(part, chunks, k, flags, boost)
        own = Window.partitionBy("number").orderBy(F.desc("score"), C)
        first = finds.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        found.append(first.join(F.broadcast(numbers), "number").join(named, ["text", "code"]).select(Q, C, "score", "rank"))
    if n > 1:
        found = [written(df, "symbols") for df in found]
    return functools.reduce(DataFrame.union, found)


def _symbol_block(different: DataFrame, chunks: DataFrame, k: int, flags: int, boost: float) -> tuple[DataFrame, DataFrame]:
    """(number, text, code) of the questions and (number, chunk_id, score) of what tasks find for them."""
    spark, kind = different.sparkSession, chunks.schema[C].dataType.simpleString()
    names = different.select(F.struct("text", "code").alias(Q), "text")
    literals: dict = {}
    for r in parsed(names).collect():
        literals.setdefault(r[Q], {}).setdefault(r["grp"], {}).setdefault((r["negated"], r["lit"]), {})[r["at"]] = r["term"]
    number: dict = {}
    rows = []
    for r in names.select(Q, terms(F.col(f"{Q}.code")).alias("t")).collect():
        alternatives = []
        for own in literals.get(r[Q], {}).values():
            sides = [sorted(tuple(sorted(x.items())) for (no, _), x in own.items() if no == side) for side in (False, True)]
            alternatives.append(tuple(map(tuple, sides)))
        question = (tuple(sorted(alternatives)), tuple(enumerate(r["t"])))
        rows.append((number.setdefault(question, len(number)), r[Q]["text"], r[Q]["code"]))
    shared = spark.sparkContext.broadcast(list(number))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        known = sorted({t for groups, code in asked for x in (*(lit for g in groups for side in g for lit in side), code) for _, t in x})
        at_term = {t: i for i, t in enumerate(known)}
        coded = lambda x: {p: at_term[t] for p, t in x}
        single, groups, words = [], [], {}
        for q, (alternatives, code) in enumerate(asked):
            if len(alternatives) == 1 and not code and len(alternatives[0][0]) == 1 and len(alternatives[0][0][0]) == 1 and not alternatives[0][1]:
                ((_, t),) = alternatives[0][0][0]
                single.append((at_term[t], q))
                continue
            words[q] = sorted({at_term[t] for g in alternatives for side in g for x in side for _, t in x})
            groups += [(q, [coded(x) for x in stand], [coded(x) for x in denied]) for stand, denied in alternatives if stand]
            groups += [(q, None, [coded(code)])] if code else []
        alone = np.full(len(known) + 1, -1)
        alone[[t for t, _ in single]] = [q for _, q in single]
        # By term: the groups that need it.
        needs = [sorted({t for x in (last if stand is None else stand) for t in x.values()}) for _, stand, last in groups]
        need, pair = np.array([len(x) for x in needs], np.int64), np.array([(t, g) for g, x in enumerate(needs) for t in x], np.int64).reshape(-1, 2)
        pair = pair[np.argsort(pair[:, 0], kind="stable")]
        degree = np.bincount(pair[:, 0], minlength=len(known) + 1)
        offset, value_set, top = np.cumsum(degree) - degree, pa.array(known, pa.string()), Best(len(asked), k)
        for whole in batches if known else ():
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                lists = b.column(1)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                encoded = pc.dictionary_encode(lists.flatten())
                if not len(encoded):
                    continue
                code = encoded.indices.to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                n_terms = np.bincount(np.unique(row * len(encoded.dictionary) + code) // len(encoded.dictionary), minlength=len(sizes)) if flags & (DISTINCT | LOG_DISTINCT) else sizes
                term = pc.fill_null(pc.index_in(encoded.dictionary, value_set=value_set), -1).to_numpy()[code]
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                key = (row * len(known) + term)[term >= 0]
                place = place[term >= 0][order := np.argsort(key, kind="stable")]
                key = key[order]
                if not len(key):
                    continue
                new = np.append(True, key[1:] != key[:-1])
                cuts = np.flatnonzero(new)
                ends, runs = np.append(cuts[1:], len(key)), key[cuts]
                at, term = np.divmod(runs, len(known))
                # A single word: each place is a cover.
                some = np.flatnonzero(alone[term] >= 0)
                near = np.bincount((np.cumsum(new) - 1)[~new], weights=1 / np.diff(place)[~new[1:]], minlength=len(cuts))[some]
                times, size, different = (ends - cuts)[some], sizes[at[some]], n_terms[at[some]]
                total = PLACE_WEIGHT * times
                total = total / np.log(size + 1) if flags & LOG_LENGTH else total
                total = total / size if flags & LENGTH else total
                total = np.where(near > 0, total * near / times, total) if flags & DISTANCE else total
                total = total / different if flags & DISTINCT else total
                total = total / np.log2(different + 1) if flags & LOG_DISTINCT else total
                top.add(alone[term[some]], total / (total + 1) if flags & SCALED else total, b.column(0), at[some])
                if not groups:
                    continue
                deg = degree[term]
                of = pair[np.arange(deg.sum()) - np.repeat(np.cumsum(deg) - deg, deg) + np.repeat(offset[term], deg), 1]
                met, has = np.unique(np.repeat(at, deg) * len(groups) + of, return_counts=True)
                rows, of = np.divmod(met, len(groups))
                full = has == need[of]
                out: dict = {}
                for i, g in zip(rows[full].tolist(), of[full].tolist()):
                    out.setdefault((i, groups[g][0]), []).append(g)
                scores = []
                for (i, q), own in out.items():
                    places = {}
                    for t in {t for g in own for x in (*(groups[g][1] or ()), *groups[g][2]) for t in x.values()}.union(words[q]):
                        j = np.searchsorted(runs, i * len(known) + t)
                        if j < len(runs) and runs[j] == i * len(known) + t:
                            places[t] = place[cuts[j] : ends[j]].tolist()
                    good, gain = [], 0.0
                    for _, stand, last in (groups[g] for g in own):
                        if stand is None:
                            gain = boost if _starts(last[0], places) else 0.0
                            continue
                        held = [(len(x), _starts(x, places)) for x in stand]
                        if all(s for _, s in held) and not any(_starts(x, places) for x in last):
                            good.append(held)
                    if good or gain:
                        entries = sorted({p for t in words[q] for p in places.get(t, ())})
                        scores.append((q, i, gain + (cover_score(good, entries, int(sizes[i]), int(n_terms[i]), flags) if good else 0.0)))
                if scores:
                    q, i, total = (np.array(x) for x in zip(*scores))
                    top.add(q, total, b.column(0), i)
        top.settle()
        for part in top.parts:
            yield from part.select(["q", "id", "score"]).rename_columns(["number", C, "score"]).to_batches(max_chunksize=10_000)

    split = chunks.select(C, terms(F.col("content")).alias("t")).where(F.size("t") > 0)
    finds = split.mapInArrow(search, f"number int, {C} {kind}, score double")
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))]
    return spark.createDataFrame(pa.table(columns, ["number", "text", "code"])), finds


def anchored(found: DataFrame, chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """found(query_id, chunk_id, ...) under the structural anchors that patterns(query_id, pattern) names, as LIKE patterns of the chunk's content.

    A query whose anchors match none of its chunks keeps them all, so an anchor that doesn't exist empties no answer.
    """
    found = written(found, "found")
    text, wanted = chunks.select(C, "content"), patterns.select("pattern").distinct()
    if wanted.count() <= PATTERNS:
        # Each text is held against all patterns where it is read, and only the names of what matches go on.
        fits = text.join(F.broadcast(wanted), F.expr("content LIKE pattern")).select(C, "pattern")
        hit = found.join(patterns, Q).join(fits, [C, "pattern"]).select(Q, C).distinct()
    else:
        hit = found.join(patterns, Q).join(text, C).where("content LIKE pattern").select(Q, C).distinct()
    hit = written(hit, "anchored")
    named = found.join(hit, [Q, C], "left_semi")
    return named.unionByName(found.join(hit.select(Q).distinct(), Q, "left_anti"))
