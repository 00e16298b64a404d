"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A set of size s belongs to a size band. The universe of shingles is hashed into m segments, m by band, so every set falls into m subsets.
Two sets that are similar enough differ in few shingles, H at most; give each segment an allowance of -1 (not looked at), 0 or 1 that,
each raised by one, add up to H + 1: then in some segment the subsets differ by no more than the allowance. So each set is indexed
by its subsets, and by the one-deletion neighbours of some segments; it looks up, in its own band and all below that hold similar sizes, the segments
that are cheapest by counts over the whole corpus. Sets that meet under a key are verified exactly on their texts.

A key that many sets share does not make all pairs of them. First each set is compared only with the set of its keys that meets the most
others; links make components. Then only sets that share a key and are not in one component yet are paired, so none is missed. A
sketch of parities goes before both: two sketches differ in no more bits than the sets in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, connected_components, materialize, mix64, pieces

#: Bytes of text that are hashed at once: some ten arrays of eight bytes a letter stand beside them.
PIECE = 1 << 18
#: Counters of the cost table: its size does not depend on the corpus.
COUNTERS = 1 << 17
#: Rows (id and hash) that may be broadcast to pick texts; beyond it they are joined.
BROADCAST_PICKS = 300_000
#: Rows of a key that a task sends to one place before it keeps further ones apart; partners that one copy of a text is compared with.
OFTEN, PARTNERS = 200, 2000
INDEX, INDEX_DELETION, LOOK, LOOK_WIDE, LOOK_DELETION = 1, 2, 4, 8, 16
ONLY_LOOKS = 1 << 60
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A word is hashed by two polynomials of its bytes, A-Z as a-z, modulo two primes below 2^31 and with a base each. (Modulo a power of two, words such as the Thue-Morse
#: sequence and its complement would share a hash whatever the base.)
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525173)
LETTER = np.array([x + 32 * (65 <= x <= 90) + 1 for x in range(256)], np.uint64)
#: Bytes whose terms, each below 2^40, can be summed without overflow.
SUMMED = 1 << 22
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Shingler:
    """Sorted distinct shingle hashes of texts: words are lower-cased (A-Z) runs without ASCII white space.

    A word's hash joins two polynomials of its bytes, read off running sums over many texts at once; a shingle's is a sum of its words' hashes, each
    times a factor of its place.
    """

    def __init__(self, k: int):
        self.k = k
        self.factors = mix64(np.arange(1, k + 1, dtype=np.uint64) * ODD[0]) | np.uint64(1)
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def _powers(self, n: int) -> None:
        for powers, sign in ((self.up, 1), (self.down, -1)):
            for i, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                while len(powers[i]) < n:
                    powers[i] = np.append(powers[i], powers[i] * np.uint64(pow(base, sign * len(powers[i]), p)) % np.uint64(p))

    def _sums(self, terms: np.ndarray, p: int) -> np.ndarray:
        """Running sums, from 0, that leave the right remainder modulo p."""
        out = np.zeros(len(terms) + 1, np.uint64)
        for at in range(0, len(terms), SUMMED):
            part = out[at + 1 : at + 1 + SUMMED]
            np.cumsum(terms[at : at + SUMMED], out=part)
            part += out[at]
            if len(terms) > SUMMED:
                part %= np.uint64(p)
        return out

    def _words(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in bytes that start and end at the cuts; how many words start before each cut."""
        n = len(b)
        self._powers(n)
        word = ~SPACE[b]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < n)]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters, both = LETTER[b], []
        for p, up, down in zip(PRIMES, self.up, self.down, strict=True):
            q, sums = np.uint64(p), self._sums(letters * up[:n], p)
            both.append((sums[end] + np.where(sums[end] < sums[start], q, np.uint64(0)) - sums[start]) % q * down[start] % q)
        h = mix64(both[0] << np.uint64(31) | both[1]) + (end - start).astype(np.uint64) * ODD[1]
        return mix64(h), np.searchsorted(start, cuts)

    def _long(self, b: np.ndarray) -> np.ndarray:
        """Hashes of the words of one text, piece by piece."""
        out, at = [], 0
        while at < len(b):
            end = min(len(b), at + PIECE)
            while end < len(b) and not SPACE[b[end]]:  # on to the end of the word
                gap = np.flatnonzero(SPACE[b[end : end + 4096]])
                end = end + int(gap[0]) if len(gap) else min(len(b), end + 4096)
            out.append(self._words(b[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The sets of texts; they should hold few bytes together, but for a long one alone."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        b = np.frombuffer(data or b"", np.uint8)[cuts[0] : cuts[-1]]
        if not len(b):
            return [np.empty(0, np.uint64)] * len(texts)
        h, at = (self._long(b), None) if len(texts) == 1 else self._words(b, cuts - cuts[0])
        at = [0, len(h)] if at is None else at.tolist()
        k = self.k
        out = h[:0]
        if len(h) >= k:
            out = h[: len(h) - k + 1] * self.factors[0]
            for i in range(1, k):
                out += h[i : len(h) - k + 1 + i] * self.factors[i]
            out = mix64(out + np.uint64(k))
        return [self._distinct(h, out, x, y) for x, y in zip(at, at[1:])]

    def _distinct(self, h: np.ndarray, out: np.ndarray, x: int, y: int) -> np.ndarray:
        n = y - x
        if n < self.k:  # the whole sequence is the only shingle
            return mix64((h[x:y] * self.factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else h[:0]
        s = np.sort(out[x : y - self.k + 1])
        same = s[1:] == s[:-1]
        return s[np.append(True, ~same)] if same.any() else s

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


class Scheme:
    """Bands, segments and keys for a threshold of num/den."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.edges = np.array(edges)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def segments(self, band: int) -> int:
        most = int(self.edges[band + 1] - 1) * (self.den - self.num) // self.num
        return most + 1 + (most + 7) // 8

    def with_deletions(self, band: int) -> int:
        """The first so many segments are indexed with their one-deletion neighbours as well."""
        m = self.segments(band)
        return m // 32 + 1 if m > 1 else 0

    def differences(self, a: int, b: int) -> int:
        """Shingles in which similar sets of these sizes differ at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def similar(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def keys(self, shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the segments' subsets; segment and key of each one-deletion neighbour."""
        m = self.segments(band)
        at = ((shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascends, as the shingles do
        own = mix64(shingles ^ ODD[2])
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own, out=sums[1:])
        sums = np.diff(sums[np.searchsorted(at, np.arange(m + 1))])
        name = (np.arange(m, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1)) * ODD[0]
        near = slice(0, int(np.searchsorted(at, self.with_deletions(band))))
        less = mix64((sums[at[near]] - own[near]) ^ name[at[near]])
        return mix64(sums ^ name).view(np.int64), at[near], less.view(np.int64)

    def allocate(self, full: np.ndarray, del_at: np.ndarray, dels: np.ndarray, need: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Allowances raised by one for each segment, cheapest first, that add up to need; the cost is how many sets the keys meet.

        The second unit of a segment costs its neighbours' meetings and a little for their number; it is never cheaper than the first, so the greedy choice is the
        best one and never takes the second without the first.
        """
        first = counts[full % len(counts)].astype(np.float64)
        d = int(del_at.max()) + 1 if len(del_at) else 0
        second = np.zeros(d)
        np.add.at(second, del_at, counts[dels % len(counts)] + 4.0)
        second = np.maximum(second + first[:d], first[:d] + 1)
        price = np.concatenate([first, second])
        taken = np.argsort(price, kind="stable")[:need]
        level = np.zeros(len(full), np.int8)
        np.add.at(level, np.where(taken < len(full), taken, taken - len(full)), 1)
        return np.flatnonzero(level), np.flatnonzero(level == 2)


def _fingerprint(shingles: np.ndarray) -> int:
    """64 bits for a whole set, the set's name from here on; 0 only for the empty set."""
    if not len(shingles):
        return 0
    return int(mix64(np.array([np.sum(mix64(shingles + ODD[1]))], np.uint64) ^ np.uint64(len(shingles))).view(np.int64)[0]) or 1


def same_shingles(a: bytes, b: bytes, k: int) -> tuple[int, int, int]:
    """Sizes of the sets of both texts, and shingles in common, by the words themselves: words and longer and longer runs of them get numbers without any hash."""
    texts = [t.lower().split() for t in (a, b)]
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts]
    if min(map(len, texts)) < k:
        same = texts[0] == texts[1]
        sizes = [len({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))}) if t else 0 for t in texts]
        return (*sizes, int(same and bool(texts[0])))
    runs, n = ids, len(number)
    for i in range(1, k):
        keys = [r[: len(r) - 1] * n + w[i:] for r, w in zip(runs, ids, strict=True)]
        _, both = np.unique(np.concatenate(keys), return_inverse=True)
        runs = [both[: len(keys[0])], both[len(keys[0]) :]]
    found = [np.unique(r) for r in runs]
    return len(found[0]), len(found[1]), len(np.intersect1d(*found, assume_unique=True))


SKETCH = ("s0", "s1", "s2", "s3")
#: Bits of the wide sketch at least and at most; between them, as many as there are shingles.
NARROW, WIDEST = 256, 1 << 16


def _sketches(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The parity of the number of shingles that hash to each of so many bits: of 256, as four numbers, and of as many as the set needs."""
    m = min(WIDEST, max(NARROW, 1 << max(0, len(shingles) - 1).bit_length()))
    bits = np.bincount((mix64(shingles ^ ODD[0]) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    wide = np.packbits(bits.astype(np.uint8)).view(np.int64)
    return _folded(wide, NARROW // 64), wide.tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: halves meet by parity."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _close(a: str, b: str, scheme: Scheme) -> Column:
    """Whether the sketches of two sides, each with n and a sketch, leave similar sets possible."""
    far = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    both = (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long")
    return far * (scheme.den + scheme.num) <= both * (scheme.den - scheme.num)


def _prints(found: list[np.ndarray]) -> list[pa.Array]:
    """Columns node, n_shingles, the sketch of 256 bits and the wide one of sets."""
    both = [_sketches(s) for s in found]
    narrow = np.array([x for x, _ in both], np.int64).reshape(-1, 4).T
    head = [pa.array(map(_fingerprint, found), pa.int64()), pa.array(map(len, found), pa.int64())]
    return [*head, *(pa.array(np.ascontiguousarray(x)) for x in narrow), pa.array([x for _, x in both], pa.binary())]


class Once:
    """Tells most sets that a task has met before."""

    def __init__(self, most: int = 500_000):
        self.met, self.most = set(), most

    def __call__(self, node: int) -> bool:
        if node in self.met:
            return False
        if len(self.met) < self.most:
            self.met.add(node)
        return True


def sets(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, s0 to s3, wide, counter, met): a row without counter for each row of docs; text_key is a hash of the text.

    Further rows tell how many index keys of the whole corpus fall under each counter, task by task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "node", "n_shingles", *SKETCH, "wide", "counter", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, once, counts, schema = Shingler(k), Once(), np.zeros(COUNTERS, np.int64), None
        for b in pieces(batches, 2, PIECE):
            found = shingle.batch(b.column(2))
            prints = _prints(found)
            has_id = b.column(0).is_valid().to_pylist()
            keys = [scheme.keys(s, scheme.band(len(s))) for s, node, ok in zip(found, prints[0].to_pylist(), has_id, strict=True) if ok and len(s) and once(node)]
            if keys:
                flat = np.concatenate([x for full, _, dels in keys for x in (full, dels)])
                counts += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
            none = pa.nulls(b.num_rows, pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), *prints, none, none], names)
            schema = out.schema
            yield out
        if schema is not None and counts.any():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in schema.types[:-2]), pa.array(at), pa.array(counts[at])], schema=schema)

    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return read.mapInArrow(run, f"doc_id {kind}, text_key long, node long, n_shingles long, s0 long, s1 long, s2 long, s3 long, wide binary, counter long, met long")


def key_counts(named: DataFrame) -> np.ndarray:
    """How many index keys of the whole corpus fall under each counter."""
    counts = np.zeros(COUNTERS, np.int64)
    for row in named.where("counter IS NOT NULL").groupBy("counter").agg(F.sum("met")).toLocalIterator():
        counts[row[0]] = row[1]
    return counts


class Often:
    """Deals out the keys that a task meets often: their further rows stay among themselves, in a part of the task's own.

    Part 0 of a key gets the first rows of each task, and the first row that it puts elsewhere of each kind, index and look-up. So part 0 has an index
    row if the key has any, and each other part a row in common with it.
    """

    def __init__(self, part: int, often: int, slots: int = 1 << 20):
        self.part, self.often, self.counts, self.marked = part, often, np.zeros(slots, np.int32), set()

    def __call__(self, key: np.ndarray, node: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, ...]:
        slot = key & (len(self.counts) - 1)
        order = np.argsort(slot, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
        size = np.diff(np.append(start, len(slot)))
        rank = np.empty(len(slot), np.int64)
        rank[order] = np.arange(len(slot)) - np.repeat(start, size)
        far = self.counts[slot] + rank >= self.often
        self.counts[slot[order[start]]] += size.astype(np.int32)
        at = np.flatnonzero(far)
        part = np.where(far, self.part, 0).astype(np.int32)
        if not len(at):
            return key, part, node, info
        first = []
        for i, name in zip(at.tolist(), zip(key[at].tolist(), (info[at] < ONLY_LOOKS).tolist(), strict=True), strict=True):
            if name not in self.marked:
                self.marked.add(name)
                first.append(i)
        return tuple(np.append(x, y) for x, y in ((key, key[first]), (part, np.zeros(len(first), np.int32)), (node, node[first]), (info, info[first])))


def key_rows(docs: DataFrame, k: int, scheme: Scheme, counts: np.ndarray) -> DataFrame:
    """(key, part, node, info): each distinct set's index keys and the keys it looks up; a key that is both is one row.

    info sorts index rows first, and of these the sets whose own keys meet the most others by the counters; its low byte holds the flags.
    """
    shared, often = docs.sparkSession.sparkContext.broadcast(counts), OFTEN

    def keys_of(s: np.ndarray, node: int) -> list[tuple[np.ndarray, ...]]:
        size, own, weight, out = len(s), scheme.band(len(s)), 0, []
        for band in range(own, -1, -1):
            top = min(size, int(scheme.edges[band + 1]) - 1)
            if scheme.den * top < scheme.num * size:
                break
            full, at, dels = scheme.keys(s, band)
            one, two = scheme.allocate(full, at, dels, scheme.differences(size, top) + 1, shared.value)
            look = np.zeros(len(full), np.int8)
            look[one] = LOOK
            look[two] = LOOK_WIDE
            near = np.where(np.isin(at, two), LOOK_DELETION, 0).astype(np.int8) if len(two) else np.zeros(len(at), np.int8)
            if band == own:
                look |= INDEX
                near |= INDEX_DELETION
                weight = min(int(shared.value[full & (COUNTERS - 1)].sum()), 2**31 - 1)
            keys, flags = np.concatenate([full, dels]), np.concatenate([look, near]).astype(np.int64)
            keys, flags = keys[flags > 0], flags[flags > 0]
            order = np.where(flags & (INDEX | INDEX_DELETION), (2**31 - 1 - weight) << 8, ONLY_LOOKS)
            out.append((keys, np.full(len(keys), node, np.int64), order | flags))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shingle, once, deal = Shingler(k), Once(), Often(1 + task.partitionId(), often)
        for b in pieces(batches, 0, PIECE):
            out: list[tuple[np.ndarray, ...]] = []
            for s in shingle.batch(b.column(0)):
                if len(s) and once(node := _fingerprint(s)):
                    out += keys_of(s, node)
            if out:
                rows = deal(*(np.concatenate(x) for x in zip(*out, strict=True)))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, rows)), ["key", "part", "node", "info"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text").mapInArrow(run, "key long, part int, node long, info long")


def meeting_rows(rows: DataFrame) -> DataFrame:
    """(key, node, flags, hub): the rows of keys that an index row shares with others; hub is the first index row of the key's part.

    Each part's rows come sorted, from a sort that spills, and pass through with one row kept back, so no key needs memory. Look-ups in a part without
    an index row are their own hubs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)  # the last group's only row so far
        last: tuple[int, ...] | None = None
        going: tuple[tuple[int, int], int, bool] | None = None  # the last group, its hub and whether it has one, if its rows are being passed on
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1)
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]).any(axis=1)
            fresh[0] = last is None or tuple(t[0]) != last
            last = tuple(t[-1])
            t = np.concatenate([held, t[fresh]])
            held = held[:0]
            if not len(t):
                continue
            start = np.flatnonzero(np.concatenate([[True], (t[1:, :2] != t[:-1, :2]).any(axis=1)]))
            size = np.diff(np.append(start, len(t)))
            hub, good, on = t[start, 2].copy(), t[start, 3] < ONLY_LOOKS, size > 1
            if going and tuple(t[0, :2]) == going[0]:
                hub[0], good[0], on[0] = going[1], going[2], True
            if on[-1]:
                going = (tuple(t[-1, :2]), int(hub[-1]), bool(good[-1]))
            else:
                held, going = t[-1:], None
            hub, lone = np.repeat(hub, size), np.repeat(~good, size)
            keep = np.repeat(on, size) & (~lone | (t[:, 1] > 0))
            hub[lone] = t[lone, 2]
            found = [t[keep, 0], t[keep, 2], (t[keep, 3] & 255).astype(np.int8), hub[keep]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["key", "node", "flags", "hub"])

    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "info", "node").select("key", "part", "node", "info")
    return ordered.mapInArrow(run, "key long, node long, flags byte, hub long")


def _plausible(pairs: DataFrame, named: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b) of the pairs whose wide sketches differ in no more bits than similar sets may in shingles."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wide = named.select("node", F.struct("n_shingles", "wide").alias("of")).join(nodes, "node").groupBy("node").agg(F.first("of").alias("of"))
    side = lambda c: wide.select(F.col("node").alias(c), F.col("of.n_shingles").alias(f"n_{c}"), F.col("of.wide").alias(f"wide_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(u), len(v))
                far = int(np.bitwise_count(_folded(u, size) ^ _folded(v, size)).sum())
                good.append(far * (scheme.den + scheme.num) <= (n + m) * (scheme.den - scheme.num))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, k: int, scheme: Scheme, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of the pairs whose sets are similar, by their sizes and common shingles: first by hashes, and what these find by the words themselves.

    The texts of all a that were paired with one b follow the text of b through a task, so that of b travels once for each PARTNERS of them.
    """
    load = pairs.groupBy("b").agg(F.count("*").alias("load"))
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("load") / PARTNERS)).cast("int")
    asks = pairs.join(load, "b").select(F.col("a").alias("node"), "b", part.alias("part"), F.lit(1).alias("role"))
    asks = asks.union(asks.select(F.col("b").alias("node"), "b", "part", F.lit(0).alias("role")).distinct())
    asks = scratch.write(asks.join(names.select("node", "doc_id"), "node"), "asks")
    small = asks.count() <= BROADCAST_PICKS
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(asks) if small else asks, "doc_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, group, there, text = Shingler(k), None, None, b""
        for batch in pieces(batches, 4, PIECE):
            found = []
            texts = batch.column(4).cast(pa.large_binary())
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), shingle.batch(batch.column(4)), strict=True)
            for i, (b, part, role, node, s) in enumerate(rows):
                if (b, part) != group:
                    group, there = (b, part), None
                if _fingerprint(s) != node:  # another row under the same id
                    continue
                if role == 0:
                    there, text = s, texts[i].as_py()
                elif there is not None and scheme.similar(len(np.intersect1d(s, there, True)), len(s), len(there)):
                    n, m, common = same_shingles(texts[i].as_py(), text, k)
                    if scheme.similar(common, n, m):
                        found.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    ordered = texts.repartition("b", "part").sortWithinPartitions("b", "part", "role").select("b", "part", "role", "node", "text")
    found = scratch.write(ordered.mapInArrow(check, "a long, b long"), name)
    scratch.drop("asks")
    return found


def components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id is the least doc_id that links reach.

    Two rows link if den * common shingles >= num * all shingles of both. A text of fewer than k words has one shingle, its words; null, empty and
    blank texts have none and link with nothing. Rows without a doc_id have a null component and link with nothing. Repeated rows each give a row;
    other columns are not read. Sets are named by 64 bits: among n different sets, two share a name with a probability of n^2 / 2^65.
    """
    return _components(docs, k, num, den).drop("text_key")


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The components' rows with text_key."""
    scheme, scratch = Scheme(num, den), Scratch(docs.sparkSession)
    named = scratch.write(sets(docs, k, scheme), "sets")
    counts = key_counts(named)
    named = named.where("counter IS NULL").drop("counter", "met")
    candidates = lambda pairs: scratch.write(_plausible(scratch.write(pairs, "pairs"), named, scheme), "candidates")
    known = named.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("node")
    names = scratch.write(known.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in SKETCH]), "names")
    rows = scratch.write(meeting_rows(key_rows(docs, k, scheme, counts)), "met")

    has = lambda c, bits: F.col(c).bitwiseAND(F.lit(bits)) != 0
    indexed, looked = INDEX | INDEX_DELETION, LOOK | LOOK_WIDE | LOOK_DELETION
    tried = rows.where(has("flags", looked) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    tried = scratch.write(tried.distinct(), "tried")
    of = [names.select(F.col("node").alias(c), F.struct("n", *SKETCH).alias(f"of_{c}")) for c in "ab"]
    tried = tried.join(of[0], "a").join(of[1], "b").where(_close("of_a", "of_b", scheme)).select("a", "b")
    tried = candidates(tried)
    scratch.drop("tried")
    links = _verified(tried, docs, names, k, scheme, scratch, "links")
    label = scratch.write(connected_components(links), "labels")

    rows = rows.join(label, "node", "left").select("key", "node", "flags", "hub", F.coalesce("component", "node").alias("label"))
    rows = scratch.write(rows, "labelled")
    scratch.drop("met", "labels")
    # All index rows but the hub of their look-ups are still to be met: a key with one of them is done.
    own = F.when(has("flags", indexed), F.col("node"))
    ends = rows.groupBy("key").agg(*(f(c).alias(f"{f.__name__}_{n}") for f in (F.min, F.max) for n, c in (("label", F.col("label")), ("index", own))))
    mixed = ends.where("min_label <> max_label AND min_index <> max_index").select("key")
    rows = rows.join(scratch.write(mixed, "mixed"), "key").join(names.select("node", F.struct("n", *SKETCH).alias("of")), "node")
    rows = scratch.write(rows, "open")
    scratch.drop("labelled", "mixed")
    # Each look-up has met its part's hub; the rest of the key's index rows are met now, if no links join the two yet.
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("node", "of", "flags", "label")]
    x = rows.where(has("flags", indexed)).select("key", *side("b"))
    y = rows.where(has("flags", looked)).select("key", "hub", *side("a"))
    # A neighbour meets a whole subset, not another neighbour, and a plain look meets whole subsets only.
    meet = has("flags_b", INDEX) | (has("flags_b", INDEX_DELETION) & has("flags_a", LOOK_WIDE))
    meet = meet & (F.col("label_a") != F.col("label_b")) & (F.col("node_b") != F.col("hub"))
    meet = meet & (F.col("of_b.n") <= F.col("of_a.n")) & (F.col("of_b.n") * den >= F.col("of_a.n") * num) & _close("of_a", "of_b", scheme)
    rest = y.join(x, (y["key"] == x["key"]) & meet).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    rest = candidates(rest)
    scratch.drop("open")
    more = _verified(rest, docs, names, k, scheme, scratch, "more")
    found = scratch.write(connected_components(links.union(more)).withColumnRenamed("component", "root"), "components")
    least = found.join(names, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = names.join(found, "node", "left").join(least, "root", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    ids = scratch.write(ids, "ids")
    scratch.drop(*(x for x in scratch.paths if x not in ("sets", "ids")))
    out = named.select("doc_id", "text_key", "node", "n_shingles").join(ids, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the rows whose component has a lesser doc_id; rows that repeat the least doc_id and rows without one stay.

    Rows that share an id are judged by their own texts.
    """
    gone = _components(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = materialize(gone, "gone").alias("g")
    same = (F.col("d.doc_id") == F.col("g.gone_id")) & (F.xxhash64("d.text") == F.col("g.gone_key"))
    return docs.alias("d").join(gone, same, "left_anti").select("d.*")
