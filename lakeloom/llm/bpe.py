"""Byte-pair encoding by an automaton compiled from the merges, and decoding from its arc labels.

States are "after token t" (plus the start); arcs are labelled with tokens. The merges are compiled one after the other: the
gadget of a merge (u, v) -> w takes the arc v away from the state after u and adds an arc w wherever an arc u was, leading to a
copy, as of that moment, of the state after v. What is left accepts, for every byte string, exactly one path: its encoding. A
state's arcs are stored as its origin and the moment of the copy, and each arc that was ever asked for is kept in one flat
transition table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import pieces

#: How the public byte-level tokenizer splits a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank next to white space, or at an end: only then can a word reach over the blank before a chunk.
TANGLED = re.compile(r"^ | $| \s|\s ")
#: Entries of each half of a cache in a Python worker.
CACHE = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str) -> dict:
    """The vocabulary file as plain data for compile(): bounded by its number of merges, so it may travel to every task."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, model = byte_letters(), data["model"]
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    spell = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "name": hashlib.sha256(repr(data).encode()).hexdigest(),
        "labels": {i: spell[t] for t, i in model["vocab"].items() if t in spell} | {i: s.encode() for s, i in special.items()},
        "merges": [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges],
        "special": special,
    }


class Kept:
    """What was encoded lately: when the new half is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self):
        self.new: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def __getitem__(self, key: str) -> tuple[str, bytes] | None:
        return self.new.get(key) or self.old.get(key)

    def put(self, key: str, found: tuple[str, bytes]) -> tuple[str, bytes]:
        if len(self.new) >= CACHE:
            self.new, self.old = {}, self.new
        self.new[key] = found
        return found


class Automaton:
    """Compiled merges. encode(text) gives ids; label(ids) gives the bytes they spell."""

    def __init__(self, data: dict):
        self.labels: dict[int, bytes] = data["labels"]
        self.special: dict[str, int] = data["special"]
        n = max(self.labels) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}  # (u, v) -> when the arc v left the state after u
        self.n = n
        for when, (u, v, w) in enumerate(data["merges"]):
            self._gadget(when, u, v, w)
        specials = set(self.special.values())
        self.arc_of = {s: i for i, s in self.labels.items() if i not in specials and (len(s) == 1 or self.born[i] >= 0)}
        self.longest = max(map(len, self.arc_of))
        # (arc or -1, {byte: node}) along the spelling of the arcs
        self.start: dict[int, tuple] = {}
        for s, i in sorted(self.arc_of.items(), key=lambda x: -len(x[0])):  # longer ones first, so a node's branches are there when it gets its arc
            branch = self.start
            for byte in s[:-1]:
                branch = branch.setdefault(byte, (-1, {}))[1]
            branch[s[-1]] = (i, branch[s[-1]][1] if s[-1] in branch else {})
        self.sizes = {i: len(s) for s, i in self.arc_of.items()}
        self.decimal = {i: str(i) for i in self.labels}
        self.table: dict[int, bool] = {}
        self.words, self.chunks, self.heads = Kept(), Kept(), Kept()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _gadget(self, when: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault(u * self.n + v, when)
        if self.born[w] < 0:
            self.born[w], self.left[w], self.right[w] = when, u, v

    def _arc(self, x: int, y: int, now: int) -> bool:
        """Whether the state after x had an arc y at that time: follow the copies back to the younger token's birth."""
        cut, n, born = self.cut, self.n, self.born
        while True:
            when = cut.get(x * n + y)
            if when is not None and when < now:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x, now = self.right[x], bx
            elif by > bx:
                y, now = self.left[y], by + (self.left[y] == self.right[y])  # for w = u u, the state after u has lost its arc u already
            else:  # w after w: there if the state after v had an arc u
                x, y, now = self.right[x], self.left[y], bx

    def step(self, x: int, y: int) -> bool:
        key = x * self.n + y
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            found = self.table[key] = self._arc(x, y, len(self.born) + len(self.cut) + 1)
        return found

    def word(self, s: bytes) -> list[int]:
        """The one path that spells s: longest arcs first, stepping back where a path ends; a place that led nowhere isn't tried again."""
        whole = self.arc_of.get(s)
        if whole is not None:
            return [whole]
        size, known, n, sizes, start, longest = len(s), self.table.get, self.n, self.sizes, self.start, self.longest
        path: list[int] = []
        waiting: list[tuple[int, list[int]]] = []  # for each place on the path: where it is, and the arcs not yet tried there
        dead: set[tuple[int, int]] = set()
        at, last = 0, -1
        while True:
            arcs, branch = [], start  # the arcs that spell s from here on, shortest first, by the table of byte transitions
            for byte in s[at : at + longest]:
                node = branch.get(byte)
                if node is None:
                    break
                arc, branch = node
                if arc >= 0:
                    arcs.append(arc)
            while True:
                while arcs:
                    arc = arcs.pop()
                    if last >= 0:
                        ok = known(last * n + arc)
                        if not (self.step(last, arc) if ok is None else ok):
                            continue
                    if dead and (at + sizes[arc], arc) in dead:
                        continue
                    break
                else:
                    dead.add((at, last))
                    path.pop()
                    at, arcs = waiting.pop()
                    last = path[-1] if path else -1
                    continue
                break
            path.append(arc)
            waiting.append((at, arcs))
            at += sizes[arc]
            last = arc
            if at == size:
                return path

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        get = self.words.new.get
        return [get(w) or self._word(w) for w in WORD.findall(text)]

    def _spelt(self, w: str) -> tuple[str, bytes]:
        ids = self.word(w.encode())
        return ",".join([self.decimal[i] for i in ids]), self.label(ids)

    def _word(self, w: str) -> tuple[str, bytes]:
        if w[0] == " " and w[1:].isalpha():  # the same word as a chunk by itself
            return self.chunks.new.get(w[1:]) or self._keep(self.chunks, w[1:], w)
        return self.words.put(w, self.words[w] or self._spelt(w))

    def _keep(self, cache: Kept, key: str, text: str) -> tuple[str, bytes]:
        found = cache[key]
        if found is None:
            if key.isalpha():  # letters, with a blank before them or without, are one word
                found = self._spelt(text)
            else:
                parts = self.pieces(text)
                found = parts[0] if len(parts) == 1 else (",".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))
        return cache.put(key, found)

    def plain(self, text: str, out: list[tuple[str, bytes]]) -> None:
        """Chunks between single blanks don't reach into each other, so each is encoded once and kept; other texts go as a whole."""
        if not text:
            return
        if TANGLED.search(text):
            out += self.pieces(text)
            return
        head, *rest = text.split(" ")
        if head:
            out.append(self.heads.new.get(head) or self._keep(self.heads, head, head))
        get, keep, chunks = self.chunks.new.get, self._keep, self.chunks
        out += [get(c) or keep(chunks, c, " " + c) for c in rest]

    def encode(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the bytes that the arcs on the path spell."""
        out: list[tuple[str, bytes]] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append((str(self.special[part]), part.encode()))
            else:
                self.plain(part, out)
        return ",".join([x[0] for x in out]), b"".join([x[1] for x in out])

    def label(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.label(ids).decode("utf-8", "replace")


#: The automaton of this Python worker.
MACHINES: dict[str, Automaton] = {}


def encode_documents(docs: DataFrame, data: dict, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: id_col, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    A null text counts as empty: no tokens, hashes of nothing. Repeated rows and repeated or null ids each give a row. Other columns
    of docs are not read. data comes from load() and has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = shared.value["name"]
        if name not in MACHINES:  # a worker that goes from task to task keeps it
            MACHINES.clear()
            MACHINES[name] = Automaton(shared.value)
            gc.freeze()  # its tables live as long as the worker; the collector need not go through them again and again
        machine = MACHINES[name]
        for b in pieces(batches, 1):
            sizes, a, d, all_ids = [], [], [], []
            for text in b.column(1).to_pylist():
                ids, spelt = machine.encode(text)
                sizes.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(spelt).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(",")] if ids else [])
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
