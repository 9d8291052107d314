"""Byte-level BPE in two tiers, and its inverse.

A text is split into pre-tokens. The first tier is a minimal perfect hash of the vocabulary: one table place for each entry, so a pre-token that is an entry
itself gets its id by one probe and one comparison of bytes. What is no entry goes to the second tier, which merges linked bytes, always the
pair of lowest rank and of equal ranks the leftmost, from a heap; a word of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Bytes of text that are encoded at a time; a longer text is taken alone.
SLICE = 4 << 20
#: Bits of an id in a packed pair.
WIDE = 32
#: Merged words that a worker remembers, and as many from before; those not met again are forgotten.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of different 64-bit numbers: each of n keys has a place of its own in 0 .. n-1.

    Level by level, keys that are alone in their slot of a bitmap stay there and the others go on to the next, smaller bitmap; a key's place
    is the number of set bits before its own (Limasset et al., 2017).
    """

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must differ")
        self.levels: list[np.ndarray] = []
        placed, left = 0, keys
        while len(left):
            slots = _mixed(left, len(self.levels)) % np.uint64(2 * len(left))
            load = np.bincount(slots.astype(np.int64), minlength=2 * len(left))
            alone = load == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1 + placed, -1).astype(np.int32))
            placed += int(alone.sum())
            left = left[load[slots.astype(np.int64)] > 1]
        self.size = placed

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; for numbers that are no keys, any place or -1."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, table in enumerate(self.levels):
            found = table[(_mixed(keys[left], level) % np.uint64(len(table))).astype(np.int64)]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        return out


class Ranks:
    """A vocabulary file of byte strings and their ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import xxhash

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.digest = xxhash.xxh3_64_intdigest
        entries = list(self.rank)
        keys = np.fromiter(map(self.digest, entries), np.uint64, len(entries))
        self.place = PerfectHash(keys)
        at = self.place(keys)
        self.entry: list[bytes] = [b""] * self.place.size
        self.id_at = np.empty(self.place.size, np.int32)
        for i, b in zip(at.tolist(), entries, strict=True):
            self.entry[i], self.id_at[i] = b, self.rank[b]
        by_id = {i: b for b, i in self.rank.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.size = np.array([len(b) for b in parts], np.int64)
        self.first, self.letters = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(parts), np.uint8)
        self.single = [self.rank[bytes([b])] for b in range(256)]
        #: Two adjacent tokens, packed into one number, and the entry that their bytes make; its id is its rank.
        self.pair = {
            self.rank[b[:k]] << WIDE | self.rank[b[k:]]: i for b, i in self.rank.items() for k in range(1, len(b)) if b[:k] in self.rank and b[k:] in self.rank
        }
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The second tier: parts are linked to their neighbours; an entry of the heap, a rank and a place, counts while the pair at its place still has that rank."""
        pair, n = self.pair.get, len(word)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        token = [self.single[b] for b in word]
        now = [pair(a << WIDE | b, -1) for a, b in zip(token, token[1:], strict=False)]
        now.append(-1)
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            x = heappop(heap)
            i, made = x & mask, x >> shift
            if now[i] != made:
                continue
            j = nxt[i]
            end = nxt[j]
            token[i], token[j], now[i], now[j], nxt[i], prv[end] = made, -1, -1, -1, end, i
            if end < n:
                now[i] = r = pair(made << WIDE | token[end], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            h = prv[i]
            if h >= 0:
                now[h] = r = pair(token[h] << WIDE | made, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [t for t in token if t >= 0]

    def _merged(self, word: bytes) -> bytes:
        ids = self.merged.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = array("i", self.merge(word)).tobytes()
            if len(word) <= 200:
                if len(self.merged) >= REMEMBERED:
                    self.older, self.merged = self.merged, {}
                self.merged[word] = ids
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end, and where each text's begin; text k lies between places k and k + 1."""
        words, counts = [], [0]
        for text in texts:
            words += self.split(text)
            counts.append(len(words))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        index = dict.fromkeys(words)
        index = dict(zip(index, range(len(index)), strict=True))
        codes = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        raw = [w.encode() for w in index]
        place = self.place(np.fromiter(map(self.digest, raw), np.uint64, len(raw)))
        entry = self.entry
        hit = np.fromiter((p >= 0 and entry[p] == w for p, w in zip(place.tolist(), raw, strict=True)), bool, len(raw))
        misses = np.flatnonzero(~hit)
        more = [self._merged(raw[i]) for i in misses.tolist()]
        size = np.ones(len(raw), np.int64)
        size[misses] = [len(m) // 4 for m in more]
        first = np.cumsum(size) - size
        pool = np.empty(int(size.sum()), np.int32)
        pool[first[hit]] = self.id_at[place[hit]]
        if more:
            pool[np.repeat(~hit, size)] = np.frombuffer(b"".join(more), np.int32)
        before = np.concatenate(([0], np.cumsum(size[codes])))
        ids = pool[np.repeat(first[codes] - before[:-1], size[codes]) + np.arange(before[-1])]
        return ids, before[counts]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of sequences of ids laid end to end, and where each sequence's begin. Unknown ids have no bytes."""
        known = (ids >= 0) & (ids < len(self.size))
        ids = np.where(known, ids, 0)
        own = np.where(known, self.size[ids], 0)
        before = np.concatenate(([0], np.cumsum(own)))
        return self.letters[np.repeat(self.first[ids] - before[:-1], own) + np.arange(before[-1])], before[ends]


@cache
def ranks(path: str) -> Ranks:
    """One for each worker process and file."""
    return Ranks(path)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes in one column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if batch.num_rows > at:
            yield batch.slice(at)


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in ``flat``."""
    width = flat.itemsize
    if ends[-1] * width >= 1 << 31:
        raise ValueError("a text's ids are over 2 GB, more than a row can hold")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row, ids as little-endian 32-bit numbers in one binary value.

    A null or empty text has no ids. Other columns are not read, so their names can't clash; rows may repeat and ids may be null: each row counts for itself.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks(path)
        for batch in slices(batches):
            ids, ends = v.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), _binary(ids.astype("<u4"), ends)], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {_type(docs)}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: the bytes of each row's ids; null ids give no bytes. They need not be whole UTF-8 if the ids were cut."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks(path)
        for batch in slices(batches, 2):
            parts = [b or b"" for b in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in parts)])
            raw, cuts = v.decode_all(np.frombuffer(b"".join(parts), "<u4").astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(raw, cuts)], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {_type(encoded)}, n_tokens long, ids binary, decoded binary")


def id_array(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``ids`` as an array of numbers."""
    names = encoded.columns
    spot = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([None if b is None else np.frombuffer(b, "<u4").astype(np.int32) for b in batch.column(spot).to_pylist()], pa.list_(pa.int32()))
            yield batch.set_column(spot, "ids", lists)

    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, kinds)


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return decode(encode(docs, path), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
