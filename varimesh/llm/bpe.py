"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

A text's encoding ends in exactly one token, and dropping that token leaves the encoding of the shorter prefix. So for every prefix one
last token is stored: among the vocabulary entries that end there, the only one that the last token of the remaining prefix can
precede. An automaton over the vocabulary lists the entries that end at each byte; a pair of tokens can be adjacent when BPE, run on
both byte strings together, merges nothing across the border. Back-pointers from the end give the ids. The
work is linear in the text for any input, a word of a million letters included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: The split that this family of vocabularies is defined with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers, and as many from before; those not met again are forgotten.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {plain(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            x, y = (self.id_of[plain(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.rank[x, y] = (r, made)
            self.parts.setdefault(made, (r, x, y))
        self.ends = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            if len(b) == 1 or i in self.parts:  # an entry that no merge makes is never emitted
                self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.spelled = None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that were outermost on one side while ``token`` was built, last first, each with the rank of the merge that ended it."""
        known = self.left if side else self.right
        if token not in known:
            line, ended = [(token, float("inf"))], token
            while ended in self.parts:
                r, x, y = self.parts[ended]
                ended = x if side else y
                line.append((ended, r))
            known[token] = line
        return known[token]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of ``a`` and then ``b`` ends in these two tokens."""
        key = (a, b)
        if key not in self.fits:
            self.fits[key] = self._adjacent(a, b)
        return self.fits[key]

    def _adjacent(self, a: int, b: int) -> bool:
        xs, ys = self._edge(a, 0), self._edge(b, 1)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = self.rank.get((x, y), (None,))[0]
            # x and y stand side by side until one is merged away. Of equal merges the leftmost is first:
            # that ends x before it could meet y, but joins x and y before y meets what follows.
            if r is not None and r < x_ends and r <= y_ends:
                return False
            born_x = xs[i + 1][1] if i + 1 < len(xs) else -1
            born_y = ys[j + 1][1] if j + 1 < len(ys) else -1
            if born_x < 0 and born_y < 0:
                return True
            # step back over the merge that came last; of equal merges the left one came first
            if born_x > born_y:
                i += 1
            else:
                j += 1

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.id_of.get(word)
        if whole is not None and len(word) == 1:
            return [whole]
        last: list[tuple[int, int]] = [(0, -1)] * (len(word) + 1)
        fits, adjacent = self.fits, self._adjacent
        for at, (size, token) in self.ends.iter(word.decode("latin-1")):
            end = at + 1
            if last[end][0]:
                continue
            before = last[end - size][1] if end > size else -2
            if before == -1:
                continue
            if before != -2:
                ok = fits.get((before, token))
                if ok is None:
                    ok = fits[before, token] = adjacent(before, token)
                if not ok:
                    continue
            last[end] = (size, token)
        ids, end = [], len(word)
        while end:
            size, token = last[end]
            ids.append(token)
            end -= size
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; a special token's string in it is that token, as the public library has it."""
        known, out = self.words, []
        for k, part in enumerate(self.apart(text) if self.apart else [text]):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            for word in self.split(part):
                ids = known.get(word)
                if ids is None:
                    ids = self.older.get(word)
                    if ids is None:
                        if len(self.fits) >= 4 * REMEMBERED:
                            self.fits.clear()
                        ids = np.array(self.encode_word(word.encode("utf-8")), np.int32).tobytes()
                    if len(word) <= 200:
                        if len(known) >= REMEMBERED:
                            self.older, self.words = known, {}
                            known = self.words
                        known[word] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of many sequences of ids laid end to end; sequence k lies between ``ends[k]`` and ``ends[k + 1]``. Unknown ids have no bytes."""
        if self.spelled is None:
            parts = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
            size = np.array([len(b) for b in parts], np.int64)
            self.spelled = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size
        letters, first, size = self.spelled
        known = (ids >= 0) & (ids < len(size))
        ids = np.where(known, ids, 0)
        own = np.where(known, size[ids], 0)
        before = np.concatenate(([0], np.cumsum(own)))
        raw = letters[np.repeat(first[ids] - before[:-1], own) + np.arange(before[-1])].tobytes()
        cuts = before[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file."""
    return Vocabulary(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that ids of long texts never pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row; a null or empty text has no ids. Other columns are not read; ids of rows may repeat."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches):
            ids = [v.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the text of each row's ids; null ids give the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches):
            ids = batch.column(1)  # a sliced list's offsets begin anywhere; a null one is empty
            ends = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            texts = v.decode_all(ids.flatten().fill_null(-1).to_numpy().astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_type(encoded)}, ids array<int>, decoded string")


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
