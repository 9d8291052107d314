"""How the tokens of two tokenizers fall together, text by text and over a corpus.

Both encodings of a text cover the same bytes. Where tokens of both end at the same byte they are cut into groups, and the tokens of a group are linked. A pair of
linked ids is one packed 64-bit number. Pairs are counted by sorted distinct runs within each partition, the runs are sorted by range over the whole corpus and
equal neighbours added up; each range is one shard of sorted counts in the shared store. A task that needs counts maps the shards into memory and finds
its pairs by bisection, so no task holds the table and the texts' pairs are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .byte_bpe import slices
from .common import saved, shared_dir, whole_text

#: Links of a group that are written out one by one; a larger group goes by its different ids and how often each occurs.
WRITTEN_OUT = 4096
#: Pairs that a task collects before it sorts and counts them, and counted pairs that it holds before it passes them on.
COLLECTED, HELD = 1 << 21, 1 << 22
#: Segments whose pieces a worker remembers, and as many from before.
REMEMBERED = 200_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide:
    """Tokenizer A: byte-level BPE of the text after a space; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.vocabulary.apart = None
        by_id = self.vocabulary.bytes_of
        self.letters = [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self.vocabulary.encode(" " + t) for t in texts]


class PieceSide:
    """Tokenizer B: pieces of the text, before which the model itself puts a space.

    No piece goes on after a space inside it, so a text's pieces are those of its segments, each the spaces before a word and the word; different segments are encoded once.
    A vocabulary with such pieces is encoded by whole texts.
    """

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.letters = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_segment = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode(["a  b ", "a", " b", "c"]) == [
            self.model.encode("a") + self.model.encode(" b") + self._space(), *(self.model.encode(s) for s in ("a", " b", "c"))
        ]
        self.split = regex.compile(r" +[^ ]*").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _space(self) -> list[int]:
        return [self.model.piece_to_id("▁")]

    def _pieces(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment; its first space is the one that the model puts there."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        return [np.array(ids if s != " " else self._space(), np.int32).tobytes() for s, ids in zip(segments, found, strict=True)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_segment:
            return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]
        parts = [self.split(" " + t) for t in texts]
        ids = dict.fromkeys(s for p in parts for s in p)
        new = []
        for s in ids:
            got = self.known.get(s) or self.older.get(s)
            if got is None:
                new.append(s)
            else:
                ids[s] = got
        for s, got in zip(new, self._pieces(new), strict=True):
            ids[s] = got
            if len(s) <= 200:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[s] = got
        return [np.frombuffer(b"".join(map(ids.__getitem__, p)), np.int32) for p in parts]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteSide(path_a), PieceSide(path_b)
        self.size = [np.array([len(b) for b in s.letters], np.int64) for s in self.sides]
        a, b = (len(s.letters) for s in self.sides)
        #: What a token adds to the written groups: its id and the mark that follows it.
        self.written = [f"{i}{mark}" for n, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(n)]
        self.at = 0, a, 2 * a, 2 * a + b

    def _same_bytes(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.sides[side].letters.__getitem__, ids.tolist())) == raw

    def __call__(self, texts: list[str]) -> Iterator[tuple]:
        """``(n_a, n_b, n_groups, n_links, groups, keys, links)`` of each text: its different packed pairs in order, and how many links each has."""
        encoded = [s.encode_all(texts) for s in self.sides]
        for text, a, b in zip(texts, *encoded, strict=True):
            raw = b" " + text.encode()
            if text and len(a) and len(b) and self._same_bytes(0, a, raw) and self._same_bytes(1, b, raw):
                yield self._one(a, b)
            else:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one(self, a: np.ndarray, b: np.ndarray) -> tuple:
        end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        first_a, first_b = last_a - n_a, last_b - n_b
        # the groups as text: an A token comes after the B tokens of earlier groups, a B token after the A tokens of its own too
        order = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        order[at_a + first_b[group_a]] = a + np.where(at_a + 1 == last_a[group_a], self.at[1], self.at[0])
        order[at_b + last_a[group_b]] = b + np.where(at_b + 1 == last_b[group_b], self.at[3], self.at[2])
        groups = "".join(map(self.written.__getitem__, order.tolist()))[:-1]
        # links: every A token of a group with every B token of it
        product = n_a * n_b
        times = np.where(product <= WRITTEN_OUT, n_b, 0)[group_a]
        begin = np.cumsum(times) - times
        partner = np.repeat(first_b[group_a] - begin, times) + np.arange(int(times.sum()))
        keys = [(np.repeat(a, times).astype(np.int64) << 32) | b[partner]]
        weights = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(product > WRITTEN_OUT).tolist():
            ids_a, times_a = np.unique(a[first_a[g] : last_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g] : last_b[g]], return_counts=True)
            keys.append(((ids_a.astype(np.int64) << 32)[:, None] | ids_b[None, :]).ravel())
            weights.append((times_a[:, None] * times_b[None, :]).ravel())
        found, links = _summed(np.concatenate(keys), np.concatenate(weights))
        return len(a), len(b), len(cuts), int(product.sum()), groups, found, links


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(n[order], starts)


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups, keys, links)`` for every row.

    ``groups`` writes out the ids, as ``a1,a2|b1;a3|b2,b3``; ``keys`` holds the different linked pairs, an A id times 2^32 and a B id, in order, ``links`` the number of links of each.
    Texts that are null or empty, or that the pieces don't give back byte by byte, have no tokens: zeros and empty values. Other columns are not read, so
    their names can't clash; rows may repeat and ids may be null. A text of any length takes time in proportion to it and to its different linked pairs.
    """
    a, b = default_paths()
    path_a, path_b = path_a or a, path_b or b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in slices(batches):
            rows = list(both(batch.column(1).to_pylist()))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]))) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([r[4] for r in rows], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "links"]
            )

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, keys array<long>, links array<long>"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, kind)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a partition and in how many rows each is, in sorted runs of bounded size."""
    held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

    def merged():
        new, n = np.unique(np.concatenate(waiting), return_counts=True)
        return _summed(np.concatenate((held[0], new)), np.concatenate((held[1], n)))

    def out(pair):
        for at in range(0, len(pair[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in pair], ["key", "n"])

    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        for at in range(0, len(flat), COLLECTED):
            waiting.append(flat[at : at + COLLECTED])
            size += len(waiting[-1])
            if size >= COLLECTED:
                held, waiting, size = merged(), [], 0
                if len(held[0]) >= HELD:
                    yield from out(held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if waiting:
        held = merged()
    yield from out(held)


class Counts:
    """The corpus-wide counts of pairs, as sorted shards in the shared store, and the highest count of each A id."""

    def __init__(self, paths: list[str], first: np.ndarray, best: np.ndarray):
        self.paths, self.first, self.best = paths, first, best

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted different keys, all of which must be in the shards."""
        out, cut = np.zeros(len(keys), np.int64), np.searchsorted(keys, self.first).tolist()
        for path, lo, hi in zip(self.paths, cut, [*cut[1:], len(keys)], strict=True):
            if hi > lo:
                shard, n = _mapped(path)
                at = np.minimum(np.searchsorted(shard, keys[lo:hi]), len(shard) - 1)
                if (shard[at] != keys[lo:hi]).any():
                    raise LookupError(f"pairs that {path} does not hold")
                out[lo:hi] = n[at]
        return out


@lru_cache(4096)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys and counts, mapped into memory. A store that is no mounted file system is copied to the worker's own scratch folder first, as a cache."""
    import tempfile

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if not isinstance(store, fs.LocalFileSystem):
        own = f"{tempfile.mkdtemp()}/shard"
        fs.copy_files(at, own, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        at = own
    both = np.memmap(at, "<i8", "r").reshape(2, -1)
    return both[0], both[1]


def pair_counts(aligned: DataFrame) -> Counts:
    """In how many rows of ``aligned`` each pair is linked. Empty input gives no shards.

    The driver receives the shards' names and, for each A id, its highest count: bounded by the number of partitions and the size of A's vocabulary. A shard is
    written under a new name by every attempt and counts when its task returns that name, so a lost executor leaves at most an unused file. The shared
    store must be one that pyarrow can write.
    """
    folder = shared_dir(aligned.sparkSession)
    spec = "path string, first long, a array<long>, best array<long>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        runs, last, total = [], None, 0
        ids, best = [], []
        for batch in batches:
            keys, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if last is not None:
                keys, n = np.concatenate((last[0], keys)), np.concatenate((last[1], n))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            keys, n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
            last = keys[-1:], n[-1:]  # its run may go on in the next batch
            runs.append((keys[:-1], n[:-1]))
        if last is None or not len(last[0]):
            return
        runs.append(last)
        path, first = f"{folder}/{uuid.uuid4().hex}", int(next(r[0][0] for r in runs if len(r[0])))
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}") as f:
            for k in (0, 1):
                for run in runs:
                    f.write(np.ascontiguousarray(run[k], "<i8").tobytes())
        keys, n = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] >> 32) != (keys[:-1] >> 32))))
        ids, best = keys[starts] >> 32, np.maximum.reduceat(n, starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([first], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([best.tolist()], pa.list_(pa.int64()))], ["path", "first", "a", "best"]
        )

    partial = saved(aligned.select("keys").mapInArrow(_partial, "key long, n long"))
    shards = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, spec).collect()
    shards.sort(key=lambda r: r["first"])
    top = np.zeros(1 + max((max(r["a"]) for r in shards), default=0), np.int64)
    for r in shards:
        np.maximum.at(top, np.array(r["a"]), np.array(r["best"]))
    return Counts([r["path"] for r in shards], np.array([r["first"] for r in shards], np.int64), top)


def scored(aligned: DataFrame, counts: Counts) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best``, the links whose pair is the most frequent of its A id, and ``count_sum``, the counts of all links added up."""
    kept = [c for c in aligned.columns if c not in ("keys", "links")]
    kind = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keys, links = (batch.column(len(kept) + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            found, place = np.unique(keys, return_inverse=True)
            n = counts(found)
            best = n == counts.best[found >> 32]
            sums = [np.concatenate(([0], np.cumsum(links * x[place]))) for x in (best, n)]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(np.diff(s[ends])) for s in sums)], [*kept, "n_best", "count_sum"])

    return aligned.select(*kept, "keys", "links").mapInArrow(run, kind)


def query(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    rows = saved(align(docs, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "keys", "links"))
    return scored(rows, pair_counts(rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
