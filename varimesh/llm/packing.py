"""Best-fit-decreasing packing of token pieces into sequences of fixed length.

Best-fit decreasing looks at nothing but lengths, and pieces of one length are interchangeable. So the whole corpus is packed from its histogram,
which has one row for each length up to the sequence length however large the input is: taking
lengths in decreasing order, a segment tree over remaining capacities finds the tightest bins that are open, and a run of equal pieces goes into
a run of equal bins in one step. The result is a list of runs, the exact best-fit-decreasing packing of all pieces. Each piece then finds its place
from its rank among the pieces of its length; ranks come from counts in hashed buckets, so that no length, however
common, is sorted in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PATTERN, _type, default_path, slices, vocabulary
from .common import saved, whole_text

SEQUENCE = 1024
END = 2


def _tokenizer(path: str):
    """The library's fast encoder over the same vocabulary and special tokens; its ids equal those of the file's own library."""
    v = vocabulary(path)
    if not hasattr(v, "fast"):
        import tiktoken

        v.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=dict(v.id_of), special_tokens=v.special)
    return v.fast


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and the end id, cut only where longer than a sequence.

    All pieces of a cut document but the first fill a sequence. A null or empty text is the end id alone.
    """
    path = path or default_path()
    kind = f"doc_id {_type(docs)}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_to_numpy
        for batch in slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = np.append(encode(text, allowed_special="all").astype("<u4"), np.uint32(end))
                cuts = [0, *range(len(got) % sequence or min(sequence, len(got)), len(got) + 1, sequence)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = got[a:b]
                    for column, value in zip((row, piece, start, length, crc), (i, k, a, b - a, zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, kind)


class OpenBins:
    """A segment tree over remaining capacities: which capacities have open bins, and the smallest such of at least some length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins, offset)

    def _mark(self, capacity: int) -> None:
        i = capacity + self.size
        self.any[i] = bool(self.runs[capacity])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, capacity: int, run: tuple[int, int, int]) -> None:
        if capacity > 0 and run[1] > 0:
            self.runs[capacity].append(run)
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` with an open bin, in logarithmic time."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: runs ``(length, first_rank, pieces, per_bin, first_bin, offset)``.

    Pieces of one length fill the tightest bins; a bin that takes one and still has room for another is then
    the tightest itself, so it takes as many as fit before the next bin is touched.
    """
    bins, out, made = OpenBins(sequence), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= sequence:
            raise ValueError(f"a piece of {length} tokens")
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                per = sequence // length
                first, count, offset, room = made, -(-left // per), 0, sequence
                made += count
            else:
                first, count, offset = bins.take(room)
                per = room // length
            full = min(count, left // per)
            if full:
                out.append((length, rank, full * per, per, first, offset))
                bins.put(room - per * length, (first, full, offset + per * length))
                rank, left = rank + full * per, left - full * per
            if full < count:
                first, count = first + full, count - full
                if left:  # fewer pieces than one bin would take
                    out.append((length, rank, left, left, first, offset))
                    bins.put(room - left * length, (first, 1, offset + left * length))
                    first, count, left = first + 1, count - 1, 0
                bins.put(room, (first, count, offset))
    return out


def pack(cut: DataFrame, sequence: int = SEQUENCE, rows_per_bucket: int = 200_000) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``: every piece's place, gapless from 0 in each sequence.

    ``cut`` needs ``doc_id, piece, length`` and must read the same twice (a saved table). Equal rows are placed each for itself. The plan has
    a bounded number of rows: at most ``sequence`` lengths, each met by at most as many runs as there are open capacities.
    """
    spark: SparkSession = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, sequence)
    buckets = max(1, -(-sum(counts.values()) // rows_per_bucket)) * 8
    # The bucket comes from the row alone, so a task that runs anew deals its rows alike.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = sizes.select("length", "bucket", before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    by_length: dict[int, list] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    tables = {n: np.array(r, np.int64) for n, r in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            bin_of, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, _, per, first_bin, at = tables[n][np.searchsorted(tables[n][:, 0], rank[own], "right") - 1].T
                nth = rank[own] - first
                bin_of[own], offset[own] = first_bin + nth // per, at + nth % per * n
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_of), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = cut.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    if not counts:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).limit(0)
    return ranked.select(*names, "rank").mapInArrow(place, kind)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(saved(pieces(docs, path)))
