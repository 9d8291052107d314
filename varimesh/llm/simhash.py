"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius.

Every fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so a range join on a grid over the embedding finds a superset
of the links, and an exact bit count settles each candidate.

A count of 0, 1 or 2 is held in unary (00, 01, 11), that is, each segment's bits sorted. The Manhattan
distance of two embeddings is then the bit count of their exclusive or, and one step in it flips one bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import components, in_slots, saved, whole_text
from .linking import merged, near, ordered, unlinked, with_crowds

RADIUS = 4
#: Blocks beyond the radius that the embedding is cut into, tried in this order as cells get crowded.
FINER = (2, 4, 6, 8)
#: Bits within which texts with a shingle in common are compared by their shingles: at a similarity of 0.8 they are 10 apart, give or take 3.
WIDE = 20
#: The smallest shingle hashes of a text by which it meets others.
ANCHORS = 6
#: Points in one cell up to which all pairs are compared.
HEAVY = 512


def shingles(text: str, shingle: int = 4, seed: int = 42, block: int = 65536) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, in arrays of at most ``block``, which bounds the memory of very long texts; nothing without words."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), block):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + block], ends[at : at + block], strict=True)], "<u8")


def simhash(parts: Iterable[np.ndarray]) -> int:
    """The signed 64-bit fingerprint of hashes: a bit is set if over half of them have it."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42, block: int = 65536) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    return simhash(shingles(text, shingle, seed, block))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; null text counts as empty, and the fingerprint of a text without words is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 segment counts in unary, packed in one long."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def blocks(m: int) -> list[int]:
    """Masks that cut the 32 segments of the embedding into ``m`` blocks of about equal size."""
    ends = [2 * (32 * k // m) for k in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]


def _cells(points: DataFrame, radius: int, m: int) -> DataFrame:
    """``(fp, e, g, cell)``: the cell of each point in every grid; a grid looks at all but ``radius`` of ``m`` blocks.

    A step in Manhattan distance changes one block, so two points within ``radius`` agree in all coordinates of at least one grid.
    """
    kept = [_signed(sum(left)) for left in combinations(blocks(m), m - radius)]
    keys = [F.struct(F.lit(g).alias("g"), F.col("e").bitwiseAND(F.lit(mask)).alias("cell")) for g, mask in enumerate(kept)]
    return points.select("fp", "e", F.explode(F.array(*keys)).alias("at")).select("fp", "e", "at.g", "at.cell")


def links(fps: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """Edges ``(a, b)`` of distinct fingerprints that connect all those within ``radius`` of one another.

    Pairs come from the cells of the grids, compared first by Manhattan distance and then exactly. A cell with more than ``heavy``
    points would emit its square in pairs. Both ends of a pair that such a cell hides are in the cell, so the points of all such cells are joined among
    themselves once more, on grids of more and finer blocks: 15, 70, 210 and 495 rows a fingerprint for four bits. With random bits the
    commonest cell holds one point in 2^10, 2^16, 2^18 and 2^20, and the first grid is chosen so that it is not crowded.
    What the finest grids still find crowded is a group of close fingerprints; it is joined on the points halfway, exactly, whatever the crowd.
    """
    points = saved(fps.select("fp").where("fp is not null").distinct().select("fp", embedding(F.col("fp")).alias("e")))
    n, found = points.count(), []
    room = points.sparkSession.sparkContext.defaultParallelism
    for at, more in enumerate(FINER):
        m = radius + more
        fewest = min(sum(mask.bit_count() for mask in kept) for kept in combinations(blocks(m), more))
        if at + 1 < len(FINER) and n > heavy << (fewest // 2):  # the commonest cell, all counts 1, would be crowded
            continue
        cells = _cells(points.repartition(room), radius, m)
        crowded = saved(cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("g", "cell"), few=True)
        some = bool(crowded.take(1))
        near = cells.join(crowded, ["g", "cell"], "left_anti") if some else cells
        other = near.select(F.col("fp").alias("b"), F.col("e").alias("eb"), "g", "cell")
        pairs = near.join(other, ["g", "cell"]).where("fp < b").where(F.bit_count(F.col("e").bitwiseXOR(F.col("eb"))) <= radius)
        found.append(pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius).select(F.col("fp").alias("a"), "b"))
        if not some:
            break
        points = saved(cells.join(crowded, ["g", "cell"], "left_semi").select("fp", "e").distinct())
    else:
        found.append(_halfway(points.select("fp"), radius))
    return reduce(DataFrame.unionByName, found)


def _halfway(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint linked to the smallest one with which it shares a value at two bits or fewer from both, for a radius of four.

    Two fingerprints are within four bits exactly if some value is within two bits of both. That costs 2081 rows a fingerprint.
    """
    if radius != RADIUS:
        raise ValueError("the halfway join is laid out for four bits")
    bits = [1 << i for i in range(64)]
    flips = [0, *bits, *(x | y for i, x in enumerate(bits) for y in bits[i + 1 :])]
    masks = F.array(*[F.lit(_signed(m)) for m in flips])
    around = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "a")
    return around.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``; only ``doc_id`` and ``text`` are read.

    Documents link when their fingerprints differ in four bits or fewer; ``component_id`` is the smallest ``doc_id`` of the
    connected group. Documents without words have fingerprint zero and link like others. Copies share one
    fingerprint and are linked through it, never as pairs. Rows that repeat an id get a row each; a null id is
    never the smallest unless its group has no other; an empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, shingle, seed))
    label = components(links(fps), "a", "b").withColumnRenamed("node", "fp")
    known = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    known = known.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = saved(known, few=True)
    ids = known.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = known.join(ids, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, shingle: int, seed: int = 42, anchors: int = ANCHORS) -> DataFrame:
    """``(doc_id, key, id, fp, keys)`` for every row: ``key`` hashes id and text, ``id`` the text's words, ``keys`` are the smallest hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            ids, fps, keys = [], [], []
            for text in batch.column(2).to_pylist():
                parts = list(shingles(text, shingle, seed))
                least = [np.unique(p)[:anchors] for p in parts]
                keys.append(np.unique(np.concatenate(least)).view("<i8")[:anchors].tolist() if least else [])
                fps.append(simhash(parts))
                ids.append(xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8").lower().split())))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(ids, "<u8").view("<i8")), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "id", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, id long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """``(id, set)``: the different shingle hashes of the texts in ``wanted`` (``key``, ``id``), each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(np.concatenate([*shingles(t, shingle, seed), np.zeros(0, "<u8")])).view("<i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    rows = in_slots(docs.select(F.xxhash64(F.col("doc_id").cast("long"), whole_text()).alias("key"), whole_text().alias("text")), "key", wanted, "left_semi")
    rows = rows.join(wanted, "key").dropDuplicates(["id"]).select("id", "text")
    return rows.mapInArrow(run, "id long, set array<long>")


def near_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """``(doc_id, component_id)`` for every row: texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are linked.

    A similarity of 0.8 is ten bits of a fingerprint on average, out of reach of a grid. So pairs come from two sides: the grid gives those within
    ``RADIUS`` bits, and texts that share one of their ``ANCHORS`` smallest shingle hashes are candidates if their fingerprints are
    within ``radius`` bits. The shingle sets then settle every pair. Texts with the same words are one.
    A row without words links to others like it; a null id is never the smallest unless its group has no other; an empty table gives no rows.
    """
    made = saved(sketches(docs, shingle))
    texts = saved(made.groupBy("id").agg(F.min("key").alias("key"), F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    prints = texts.select("id", "fp")
    rep = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    close = links(prints)
    close = close.join(rep.select(F.col("fp").alias("a"), F.col("rep").alias("id")), "a").join(rep.select(F.col("fp").alias("b"), F.col("rep").alias("id2")), "b")
    alike = prints.join(rep, "fp").select("id", F.col("rep").alias("id2"))
    pairs, crowds = with_crowds(texts.select("id", "fp", "keys"), prints, radius)
    pairs = saved(ordered(pairs.unionByName(close.select("id", "id2")).unionByName(alike)), few=True)

    def sets_of(some: DataFrame) -> DataFrame:
        ids = some.select("id").union(some.select("id2")).distinct()
        return saved(shingle_sets(docs, texts.join(ids, "id", "left_semi").select("key", "id"), shingle))

    sets = sets_of(pairs)

    def settled(some: DataFrame, sets: DataFrame = sets) -> DataFrame:
        both = some.join(sets, "id").join(sets.select(F.col("id").alias("id2"), F.col("set").alias("set2")), "id2")
        shared = F.size(F.array_intersect("set", "set2"))
        return saved(both.where(shared >= F.lit(similarity) * (F.size("set") + F.size("set2") - shared)).select("id", "id2"), few=True)

    # Each text is first set against one other; of the rest only pairs that this does not connect already.
    one = pairs.groupBy("id2").agg(F.min("id").alias("id"))
    sure = settled(one.select("id", "id2"))
    known = saved(components(sure, "id", "id2"), few=True)
    at = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    rest = pairs.join(one, ["id", "id2"], "left_anti").join(at("id"), "id", "left").join(at("id2"), "id2", "left")
    rest = rest.where(~F.col("id_group").eqNullSafe(F.col("id2_group")) | F.col("id_group").isNull()).select("id", "id2")
    label = components(sure.unionByName(settled(saved(rest, few=True))), "id", "id2").select(F.col("node").alias("id"), F.col("component").alias("group"))
    if crowds.take(1):  # what crowded shingles keep apart so far
        label = saved(label, few=True)
        more = saved(ordered(unlinked(crowds, prints, label, near(radius))).join(pairs, ["id", "id2"], "left_anti"), few=True)
        if more.take(1):
            label = merged(label, settled(more, sets_of(more)))
    named = saved(texts.select("id", "first").join(label, "id", "left").withColumn("component", F.coalesce("group", "id")), few=True)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return made.select("doc_id", "id").join(named.join(least, "component").select("id", "component_id"), "id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns as they are, with one document of each group of near copies: that with the smallest id.

    Rows equal in id and text are one document. Rows without an id have no name to be dropped by and stay.
    """
    found = saved(near_texts(docs, shingle, similarity))
    again = saved(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), few=True)
    gone = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), few=True)
    maybe = in_slots(docs, "doc_id", gone, "left_semi", "gone").join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    kept = maybe.unionByName(in_slots(docs, "doc_id", gone, "left_anti", "gone"))
    if not again.take(1):
        return kept
    once = in_slots(kept, "doc_id", again, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(in_slots(kept, "doc_id", again, "left_anti"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
