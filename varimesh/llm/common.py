"""Helpers that the corpus operators share: input columns, folds, shared storage and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varimesh.operators.graph import components
from varimesh.operators.storage import drop_saved, saved, shared_dir

__all__ = ["components", "documents", "drop_saved", "fit_logistic", "fold", "in_slots", "labelled_sample", "labels", "saved", "shared_dir", "whole_text"]

#: White space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows of a slot filter, which every task gets, at most; each has ``1 << SLOT_BITS`` places.
SLOTS, SLOT_BITS = 1 << 20, 6


def _slot(column: Column) -> tuple[Column, Column]:
    """A number's slot, and the bit of its place there."""
    number = column.cast("long")
    place = F.pmod(F.shiftright(number, SLOTS.bit_length() - 1), F.lit(1 << SLOT_BITS)).cast("int")
    return F.pmod(number, F.lit(SLOTS)), F.call_function("shiftleft", F.lit(1).cast("long"), place)


def in_slots(df: DataFrame, column: str, keys: DataFrame, how: str, key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` may (``left_semi``) or cannot (``left_anti``) be among ``keys``, by a broadcast of at most ``SLOTS`` rows.

    It thins out what an exact join then has to move; a null never is among the keys. Of rows that are not among ``k`` keys, some ``k`` in ``SLOTS << SLOT_BITS`` pass.
    """
    slot, bit = _slot(F.col(key or column))
    places = keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    slot, bit = _slot(F.col(column))
    return df.join(F.broadcast(places), (slot == F.col("_slot")) & (bit.bitwiseAND(F.col("_bits")) != 0), how)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, most: int) -> DataFrame:
    """``(text, label)`` of labelled rows outside the held-out fold: all of them, or those ``most`` with the smallest hashed ids.

    The bound makes the sample small enough to send to every task. A row without a label, or labelled twice, counts once or not at all.
    """
    chosen = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held))
    chosen = chosen.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return saved(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label"))


def fit_logistic(x, y, ridge: float = 1e-2, rounds: int = 60, weights=1.0):
    """Weights of a logistic regression by damped Newton steps; ``x`` has its own constant column if one is wanted. A row counts ``weights`` times."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weights * (p - y)) + ridge * w)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w
