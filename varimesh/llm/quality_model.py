"""A quality classifier from preferences (Bradley and Terry, 1952).

Each document has a hidden worth, linear in features of its text; of two documents the better one wins with the logistic probability of the
difference. Pairs of a good and a bad labelled document are the contests, and the weights minimise the logistic loss on feature differences.
The threshold is the quantile of the worths that parts the labelled documents best; the score is a
logistic curve through it, so a fixed cut at ``CUT`` is that threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _type, slices
from .common import documents, fit_logistic, fold, labelled_sample, labels, whole_text

CUT = 0.7
SYMBOLS = b"#*$%&|<>"
_runs = re.compile(rb"[^\w\s]{2,}")
_upper = bytes(range(65, 91))
_digit = b"0123456789"


def features(text: str) -> list[float]:
    """Shape of the text only: shares of symbols, capitals, digits and repeats, lengths. All bounded."""
    raw = text.encode("utf-8")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * 16
    count = lambda chars: size - len(raw.translate(None, chars))
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        min(1.0, math.log1p(n) / 10),
        min(1.0, n / 50),
        min(1.0, 10 * count(SYMBOLS) / letters),
        min(1.0, len(_runs.findall(raw)) / n),
        min(1.0, raw.count(b"|") * 5 / n),
        min(1.0, raw.count(b"!") * 5 / n),
        count(_upper) / letters,
        count(_digit) / letters,
        len(kinds) / n,
        math.sqrt(len(kinds) / n),
        pairs / max(1, n - 1),
        same / max(1, n - 1),
        max(kinds.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, letters / n / 20),
        min(1.0, raw.count(b".") * 5 / n),
    ]


@dataclass
class Ranking:
    weights: list[float]
    threshold: float
    slope: float

    def worth(self, text: str) -> float:
        return float(np.dot(self.weights, features(text)))

    def score(self, text: str) -> float:
        z = self.slope * (self.worth(text) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(sample: DataFrame, pairs: int = 60_000, seed: int = 7) -> Ranking:
    """A ranking from ``(text, label)``, label 1 for good. Without both labels all documents score alike."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "label").mapInArrow(measured, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))  # the order of the tasks decides nothing
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    good, bad = (x[y == v] if len(x) else x for v in (1, 0))
    if not len(good) or not len(bad):
        return Ranking([0.0] * 16, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    # Every document takes part; the winner's side alternates so that no constant can win.
    a = np.concatenate((np.arange(len(good)), rng.integers(0, len(good), pairs)))
    b = np.concatenate((rng.integers(0, len(bad), len(good)), np.arange(pairs) % len(bad)))
    difference, won = good[a] - bad[b], np.ones(len(a))
    difference[::2] *= -1
    won[::2] = 0
    w = fit_logistic(difference, won, ridge=1.0)
    worth = x @ w
    best = max((np.mean(worth[y == 1] >= t) + np.mean(worth[y == 0] < t), -q, t) for q in np.arange(1, 1000) / 1000 for t in [np.quantile(worth, q)])
    below, above = worth[worth < best[2]], worth[worth >= best[2]]
    threshold = (below.max() + above.min()) / 2 if len(below) else best[2]  # halfway in the gap at that quantile
    slope = max(1e-3, float(fit_logistic((worth - threshold)[:, None], y.astype(float), ridge=1e-3)[0]))
    return Ranking(w.tolist(), float(threshold), slope)


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``(doc_id, score)`` for every row.

    A null text is empty. A null id is kept; rows that repeat an id or a text are scored each for itself, equal texts alike; an empty table gives no rows;
    other columns are not read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ranking.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {_type(docs)}, score double")


def query(spark, sf_dir: str, most_labelled: int = 20_000) -> DataFrame:
    """Learns from at most ``most_labelled`` labelled documents outside the held-out fold."""
    docs = documents(spark, sf_dir)
    ranking = learn(labelled_sample(docs, labels(spark, sf_dir), "quality", 4, 2, most_labelled))
    return score(docs, ranking).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
