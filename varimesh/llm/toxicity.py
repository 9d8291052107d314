"""Toxicity from a weighted lexicon.

Texts are folded first: lower case, look-alike letters to Latin, digits between letters to the letters they stand for. An Aho-Corasick
automaton then finds all lexicon entries in one pass; an entry is a word or the start of one. Hits inside an exception phrase do not
count. The weights of a document's hits, set against its length, give the score through a logistic fit.
The lexicon is learned from labelled documents: the words and word starts whose documents are labelled toxic far more often than others.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _type, slices
from .common import documents, fit_logistic, fold, labelled_sample, labels, whole_text

#: Cyrillic and Greek letters, and the Latin ones they look like (fixed values).
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏκοραενιτ", "aeopcyxijsdhlkopaevit", strict=True))
FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: Digits and signs, and the letters they stand for inside words (fixed values).
DIGITS = dict(zip("0134578@$", "oieastbas", strict=True))
#: Harmless phrases that hold a word of insult, folded.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "losers bracket", "pond scum")
LONGEST = 7

_letters = str.maketrans(LOOK_ALIKES | FULL_WIDTH)
_digits = str.maketrans(DIGITS)
#: A word up to its first digit or sign, and on; possessive, so a run of letters is read once whatever its length.
_mixed = re.compile(r"(?<![^\W_])[^\W\d_]*+[0-9@$][\w@$]*+")
_word = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    """Lower case with look-alikes resolved; digits become letters only in words that also hold letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_letters)
    if re.search(r"[0-9@$]", text):
        text = _mixed.sub(lambda m: m[0].translate(_digits) if sum(map(str.isalpha, m[0])) * 3 >= len(m[0]) else m[0], text)
    return text


def patterns(text: str) -> set[str]:
    """What may become an entry: the starts of three to seven letters of each word, and each word followed by a space."""
    out = set()
    for w in set(_word.findall(folded(text))):
        if len(w) > 2:
            out.update(w[:k] for k in range(3, min(len(w), LONGEST + 1)))
            out.add(w + " ")
    return out


def lower_bound(k: float, n: float, z: float = 2.0) -> float:
    """Wilson's lower bound of a share."""
    p = k / n
    return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def choose(counts: list[tuple[str, int, int]], base: float, least: float = 0.3) -> dict[str, float]:
    """Entries and weights from ``(pattern, toxic documents, documents)``; a longer entry only where it says more than its start."""
    known = {p: (k, n) for p, k, n in counts}
    sure = {p: lower_bound(k, n) for p, (k, n) in known.items()}
    chosen: dict[str, float] = {}
    for p in sorted((p for p in known if sure[p] > least), key=lambda p: (len(p), p)):
        if all(sure[p] > sure[s] + 0.15 for s in (p[:i] for i in range(3, len(p))) if s in chosen):
            chosen[p] = 0.0
    out = {}
    names = sorted(known)
    for p in chosen:  # the longest form with nearly the same documents stands for its start
        forms = takewhile(lambda q: q.startswith(p), islice(names, bisect_left(names, p), None))  # noqa: B023
        long = max((q for q in forms if known[q][1] >= 0.95 * known[p][1]), key=lambda q: (len(q), q))
        k, n = known[long]
        out[long] = math.log((k + 0.5) / (n - k + 0.5)) - math.log(base / (1 - base))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    model: list[float] = field(default_factory=list)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("weights", "model", "exceptions")}

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p.strip(), (len(p.strip()), p.endswith(" "), w))
        for p in self.exceptions:
            found.add_word(p, (len(p), True, None))
        found.make_automaton()
        return found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of each word that an entry matches, with its largest weight, outside exceptions; places in the folded text."""
        words: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, whole, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            start = end - size + 1
            if (start and text[start - 1].isalpha()) or (whole and end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            if weight is None:
                spared.append((start, end))
            elif weight > words.get(start, (0, 0.0))[1]:
                words[start] = (end + 1, weight)
        out, spared, at, reach = [], sorted(spared), 0, -1
        for s, (e, w) in sorted(words.items()):
            while at < len(spared) and spared[at][0] <= s:
                reach, at = max(reach, spared[at][1]), at + 1
            if s > reach:
                out.append((s, e, w))
        return out

    def features(self, text: str) -> list[float]:
        text = folded(text)
        hits = self.hits(text)
        total, words = sum(w for _, _, w in hits), len(text.split()) + 5
        kinds = len({text[s:e] for s, e, _ in hits})
        return [1.0, math.log1p(total), math.log1p(100 * total / words), max((w for *_, w in hits), default=0.0), math.log1p(kinds), math.log(words)]

    def score(self, text: str) -> float:
        z = float(np.dot(self.model, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(sample: DataFrame, least_documents: int = 6) -> Lexicon:
    """A lexicon from ``(text, label)``, label 1 for toxic. Without both labels it has no entries and scores all alike.

    The sample is bounded, so what may become an entry is too: words and word starts in several of its toxic documents.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(p, y) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in patterns(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], ["p", "label"])

    n, k = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = (k + 0.5) / (n + 1)
    counted = sample.select("text", "label").mapInArrow(listed, "p string, label int").groupBy("p").agg(F.sum("label").alias("k"), F.count("label").alias("n"))
    counted = counted.where((F.col("n") >= least_documents) & (F.col("k") >= least_documents / 2) & (F.col("k") / F.col("n") > 2 * base))
    rows = counted.collect()
    lexicon = Lexicon(choose([tuple(r) for r in rows], base) if 0 < k < n else {})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    if not 0 < k < n:
        lexicon.model = [math.log(base / (1 - base)), 0, 0, 0, 0, 0]
        return lexicon
    rows = sample.select("text", "label").mapInArrow(measured, "x array<double>, y int").collect()
    lexicon.model = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)).tolist()
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, score)`` for every row.

    A null text is empty, and an empty one has the score of a text without hits. A null id is kept; rows that repeat an id or a text are scored each for
    itself, so equal texts have equal scores. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    The time is in proportion to the length of a text, whatever it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {_type(docs)}, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``cut``; rows count each for itself, and a null text is scored as empty and stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([lexicon.score(t or "") < cut for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, marks: DataFrame, most_labelled: int = 20_000) -> Lexicon:
    """From at most ``most_labelled`` labelled documents outside the held-out fold."""
    return learn(labelled_sample(docs, marks, "toxic", 5, 0, most_labelled))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, learned(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
