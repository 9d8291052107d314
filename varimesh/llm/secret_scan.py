"""Secret scanning: fixed patterns, and a small character convolutional network for what they miss.

Three patterns give the base findings, which always stand. Every other run of twelve key-like characters or more with a digit, or with a capital
after a small letter, is a candidate, but for numbers and addresses without a letter;
the network reads it in windows together with the characters around it and adds those it takes for secrets. It is trained in numpy
on labelled findings: all base findings of the corpus and generated keys of common shapes as secrets, all other candidates of the corpus as harmless, in shards
whose weights are averaged after each epoch. Its scores are calibrated on findings kept aside, and the threshold is the highest one that still finds a stated share of those.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _type, slices
from .common import documents, drop_saved, fit_logistic, saved, whole_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: What tells a key from a long word: a digit, or a capital after a small letter.
_keylike = re.compile(r"[0-9]|[a-z][A-Z]")
_numeric = re.compile(r"[^A-Za-z]+")
#: Known shapes of keys (fixed values): never taken for harmless in training.
SHAPES = re.compile(r"ghp_|gho_|github_pat_|sk_live_|sk_test_|xox[abprs]-|eyJ|AIza|glpat-|npm_|SG\.")
KINDS = ("assign", "access", "hex", "model")
MASK = "[SECRET]"

SIDE, CORE, STRIDE = 16, 40, 24
WIDTH = 2 * SIDE + CORE

_hex_map = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_key_map = bytes(49 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_.=-") else 48 for c in range(256))
_long, _some = b"1" * 16, b"1" * 12


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern findings by start, in code points. Each pattern is left out where a quicker exact test shows that it can't match."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if _long in text.encode("utf-8").translate(_hex_map):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other runs of 12 key-like characters or more, with a letter, and a digit or a capital after a small letter, outside base findings (sorted by start)."""
    if _some not in text.encode("utf-8").translate(_key_map):
        return []
    out, at, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:  # findings that begin before the candidate's end; it is free if none of them ends past its start
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= s and _keylike.search(text, s, e) and not _numeric.fullmatch(text, s, e):
            out.append((s, e))
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows over a whole candidate, each with the characters on its sides; a short candidate has one."""
    out = []
    for at in range(start, max(start + 1, end - CORE + STRIDE), STRIDE):
        left, core, right = text[max(0, at - SIDE) : at], text[at : min(end, at + CORE)], text[min(end, at + CORE) : min(end, at + CORE) + SIDE]
        out.append(left.rjust(SIDE, "\0") + core.ljust(CORE, "\0") + right.ljust(SIDE, "\0"))
    return out


def codes(rows: list[str]) -> np.ndarray:
    """ASCII codes; any other character is 127."""
    flat = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").reshape(-1, WIDTH)
    return np.where(flat < 127, flat, 127).astype(np.int64)


@dataclass
class Network:
    """Embedding, two convolutions with rectifiers, largest value over places, logistic output; ``platt`` and ``threshold`` from calibration."""

    weights: dict[str, np.ndarray]
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0

    @staticmethod
    def fresh(seed: int = 11, embed: int = 8, filters: int = 24, span: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, math.sqrt(2 / np.prod(shape[:-1])), shape).astype(np.float32)
        return Network({
            "e": rng.normal(0, 0.5, (128, embed)).astype(np.float32), "c1": make(span * embed, filters), "b1": np.zeros(filters, np.float32),
            "c2": make(span * filters, filters), "b2": np.zeros(filters, np.float32), "o": make(filters, 1)[:, 0], "ob": np.zeros(1, np.float32),
        })

    def _forward(self, x: np.ndarray):
        w = self.weights
        view = lambda a, n: np.lib.stride_tricks.sliding_window_view(a, n, axis=1).transpose(0, 1, 3, 2).reshape(a.shape[0], a.shape[1] - n + 1, -1)
        span = w["c1"].shape[0] // w["e"].shape[1]
        e = w["e"][x]
        v1 = view(e, span)
        h1 = np.maximum(v1 @ w["c1"] + w["b1"], 0)
        v2 = view(h1, span)
        h2 = np.maximum(v2 @ w["c2"] + w["b2"], 0)
        top = h2.argmax(axis=1)
        pooled = np.take_along_axis(h2, top[:, None, :], axis=1)[:, 0]
        return v1, h1, v2, pooled, top, pooled @ w["o"] + w["ob"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores in steps of 1/256 from -32 to 32: so few that a table of how often each occurs is small, however large the corpus."""
        z = np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)
        return np.rint(np.clip(z, -32, 32) * 256) / 256

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        v1, h1, v2, pooled, top, z = self._forward(x)
        d = ((1 / (1 + np.exp(-z))) - y)[:, None].astype(np.float32) / len(y)
        g = {"o": (pooled * d).sum(0), "ob": d.sum(0)}
        d2 = np.zeros((len(x), v2.shape[1], pooled.shape[1]), np.float32)
        np.put_along_axis(d2, top[:, None, :], (d * w["o"] * (pooled > 0))[:, None, :], axis=1)
        g["c2"], g["b2"] = np.tensordot(v2, d2, ((0, 1), (0, 1))), d2.sum((0, 1))
        d1 = self._fold(d2 @ w["c2"].T, h1.shape) * (h1 > 0)
        g["c1"], g["b1"] = np.tensordot(v1, d1, ((0, 1), (0, 1))), d1.sum((0, 1))
        de = self._fold(d1 @ w["c1"].T, (*x.shape, w["e"].shape[1]))
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"], x.ravel(), de.reshape(-1, de.shape[-1]))
        return g

    @staticmethod
    def _fold(d: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of what overlapping windows pass back to each place."""
        out = np.zeros(shape, np.float32)
        parts = d.reshape(d.shape[0], d.shape[1], -1, shape[2])
        for k in range(parts.shape[2]):
            out[:, k : k + d.shape[1]] += parts[:, :, k]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own, step = order[at : at + batch], step + 1
                for k, g in self.gradients(x[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * z + self.platt[1], -30, 30)))

    def probabilities(self, rows: list[str]) -> np.ndarray:
        return self.probability(self.logits(codes(rows)).astype(float))


def generated(n: int, seed: int = 3) -> list[str]:
    """Windows around made-up keys of common shapes, in made-up surroundings."""
    rng = np.random.default_rng(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    shapes = (
        lambda: "ghp_" + draw(letters, 36), lambda: "sk_live_" + draw(letters, 24), lambda: "xoxb-" + draw(letters[52:], 12) + "-" + draw(letters, 24),
        lambda: draw(letters + "+/", int(rng.integers(24, 64))) + "=", lambda: draw(letters[52:] + "ABCDEF", 32), lambda: "eyJ" + draw(letters, 30) + "." + draw(letters + "-_", 40),
        lambda: draw(letters, int(rng.integers(20, 44))),
    )
    before = ("", "key ", "use ", "Bearer ", 'auth="', "export KEY=", "pass: ", "the ", "(", "with\n")
    out = []
    while len(out) < n:
        key, lead = shapes[len(out) % len(shapes)](), before[int(rng.integers(len(before)))]
        if any(c.isdigit() for c in key):
            text = draw("abcdefghi jklmnopqr stuvwxyz ", 20) + " " + lead + key + draw(' "\n.,', 1) + draw("abcdefghi jklmnopqr stuvwxyz ", 20)
            out.append(windows(text, 21 + len(lead), 21 + len(lead) + len(key))[0])
    return out


def learn(docs: DataFrame, most: int = 4000, recall: float = 0.98, epochs: int = 6) -> Network:
    """Learn from every base finding and every other candidate of the corpus, and from generated keys: half of each kind fits the weights, half calibrates.

    Windows are dealt by hash to as many shards as it takes for some ``most`` of a kind in each, with ``most`` generated keys in every shard. In each epoch a task
    goes on from the common weights over one shard, and the weights of all shards are averaged, as whole numbers, so that their order can't matter.
    In calibration a logistic curve makes scores probabilities, and the threshold is the
    highest at which ``recall`` of the secrets kept aside are found. Without any candidate the generated keys and plain words serve.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = {}
            for t in batch.column(0).to_pylist():
                base = base_findings(t)
                for s, k, e in base:
                    if k == 0:
                        s = ASSIGN.match(t, s, e).start(2)
                    for row in windows(t, s, e):
                        seen[row] = 1
                for s, e in candidates(t, base):
                    if not SHAPES.match(t, s, e):
                        for row in windows(t, s, e):
                            seen.setdefault(row, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int32())], ["w", "y"])

    found = docs.select(whole_text().alias("text")).mapInArrow(listed, "w string, y int").groupBy("w").agg(F.max("y").alias("y"))
    found = saved(found, few=True)
    sizes = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = max(1, -(-max(sizes.values(), default=0) // most))
    plain = "\0" * SIDE + "plain2words.and.no.keys".ljust(CORE, "\0") + "\0" * SIDE
    dealt = found.select(F.pmod(F.xxhash64("w"), F.lit(shards)).cast("int").alias("shard"), "w", "y")
    # every shard has a row without a window, so that one without findings trains on generated keys all the same
    dealt = dealt.union(docs.sparkSession.range(shards).select(F.col("id").cast("int"), F.lit(None).cast("string"), F.lit(None).cast("int")))

    def of_shard(rows: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """The codes and labels of what it is fitted to and of what it keeps aside."""
        number = rows.column("shard")[0].as_py()
        own = sorted((w, y) for w, y in zip(rows.column("w").to_pylist(), rows.column("y").to_pylist(), strict=True) if w is not None)
        harmless = [w for w, y in own if not y] or [plain]
        secrets = [*(w for w, y in own if y), *generated(most, 3 + number)]
        side = lambda rows, k: [r for i, r in enumerate(rows) if i % 2 == k]
        (h0, h1), (s0, s1) = ([side(rows, k) for k in (0, 1)] for rows in (harmless, secrets))
        h0 = h0 * max(1, len(s0) // max(1, len(h0)))
        return tuple((codes(h + s), np.array([0.0] * len(h) + [1.0] * len(s))) for h, s in ((h0, s0), (h1, s1)))

    net = Network.fresh()
    shapes = {k: w.shape for k, w in net.weights.items()}

    def trained(weights: dict[str, np.ndarray], epoch: int):
        """The weights after an epoch over a shard, in units of 2^-24."""

        def run(rows: pa.Table) -> pa.Table:
            own = Network({k: w.copy() for k, w in weights.items()})
            own.fit(*of_shard(rows)[0], epochs=1, seed=5 + epoch)
            flat = np.concatenate([own.weights[k].ravel() for k in shapes]).astype(float)
            return pa.table({"i": pa.array(np.arange(len(flat), dtype=np.int32)), "x": pa.array(np.rint(flat * (1 << 24)).astype(np.int64))})

        return run

    for epoch in range(epochs):
        mean = np.zeros(sum(w.size for w in net.weights.values()))
        for r in dealt.groupBy("shard").applyInArrow(trained(net.weights, epoch), "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
            mean[r["i"]] = r["x"] / shards / (1 << 24)
        parts = np.split(mean.astype(np.float32), np.cumsum([math.prod(shape) for shape in shapes.values()])[:-1])
        net = Network({k: part.reshape(shape) for (k, shape), part in zip(shapes.items(), parts, strict=True)})

    def aside(rows: pa.Table) -> pa.Table:
        """How often each score occurs among the windows kept aside."""
        x, y = of_shard(rows)[1]
        seen, n = np.unique(np.stack((net.logits(x).astype(float), y), 1), axis=0, return_counts=True)
        return pa.table({"z": seen[:, 0], "y": seen[:, 1], "n": n.astype(np.int64)})

    rows = sorted(dealt.groupBy("shard").applyInArrow(aside, "z double, y double, n long").groupBy("z", "y").agg(F.sum("n").alias("n")).collect())
    drop_saved(found)
    z, y, n = np.array(rows, float).T
    a, b = fit_logistic(np.stack((z, np.ones(len(z))), 1), y, weights=n)
    net.platt = (max(float(a), 1e-3), float(b))
    z, n = z[y == 1], n[y == 1]  # by score; of the secrets from ``last`` on, ``recall`` are the fewest that have to be found
    last = np.flatnonzero(np.cumsum(n[::-1])[::-1] >= recall * n.sum())[-1]
    net.threshold = float(net.probability(z[last]))
    return net


def findings(text: str, net: Network | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and those that the network adds, as ``(start, kind, end)``."""
    base = base_findings(text)
    more, added = candidates(text, base) if net else [], []
    if more:
        rows = [windows(text, s, e) for s, e in more]
        p, at = net.probabilities([r for own in rows for r in own]), 0
        for (s, e), own in zip(more, rows, strict=True):
            if p[at : at + len(own)].max() >= net.threshold:
                added.append((s, 3, e))
            at += len(own)
    return base, added


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row.

    ``spans`` are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas. A null text is empty and has none.
    A null id is kept; rows that repeat an id or a text are scanned each for itself; an empty table gives no rows; other columns are not read, so their
    names can't clash. The time is in proportion to the length of a text, whatever it holds.
    """
    kind = f"doc_id {_type(docs)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, added = findings(text, net)
                for k in range(3):
                    counts[k].append(sum(f[1] == k for f in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, kind)


def masked(text: str, net: Network | None) -> str:
    """The text with every finding, overlapping ones together, replaced by ``MASK``."""
    base, added = findings(text, net)
    out, at = [], 0
    for s, _, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with its findings masked in ``text``; all rows and columns stay, a null text stays null. ``n_chars``, if there, is counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else masked(t, net) for t in batch.column("text").to_pylist()]
            yield batch.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, learn(docs))
