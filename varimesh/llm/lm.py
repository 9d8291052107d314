"""Scoring texts with a small causal self-attention model on subword ids, trained in numpy.

A token's probability is that of its class, given what came before, times its share within the class, given the token before it. The frequent tokens are
classes of their own. Class counts after each token, and shares within classes, come from all training documents. On top of the class
counts one layer of causal self-attention reads up to ``WINDOW`` tokens back and shifts the class logits. It is first fitted on
a bounded sample; then copies of it are fitted further on all windows of all training documents, each on a shard of them, and the copies' average is the model.

Texts are scored in windows that overlap: each window scores its last ``STRIDE`` tokens and only reads those before, so every token is scored
exactly once. Windows of many texts go through masked attention in one batch. Queries, keys and values are linear in a token's and a place's embeddings, so
they are tables that scoring only looks up and adds.

For comparison each text also gets the smoothed unigram score of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _type, default_path, slices, vocabulary
from .common import documents, fold, saved, whole_text
from .packing import _tokenizer

WINDOW, STRIDE = 32, 24
BACK = WINDOW - STRIDE
DIM, SINGLE, SHARED, OWN_ROWS = 16, 60, 20, 2048
SLOT_BITS = 21
#: Tokens of a shard, and the most ids of a text of the first sample, which the driver holds.
SHARD, MOST_IDS = 8_000_000, 1 << 16
#: How many counts the share of a token without context weighs in its share after a row.
PRIOR = 8.0
#: Words whose counts are sent to every task; the counts of all others are joined.
FREQUENT = 1 << 18


# ---- tokens


def tokens(docs: DataFrame, path: str, modulus: int = 7, held: int = 2) -> DataFrame:
    """``(key, train, ids)``: the subword ids of each text as 16-bit numbers; ``key`` hashes id and text."""
    if len(vocabulary(path).bytes_of) > 1 << 16:
        raise ValueError("ids do not fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_to_numpy
        for batch in slices(batches):
            ids = [encode(t, allowed_special="all").astype("<u2").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["key", "train", "ids"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), (fold(modulus) != held).alias("train"), "text")
    return rows.mapInArrow(run, "key long, train boolean, ids binary")


def _counted(tok: DataFrame, width: int, of) -> np.ndarray:
    """Sums over the training texts of a vector with ``width`` places, counted in tasks and added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in slices(batches, 2048):
            total += np.bincount(of([np.frombuffer(b, "<u2") for b in batch.column(0).to_pylist()]), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

    out = np.zeros(width, np.int64)
    for r in tok.where("train").select("ids").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _pairs(tok: DataFrame, row_of: np.ndarray, end: int) -> DataFrame:
    """``(k, n)``: how often each ``row << 16 | token`` of neighbours occurs in the training texts, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, 2048):
            texts = [np.concatenate(([end], np.frombuffer(b, "<u2"), [end])) for b in batch.column(0).to_pylist()]
            if texts:
                new, n = np.unique(np.concatenate([(row_of[t[:-1]].astype(np.int64) << 16) | t[1:] for t in texts]), return_counts=True)
                both, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
                keys, counts = both, np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
                if len(keys) > 2_000_000:  # a task hands on what it has, so its memory does not grow with its texts
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "n"])

    return saved(tok.where("train").select("ids").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))


def _after(counted: DataFrame, class_of: np.ndarray, n_row: int, n_class: int) -> np.ndarray:
    """Counts of each class after each row, over all pairs: an aggregate of as many numbers as rows times classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((k >> 16) * n_class + class_of[k & 0xFFFF]), batch.column(1)], ["i", "n"])

    out = np.zeros(n_row * n_class)
    for r in counted.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out.reshape(n_row, n_class)


def _least_count(df: DataFrame, column: str, most: int) -> int:
    """The smallest count that at most ``most`` rows reach, from the histogram of counts: no rows are sorted or gathered to find it."""
    reached, least = 0, 1 << 62
    for r in sorted(df.groupBy(column).count().collect(), key=lambda r: -r[column]):
        reached += r["count"]
        if reached > most:
            break
        least = r[column]
    return least


# ---- model


@dataclass
class Model:
    """``row_of``: a token's row in the tables. ``class_of`` and ``share``: its class and share within it. ``after``: class logits after each row.

    ``pair``, sorted, and ``pair_share``: the commonest tokens seen after a row, as ``row << 16 | token``, and their log shares; ``rest``: the log share of
    what is left, after a row, for the tokens of a class that were not seen there. ``counts`` are the counts of each class after each row. Pairs seen fewer
    than ``least`` times, where there are such, are not held here but in ``counted``; what they add to a score is joined.
    """

    end: int
    row_of: np.ndarray
    class_of: np.ndarray
    share: np.ndarray
    after: np.ndarray
    weights: dict[str, np.ndarray]
    pair: np.ndarray
    pair_share: np.ndarray
    rest: np.ndarray
    counts: np.ndarray
    least: int = 0
    counted: DataFrame | None = None

    @property
    def cut(self) -> bool:
        return self.least > 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_slots", "counted")} | {"counted": None}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pair_log_share(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log shares of tokens seen ``n`` times after a row."""
        row, token = keys >> 16, keys & 0xFFFF
        return np.log((n + PRIOR * np.exp(self.share[token])) / (self.counts[row, self.class_of[token]] + PRIOR)).astype(np.float32)

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        """The keys that are not held here."""
        at = np.minimum(np.searchsorted(self.pair, keys), max(0, len(self.pair) - 1))
        return keys[self.pair[at] != keys] if len(self.pair) else keys

    def shares(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log shares of tokens within their classes, each after a row. Most pairs are found in a hashed table, those it has no room for by search."""
        if "_slots" not in self.__dict__:
            slot = self._slot(self.pair)
            held, at = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.float32)
            held[slot], at[slot] = self.pair, self.pair_share
            over = held[slot] != self.pair
            self._slots = held, at, self.pair[over], self.pair_share[over]
        held, at, over, over_share = self._slots
        key = (rows.astype(np.int64) << 16) | tokens
        slot = self._slot(key)
        hit = held[slot] == key
        out = np.where(hit, at[slot], self.rest[rows, self.class_of[tokens]] + self.share[tokens])
        if len(over) and not hit.all():
            left = np.flatnonzero(~hit)
            k = np.minimum(np.searchsorted(over, key[left]), len(over) - 1)
            found = over[k] == key[left]
            out[left[found]] = over_share[k[found]]
        return out

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows read ``(n, WINDOW)``, tokens scored ``(n, STRIDE)`` with -1 past the end, and how many windows each text has."""
        many = np.array([-(-(len(t) + 1) // STRIDE) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(many * STRIDE + BACK)))
        pad = len(self.after) - 1
        read, scored = np.full(starts[-1], pad, np.int32), np.full(starts[-1], -1, np.int32)
        first = self.row_of[self.end]
        for t, s in zip(texts, starts, strict=False):
            s += BACK
            read[s] = first
            room = read[s + 1 : s + 1 + len(t)]  # the last token may be scored only, at the very end of the buffer
            room[:] = self.row_of[t[: len(room)]]
            scored[s : s + len(t)], scored[s + len(t)] = t, self.end
        at = np.concatenate([s + STRIDE * np.arange(m) for s, m in zip(starts, many, strict=False)]) if len(texts) else np.zeros(0, np.int64)
        return read[at[:, None] + np.arange(WINDOW)], scored[at[:, None] + np.arange(BACK, WINDOW)], many

    def tables(self) -> dict[str, np.ndarray]:
        w = self.weights
        scale = 1 / np.sqrt(DIM)
        q, k, v = w["q"] * scale, w["k"], w["v"]
        made = {"q": w["e"] @ q, "pq": w["p"][BACK:] @ q, "k": w["e"] @ k, "pk": w["p"] @ k, "v": w["e"] @ v, "pv": w["p"] @ v, "c": w["c"]}
        return {name: np.ascontiguousarray(a, np.float32) for name, a in made.items()}

    def log_probability(self, texts: list[np.ndarray], batch: int = 192) -> np.ndarray:
        """The log10 probability of each text and its end."""
        read, scored, many = self.windows(texts)
        t, total = self.tables(), np.zeros(len(read))
        # exponents that can't overflow need no shift by their largest
        longest = lambda a, b: np.linalg.norm(a, axis=-1).max() + np.linalg.norm(b, axis=-1).max()
        small = longest(t["q"], t["pq"]) * longest(t["k"], t["pk"]) < 60 and longest(t["v"], t["pv"]) * np.linalg.norm(t["c"], axis=0).max() < 40
        hidden = np.where(np.arange(WINDOW)[None, :] > np.arange(BACK, WINDOW)[:, None], np.float32(-1e9), np.float32(0))
        # every batch is worked out in the same buffers
        new = lambda *shape: np.empty((batch, *shape), np.float32)
        held = new(STRIDE, DIM), new(WINDOW, DIM), new(WINDOW, DIM), new(STRIDE, WINDOW), new(STRIDE, DIM), new(STRIDE, len(t["c"][0])), new(STRIDE, len(t["c"][0]))
        for at in range(0, len(read), batch):
            x, y = read[at : at + batch], scored[at : at + batch]
            q, k, v, a, o, z, base = (b[: len(x)] for b in held)
            own = x[:, BACK:]
            for name, places, out in (("q", own, q), ("k", x, k), ("v", x, v)):
                np.take(t[name], places, axis=0, out=out, mode="clip")
                out += t["p" + name]
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            a += hidden
            if not small:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            np.matmul(a, v, out=o)
            o /= a.sum(axis=2, keepdims=True)
            rows = z.reshape(-1, z.shape[2])
            np.matmul(o.reshape(-1, DIM), t["c"], out=rows)
            np.take(self.after, own, axis=0, out=base, mode="clip")
            z += base
            flat = y.ravel()
            known = np.maximum(flat, 0)
            if not small:
                rows -= rows.max(axis=1, keepdims=True)
            got = rows[np.arange(len(rows)), self.class_of[known]].astype(float)
            got += self.shares(own.ravel(), known) - np.log(np.exp(rows, out=rows).sum(axis=1))
            got[flat < 0] = 0
            total[at : at + batch] = got.reshape(y.shape).sum(axis=1)
        ends = np.concatenate(([0], np.cumsum(total)))[np.concatenate(([0], np.cumsum(many)))]
        return np.diff(ends) / np.log(10)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss in nats over classes, and its gradients."""
        w, many = self.weights, len(x)
        scale, flat2 = w["e"].dtype.type(1 / np.sqrt(DIM)), lambda a: a.reshape(-1, a.shape[-1])
        e = w["e"][x]
        e += w["p"]
        own = np.ascontiguousarray(e[:, BACK:])
        # products with a matrix are made of all rows at once, not window by window
        q, k, v = (flat2(a) @ w[name] for a, name in ((own, "q"), (e, "k"), (e, "v")))
        q, k, v = q.reshape(many, STRIDE, DIM), k.reshape(many, WINDOW, DIM), v.reshape(many, WINDOW, DIM)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= scale
        a += np.where(np.arange(WINDOW)[None, :] > np.arange(BACK, WINDOW)[:, None], scale.dtype.type(-1e9), scale.dtype.type(0))
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        o = np.matmul(a, v)
        p = flat2(o) @ w["c"]
        p += self.after[x[:, BACK:].ravel()]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        flat = y.ravel()
        real = flat >= 0
        goal, n = self.class_of[np.maximum(flat, 0)], max(1, int(real.sum()))
        at = np.arange(len(p))
        loss = -float(np.log(p[at, goal][real] + 1e-30).sum()) / n
        p[at, goal] -= 1
        p *= (real / n).astype(p.dtype)[:, None]
        g = {"c": flat2(o).T @ p}
        do = (p @ w["c"].T).reshape(o.shape)
        da = np.matmul(do, v.transpose(0, 2, 1))
        dv = np.matmul(a.transpose(0, 2, 1), do)
        da -= np.einsum("nst,nst->ns", da, a)[:, :, None]
        da *= a
        da *= scale
        dq, dk = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q)
        g["q"], g["k"], g["v"] = (flat2(left).T @ flat2(d) for left, d in ((own, dq), (e, dk), (e, dv)))
        de = (flat2(dk) @ w["k"].T + flat2(dv) @ w["v"].T).reshape(e.shape)
        de[:, BACK:] += (flat2(dq) @ w["q"].T).reshape(dq.shape)
        g["p"] = de.sum(axis=0)
        rows = x.ravel()
        order = np.argsort(rows, kind="stable")
        rows, starts = np.unique(rows[order], return_index=True)
        g["e"] = np.zeros_like(w["e"])
        g["e"][rows] = np.add.reduceat(de.reshape(-1, DIM)[order], starts, axis=0)
        return loss, g

    def fit(self, read: np.ndarray, scored: np.ndarray, rate: float, epochs: int = 1, batch: int = 128, seed: int = 1, state: dict | None = None) -> list[float]:
        """Adam with a rate that falls to zero; the weights change in place. With ``state`` it goes on from where it was, at a steady rate."""
        rng, losses, steady = np.random.default_rng(seed), [], state is not None
        state = state if steady else {}
        if not state:
            state |= {"step": 0, "m": {k: np.zeros_like(a) for k, a in self.weights.items()}, "v": {k: np.zeros_like(a) for k, a in self.weights.items()}}
        m, v, step = state["m"], state["v"], state["step"]
        steps = epochs * -(-len(read) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(read))
            for at in range(0, len(read), batch):
                loss, g = self.gradients(read[order[at : at + batch]], scored[order[at : at + batch]])
                losses.append(loss)
                step += 1
                now = rate if steady else rate * (1 - (step - 1) / steps)
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.weights[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        state["step"] = step
        return losses


def _classes(count: np.ndarray, names: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's row, class and log share. The rest of the tokens, in the order of their bytes, make classes of about equal weight."""
    size = len(count)
    weight = count + 1.0
    ranked = np.lexsort((np.arange(size), -weight))
    class_of = np.zeros(size, np.int32)
    class_of[ranked[:SINGLE]] = np.arange(SINGLE)
    rest = np.array(sorted(ranked[SINGLE:].tolist(), key=lambda i: (names.get(i, b""), i)), np.int64)
    if len(rest):
        mass = np.cumsum(weight[rest])
        class_of[rest] = SINGLE + np.minimum(SHARED - 1, (mass / mass[-1] * SHARED).astype(int))
    row_of = OWN_ROWS + class_of
    row_of[ranked[:OWN_ROWS]] = np.arange(min(OWN_ROWS, size))
    sums = np.bincount(class_of, weight, SINGLE + SHARED)
    return row_of.astype(np.int32), class_of, np.log(weight / sums[class_of])


def learn(tok: DataFrame, path: str, sample: int = 3000, held_pairs: int = 2_000_000, seed: int = 2) -> Model:
    """The model of the training texts in ``tok`` (a saved table).

    Counts cover all training texts. ``sample`` texts of at most ``MOST_IDS`` ids, those with the smallest hashes, give attention its first weights. Then the texts are dealt by the hash of their
    key to as many shards as the table has tokens for, each a task that goes once through all windows of its texts in the order of their keys, and the weights
    of all shards are averaged by the windows they saw; so neither the number of executors nor the layout of the input changes the model.
    The ``held_pairs`` commonest pairs of a row and a token are sent to every task; the shares of all others are joined when texts are scored. Without training texts
    the model is even over all tokens.
    """
    names = vocabulary(path).bytes_of
    size = max(names) + 1
    end = max(vocabulary(path).special.values(), default=size - 1)
    count = _counted(tok, size, lambda texts: np.concatenate([np.append(t, np.uint16(end)) for t in texts]) if texts else np.zeros(0, int))
    row_of, class_of, share = _classes(count, names)
    n_class, n_row = SINGLE + SHARED, OWN_ROWS + SINGLE + SHARED + 1

    counted = _pairs(tok, row_of, end)
    pairs = _after(counted, class_of, n_row, n_class)
    least = _least_count(counted, "n", held_pairs)
    top = counted.where(F.col("n") >= least).toArrow()
    keys, n = top.column("k").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    overall = pairs.sum(axis=0) + 1
    overall /= overall.sum()
    after = np.log((pairs + 20 * overall) / (pairs.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
    rest = np.log(PRIOR / (pairs + PRIOR)).astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda a, *shape: rng.normal(0, a, shape).astype(np.float32)
    weights = {"e": draw(0.3, n_row, DIM), "p": draw(0.3, WINDOW, DIM), "q": draw(0.3, DIM, DIM), "k": draw(0.3, DIM, DIM), "v": draw(0.3, DIM, DIM), "c": draw(0.05, DIM, n_class)}
    model = Model(end, row_of, class_of, share, after, weights, keys[order], keys[order], rest, pairs)
    model.pair_share = model.pair_log_share(model.pair, n[order])
    if counted.where(F.col("n") < least).take(1):
        model.least, model.counted = least, counted
    # Keys are chosen first: only then do the chosen texts' ids travel.
    chosen = tok.where("train").where(F.length("ids") <= 2 * MOST_IDS).select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = tok.where("train").join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("key", "ids").collect()
    texts = [np.frombuffer(r["ids"], "<u2") for r in sorted(rows, key=lambda r: r["key"])]
    if not texts:
        return model
    read, scored, _ = model.windows(texts)
    model.fit(read, scored, 1.5e-2, epochs=2)
    model.weights = _averaged(tok, model, max(1, -(-int(count.sum()) // SHARD)))
    return model


def _averaged(tok: DataFrame, model: Model, shards: int) -> dict[str, np.ndarray]:
    """The mean, by windows, of what each shard makes of the model's weights on all windows of its texts."""
    shapes = [(k, a.shape) for k, a in sorted(model.weights.items())]
    start = tok.sparkSession.sparkContext.broadcast(replace(model, pair=model.pair[:0], pair_share=model.pair_share[:0], counts=model.counts[:0]))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = start.value
        own = replace(base, weights={k: a.copy() for k, a in base.weights.items()})
        state, n, reads, goals = {}, 0, [], []
        for batch in slices(batches, 256):
            read, scored, _ = own.windows([np.frombuffer(b, "<u2") for b in batch.column(0).to_pylist()])
            reads.append(read), goals.append(scored)
            n += len(read)
            if sum(map(len, reads)) >= 20_000:
                own.fit(np.concatenate(reads), np.concatenate(goals), 2e-3, batch=256, state=state)
                reads, goals = [], []
        if reads and sum(map(len, reads)):
            own.fit(np.concatenate(reads), np.concatenate(goals), 2e-3, batch=256, state=state)
        if n:
            flat = np.concatenate([own.weights[k].ravel() for k, _ in shapes]).astype(float) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), float(n)))], ["i", "x", "n"])

    dealt = tok.where("train").select("key", "ids").repartition(shards, "key").sortWithinPartitions("key", "ids").select("ids")
    parts = dealt.mapInArrow(go_on, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
    flat = np.zeros(sum(int(np.prod(s)) for _, s in shapes))
    for r in parts.collect():
        flat[r["i"]] = r["x"]
    start.unpersist()
    out, at = {}, 0
    for k, shape in shapes:
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def score(tok: DataFrame, model: Model) -> DataFrame:
    """``(key, score)``, a row for each row of ``tok``: the log10 probability of each text and its end."""
    held = tok.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 128):
            texts = [np.frombuffer(b, "<u2") for b in batch.column(1).to_pylist()]
            got, ends, keys, times = model.log_probability(texts), [0], [], []
            for t in texts if model.cut else ():
                k, n = np.unique((model.row_of[np.append(np.uint16(model.end), t)].astype(np.int64) << 16) | np.append(t, np.uint16(model.end)), return_counts=True)
                left = np.isin(k, model.unseen(k), assume_unique=True)
                keys.append(k[left]), times.append(n[left])
                ends.append(ends[-1] + int(left.sum()))
            if not model.cut:
                ends = [0] * (len(texts) + 1)
            flat = [np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64) for a in (keys, times)]
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a) for a in flat], ["k", "t"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), rare], ["key", "score", "rare"])

    out = tok.select("key", "ids").mapInArrow(run, "key long, score double, rare array<struct<k:long,t:long>>")
    if not model.cut:
        return out.select("key", "score")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:  # what the share of a pair is above that of a token never seen after its row
            k = batch.column(0).to_numpy()
            plain = model.rest[k >> 16, model.class_of[k & 0xFFFF]] + model.share[k & 0xFFFF]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((model.pair_log_share(k, batch.column(1).to_numpy()) - plain) / np.log(10), pa.float64())], ["k", "g"])

    rare = model.counted.where(F.col("n") < model.least).mapInArrow(gains, "k long, g double")
    out = saved(out.withColumn("row", F.monotonically_increasing_id()))
    more = out.select("row", F.explode("rare").alias("r")).select("row", F.col("r.k").alias("k"), F.col("r.t").alias("t")).join(rare, "k")
    more = more.groupBy("row").agg(F.sum(F.col("t") * F.col("g")).alias("more"))
    return out.join(more, "row", "left").select("key", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


# ---- unigram base


def split(text: bytes) -> list[bytes]:
    """Words in UTF-8: on bytes only A-Z fold and only ASCII white space splits."""
    return text.lower().split()


def word_counts(docs: DataFrame, modulus: int = 7, held: int = 2, most_in_task: int = 400_000) -> DataFrame:
    """``(word, c)`` over all training texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(split(text))
                seen[b""] += 1
                if len(seen) > most_in_task:
                    yield out()
                    seen.clear()
        yield out()

    train = docs.where(fold(modulus) != held).select(whole_text().alias("text"))
    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def base_scores(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score)`` for every row.

    The counts of the ``frequent`` commonest words go to every task; a text's other words are joined with their counts.
    """
    counts = saved(word_counts(docs))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word")).first()
    top = counts.where(F.col("c") >= _least_count(counts, "c", frequent)).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), np.log10(top.column("c").to_numpy() + 1.0).tolist(), strict=True)))
    del top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = known.value
        get = logs.get
        for batch in slices(batches):
            n_tokens, n_known, sums, ends, names, times = [], [], [], [0], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                words = split(text)
                words.append(b"")
                others = Counter([w for w in words if w not in logs])
                names += others.keys()
                times += others.values()
                ends.append(len(names))
                n_tokens.append(len(words))
                n_known.append(len(words) - others.total())
                sums.append(sum(map(get, words, repeat(0.0))))
            columns = [*batch.columns[:3], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64())]
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["w", "n"])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "held_out", "n_tokens", "known", "logs", "rare"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", (fold(7) == 2).alias("held_out"), "text")
    kind = f"key long, doc_id {_type(docs)}, held_out boolean, n_tokens long, known long, logs double, rare array<struct<w:binary,n:long>>"
    part = saved(rows.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("word"), F.col("r.n").alias("n"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = part.drop("rare").join(rare, "row", "left")
    size = float(np.log10(total + kinds + 1))
    return out.select(
        "key", "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
    )


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Base columns and ``score`` for every row of ``docs`` (``doc_id``, ``text``).

    A null text is empty and scored as its end alone. Rows equal in id and text are scored alike, each for itself; an empty table gives no rows.
    """
    path = path or default_path()
    tok = saved(tokens(docs, path))
    scored = score(tok, learn(tok, path)).dropDuplicates(["key"])
    return base_scores(docs).join(scored, "key").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
