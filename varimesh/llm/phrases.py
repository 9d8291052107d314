"""Phrases of two to four words whose words occur together more often than their parts suggest.

Each shard of texts becomes a count trie of bounded depth: a node for each run of words, made level by level from the node of the words before and the next word.
A level goes only below nodes that can still be frequent over the whole corpus, since no part of a frequent phrase is rarer than the phrase. Tries are written in order
of their phrases and merged by ranges of prefixes. A walk through the merged trie has the left parts of a phrase on its stack; the same walk
through the trie of reversed phrases follows the links from each phrase to itself without its first word, which are its right parts.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_text

DEPTH, LEAST, SHOWN = 4, 30, 2000
#: Words of texts that one trie holds.
SHARD = 1 << 22
#: Bytes of texts that are split at once.
SLICE = 1 << 23
#: Bits of the filter that tells tasks which phrases are frequent: a megabyte is 2^23. Its size never changes; a bit too many only lets a phrase be counted in vain.
FILTER_BITS = 27

#: Sentence marks and line breaks end a piece; tabs and spaces part words. Only A-Z become small (fixed values).
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(",") if b in _MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _spaced(text: bytes) -> bytes:
    return text.translate(_TABLE).replace(b",", b" , ")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with ``b","``, which no word can be, at the ends of pieces."""
    return _spaced(text).split()


def numbered(texts: list[bytes]) -> pa.DictionaryArray:
    """:func:`words_of` of one text after the other, with ``b","`` before, between and after them. Arrow splits and numbers the words, which would be too many Python objects."""
    joined = _spaced(b",".join([b"", *texts, b""])).strip(b" ")
    return pc.ascii_split_whitespace(pa.array([joined], pa.large_string())).values.dictionary_encode()


def _step(h: np.ndarray, k: int) -> np.ndarray:
    """A word's share of the hash of a phrase that has it at place ``k``; the shares are added up."""
    with np.errstate(over="ignore"):
        x = (h + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return x * np.uint64(0x94D049BB133111EB)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Trie:
    """The words of one language in a shard, and the counts of its runs of ``depth`` words."""

    def __init__(self, lang: str):
        import xxhash

        self.lang, self.seed, self.digest = lang, xxhash.xxh64_intdigest(lang.encode()) & 0x7FFFFFFF, xxhash.xxh64_intdigest
        self.code: dict[bytes, int] = {b",": 0}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, texts: list[bytes]) -> None:
        words = numbered(texts)
        index = [self.code.setdefault(w, len(self.code)) for w in words.dictionary.cast(pa.large_binary()).to_pylist()]
        self.parts.append(np.array(index, np.int32)[words.indices.to_numpy()])
        self.words += len(words)

    def level(self, depth: int, frequent: np.ndarray | None) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """The trie's nodes of ``depth`` words in order: all words, sorted, each node's words by place among them, and its count. Both parts of ``depth - 1`` words must pass the filter.

        Words are numbered in order first, so nodes come out in order level by level.
        """
        words = pa.array(list(self.code)[1:], pa.binary())
        order = pc.sort_indices(words).to_numpy()
        words, rank = words.take(pa.array(order)), np.zeros(len(order) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(order) + 1)
        codes = rank[np.concatenate(self.parts)]  # 0 is the end of a piece
        if depth == 1:
            return words, [np.arange(len(words))], np.bincount(codes, minlength=len(words) + 1)[1:]
        size = len(codes) - depth + 1
        if size <= 0:
            return words, [np.zeros(0, np.int64)] * depth, np.zeros(0, np.int64)
        h = np.fromiter((self.digest(w, self.seed) for w in (b",", *words.to_pylist())), np.uint64, len(rank))
        part = np.zeros(size + 1, np.uint64)
        whole = codes[: size + 1] > 0
        with np.errstate(over="ignore"):
            for k in range(depth - 1):
                part += _step(h, k)[codes[k : k + size + 1]]
                whole &= codes[k : k + size + 1] > 0
        slot = _slot(part)
        good = whole & ((frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(good[:-1] & good[1:])
        node, above = codes[at].astype(np.int64), []
        for k in range(1, depth - 1):
            nodes, node = np.unique(node * len(rank) + codes[at + k], return_inverse=True)
            above.append(nodes)
        leaves, n = np.unique(node * len(rank) + codes[at + depth - 1], return_counts=True)
        above.append(leaves)
        now, path = np.arange(len(above[-1])), []
        for nodes in reversed(above):
            path.append(nodes[now] % len(rank) - 1)
            now = nodes[now] // len(rank)
        path.append(now - 1)
        return words, path[::-1], n


def gathered(batches: Iterator[pa.RecordBatch], size: int = SLICE, most: int = SHARD) -> Iterator[dict[str, Trie]]:
    """The tries of texts ``(lang, text)`` by language, those of some ``most`` words at a time; some ``size`` bytes of texts are split at once."""
    tries: dict[str, Trie] = {}
    for batch in batches:
        waiting, held = defaultdict(list), 0
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for row, (lang, text) in enumerate(zip(langs, texts, strict=True), 1):
            waiting[lang].append(text)
            held += len(text) + 1
            if held < size and row < len(texts):
                continue
            for key, some in waiting.items():
                if key not in tries:
                    tries[key] = Trie(key)
                tries[key].add(some)
            waiting, held = defaultdict(list), 0
            if sum(t.words for t in tries.values()) >= most:
                yield tries
                tries = {}
    if tries:
        yield tries


def _ranges(words: list[bytes], path: list[np.ndarray], cuts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The range between cuts, pairs of words in order, of each node of a trie; it depends on the node's words alone."""
    ends = []
    for first, second in cuts:
        i = bisect_left(words, first)
        lo, hi = np.searchsorted(path[0], (i, i + 1))
        if i < len(words) and words[i] == first:
            lo = hi if len(path) == 1 else lo + np.searchsorted(path[1][lo:hi], bisect_left(words, second))
        ends.append(int(lo))
    return np.repeat(np.arange(len(cuts) + 1, dtype=np.int32), np.diff([0, *ends, len(path[0])]))


def _cuts(words: DataFrame) -> list[tuple[bytes, bytes]]:
    """Where to cut all phrases into ranges of like weight: pairs of words drawn with their counts, as many as four for each shuffle partition. Results don't depend on them."""
    parts = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = (F.pmod(F.xxhash64("phrase", "lang"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    drawn = [r["phrase"].encode() for r in words.orderBy(-F.ln(u) / F.col("n"), "phrase", "lang").limit(8 * parts).select("phrase").collect()]
    pairs = sorted({*zip(drawn, drawn[1:], strict=False), *zip(drawn, drawn[2:], strict=False)})
    return pairs[:: max(1, math.ceil(len(pairs) / parts))][1:]


def shards(texts: DataFrame, depth: int, frequent=None, cuts: list[tuple[bytes, bytes]] = ()) -> DataFrame:
    """``(lang, phrase, n, range)``: the level of every shard's trie, in order within a shard and cut into ranges."""
    cuts = list(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)

        def level(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
            for lang in sorted(tries):
                words, path, n = tries[lang].level(depth, bits)
                ranges = _ranges(words.to_pylist() if cuts else [], path, cuts)
                for at in range(0, len(n), 1 << 14):
                    parts = [words.take(pa.array(p[at : at + (1 << 14)])) for p in path]
                    some = (pc.binary_join_element_wise(*parts, b" ") if depth > 1 else parts[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(n[at : at + (1 << 14)], pa.int64()), pa.array(ranges[at : at + (1 << 14)])], ["lang", "phrase", "n", "range"])

        for tries in gathered(batches):
            yield from level(tries)

    return texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long, range int")


def merged(tries: DataFrame) -> DataFrame:
    """The counts of all shards added up: each range of phrases is read through in order, with the sum of equal neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if last is not None:
                table = pa.concat_tables([last, table]).combine_chunks()
            # by neighbours: Arrow's groups come in no certain order, and the last one must be that of the last row
            new = pc.or_(*(pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)) for c in ("lang", "phrase"))).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], new)))
            sums = pa.array(np.add.reduceat(table["n"].to_numpy(), first))
            table = table.select(["lang", "phrase"]).take(pa.array(first)).append_column("n", sums)
            last = table.slice(table.num_rows - 1)  # it may go on in the next batch
            yield from table.slice(0, table.num_rows - 1).to_batches()
        if last is not None:
            yield from last.to_batches()

    return tries.repartition("range").sortWithinPartitions("phrase", "lang").select("lang", "phrase", "n").mapInArrow(run, "lang string, phrase string, n long")


def _filter(frequent: DataFrame):
    """A broadcast bitmap of the hashes of phrases, of 2^FILTER_BITS bits whatever their number; the driver gets its bytes in words of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        for batch in batches:
            slots = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = tries.get(lang) or tries.setdefault(lang, Trie(lang))
                slots.append([t.digest(w, t.seed) for w in phrase.split(b" ")])
            if slots:
                h = np.array(slots, np.uint64)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array(_slot(sum(_step(h[:, k], k) for k in range(h.shape[1]))))], ["slot"])

    slots = frequent.select("lang", "phrase").mapInArrow(run, "slot long")
    cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bits.astype("<i8").tobytes())


def frequent_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` for every phrase of up to ``depth`` words with ``f >= least``, and ``(lang, n)`` with the words of each language.

    Null languages are ``und``; null texts are empty. Other columns are not read; each row counts, repeated or not. The levels' tables are written to the shared store.
    """
    if least < 1 or not 1 <= depth <= 16:
        raise ValueError("phrases need a least count and a depth of 1 to 16")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    # words have no ranges yet, and are few beside phrases
    every = saved(shards(texts, 1).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    sizes = saved(every.groupBy("lang").agg(F.sum("n").alias("n")), few=True)
    level = every.where(F.col("n") >= least)
    out = level.withColumn("words", F.lit(1))
    cuts = _cuts(level)
    for k in range(2, depth + 1):
        level = saved(merged(shards(texts, k, _filter(level), cuts)).where(F.col("n") >= least))
        out = out.unionByName(level.withColumn("words", F.lit(k)))
    return out.select("lang", "phrase", "words", F.col("n").alias("f")), sizes


def _bytes(key: list[str]) -> list[bytes]:
    return [k.encode() for k in key]


def _walked(counted: DataFrame, reverse: bool) -> DataFrame:
    """``(lang, phrase, words, f, above)`` with the counts of the phrase's first 1, 2, ... words, or its last if ``reverse``, by a walk in order.

    Ranges are cut at phrases from a sample of bounded size; a phrase whose continuations reach over a cut is put before each range that has some, so that every walk
    begins with the stack it needs: at most ``depth - 1`` further rows for each cut.
    """
    words = F.split("phrase", " ")
    rows = counted.withColumn("key", F.concat(F.array("lang"), F.reverse(words) if reverse else words))
    parts = max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = sorted(_bytes(r["key"]) for r in rows.select("key").orderBy(F.xxhash64("key"), "key").limit(20 * parts).collect())
    cuts = sample[:: max(1, math.ceil(len(sample) / parts))][1:]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_bytes(k) for k in batch.column(4).to_pylist()]
            first = [bisect_right(cuts, k) for k in keys]
            last = [bisect_right(cuts, [*k, b"\xff"]) for k in keys]  # no letter is as large
            rows = np.repeat(np.arange(len(keys)), [b - a + 1 for a, b in zip(first, last, strict=True)])
            part = pa.array([p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)], pa.int32())
            own = pa.array([p == a for a, b in zip(first, last, strict=True) for p in range(a, b + 1)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), part, own], [*batch.schema.names, "part", "own"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[list[bytes], int]] = []
        place = None
        for batch in batches:
            above = []
            for part, k, f in zip(batch.column(5).to_pylist(), map(_bytes, batch.column(4).to_pylist()), batch.column(3).to_pylist(), strict=True):
                if part != place:
                    stack, place = [], part
                while stack and k[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                above.append([n for _, n in stack])
                stack.append((k, f))
            table = pa.Table.from_arrays([*batch.columns[:4], pa.array(above, pa.list_(pa.int64()))], ["lang", "phrase", "words", "f", "above"])
            yield from table.filter(batch.column(6)).to_batches()

    kind = "lang string, phrase string, words int, f long, key array<string>, part int, own boolean"
    dealt = rows.select("lang", "phrase", "words", "f", "key").mapInArrow(placed, kind)
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "key").mapInArrow(walk, "lang string, phrase string, words int, f long, above array<long>")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, covered: int = 80) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases that are not mostly part of a longer one.

    Each phrase is cut where its score, 2000000 a / (l + r) in whole numbers, is lowest, of equal cuts after the fewest words. One goes when a candidate of one word more has at
    least ``covered`` per cent of its count; longer candidates need not be asked, as their own parts are candidates as frequent. Ties, null languages and texts, repeated rows and empty tables: as stated in
    :func:`frequent_phrases`; no rows give no rows.
    """
    counted, sizes = frequent_phrases(docs, least, depth)
    counted = saved(counted)
    left, right = (_walked(counted, reverse).where("words > 1") for reverse in (False, True))
    both = left.join(right.select("lang", "phrase", F.col("above").alias("ends")), ["lang", "phrase"])
    # left part of k words, right part of words - k
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        F.expr("cast(2000000 as decimal(38,0))").alias("m"), k.alias("k"), F.element_at("above", k).alias("l"), F.element_at("ends", F.col("words") - k).alias("r"),
    ))
    both = both.withColumn("cuts", cuts).withColumn(
        "cut", F.expr("array_min(transform(cuts, c -> struct((c.m * f) div (cast(c.l as decimal(20,0)) + c.r) as score, c.k as k, c.l as l, c.r as r)))")
    )
    words = F.split("phrase", " ")
    inner = counted.where("words > 2").select(
        "lang", F.explode(F.array(*(F.array_join(F.slice(words, start, F.col("words") - 1), " ") for start in (1, 2)))).alias("phrase"), F.col("f").alias("longer")
    )
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = both.join(longest, ["lang", "phrase"], "left").where(
        f"longer is null or cast(longer as decimal(38,0)) * 100 < cast(f as decimal(38,0)) * {int(covered)}"
    )
    return kept.join(sizes, "lang").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def ranked(found: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first ``most`` of each language with their ``rank``: by score, then count, then phrase in byte order.

    Rounds over ever fewer buckets keep ``most`` of each bucket, so a language's rows never meet in one task before 64 buckets at most are left of it.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while buckets > 1:
        found = found.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
        w = Window.partitionBy("lang", "_bucket").orderBy(*order)
        found = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank", "_bucket")
        buckets //= 64
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def query(docs: DataFrame, least: int = LEAST, most: int = SHOWN) -> DataFrame:
    return ranked(collocations(docs, least), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " union all ".join(
    f"select lang, {k} words, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) phrase from pieces where len(w) >= {k}" for k in range(1, DEPTH + 1)
)
SQL = f"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from (
    select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece
    from documents)),
grams as materialized (select lang, words, phrase, count(*)::hugeint f from ({_GRAMS}) group by all),
sizes as (select lang, sum(f) n from grams where words = 1 group by lang),
freq as materialized (select * from grams where f >= {LEAST}),
cand as materialized (select *, string_split(phrase, ' ') w from freq where words > 1),
parts as materialized (
  select lang, phrase, f, k, array_to_string(w[1:k], ' ') before, array_to_string(w[k + 1:], ' ') after from (select *, unnest(range(1, words)) k from cand)),
cuts as (
  select c.lang, c.phrase, c.f a, k, l.f l, r.f r, (2000000 * c.f) // (l.f + r.f) score
  from parts c join freq l on (l.lang, l.phrase) = (c.lang, c.before) join freq r on (r.lang, r.phrase) = (c.lang, c.after)),
cut as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, array_to_string(w[i:i + m - 1], ' ') phrase, f
  from (select *, unnest(range(1, words - m + 2)) i from (select *, unnest(range(2, words)) m from cand where words > 2))),
longer as (select lang, phrase, max(f) f from inner_parts group by all)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from (
  select c.*, s.n, row_number() over (partition by c.lang order by score desc, a desc, encode(c.phrase) asc) rank
  from cut c join sizes s using (lang) left join longer x on x.lang = c.lang and x.phrase = c.phrase
  where x.f is null or 100 * x.f < 80 * c.a)
where rank <= {SHOWN}
"""
