import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varimesh.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = defaultdict(int)
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i : i + k]] = max(covered[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * covered[lang, w] < 80 * a or (lang, w) not in covered:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:most]))


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [40, 100_000])
def test_against_brute_force(spark, most):
    rng = random.Random(3)
    words = ["the", "The", "of", "of", "a", "b", "a\x00z", "a\x01", "é", "中", "x-y", "\U0001f600", "zz"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(400)]
    rows += [("new york city hall", "en")] * 50 + [("new york", "en")] * 8 + [(None, "en"), ("", None), ("q" * 70000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7).withColumns({c: F.lit(1) for c in ("phrase", "n", "f", "key", "part", "rank", "words")})
    want = brute(rows, 5, most)
    assert len(want) > 100
    assert plain(phrases.query(df, 5, most)) == want


def test_query_against_sql(spark, docs):
    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(db.execute(phrases.SQL).fetchall())
    assert want and plain(phrases.query(docs)) == want


def test_odd_rows_and_empty_tables(spark, none, odd):
    with_lang = odd.withColumn("lang", F.lit(None).cast("string"))
    assert plain(phrases.query(with_lang, 2)) == brute([(r.text, r.lang) for r in with_lang.collect()], 2, 2000)
    assert phrases.query(none.withColumn("lang", F.lit("en"))).count() == 0


def test_words_and_pieces():
    assert phrases.words_of("A bÉ\tc.D\r\ne\x00f \x1cg".encode()) == ["a".encode(), "bÉ".encode(), b"c", b",", b"d", b",", b",", b"e\x00f", b"\x1cg"]


def test_counts_past_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 4 * 10**15, [5 * 10**15], [6 * 10**15])], "lang string, phrase string, words int, f long, above array<long>, ends array<long>")
    assert found.select(F.expr("(cast(2000000 as decimal(38,0)) * f) div (cast(above[0] as decimal(20,0)) + ends[0])")).first()[0] == 2000000 * 4 * 10**15 // (11 * 10**15)


def test_ranges_depend_on_the_words_alone():
    rng = random.Random(9)
    words = sorted({bytes(rng.choices(b"ab\x01\x1cz", k=rng.randint(1, 3))) for _ in range(30)})
    nodes = sorted({(rng.randrange(len(words)), rng.randrange(len(words)), rng.randrange(len(words))) for _ in range(300)})
    cuts = sorted((rng.choice([*words, b"q", b"\x00"]), rng.choice([*words, b"q", b"~"])) for _ in range(12))
    for depth in (1, 2, 3):
        own = sorted({n[:depth] for n in nodes})
        path = [np.array([n[k] for n in own]) for k in range(depth)]
        want = [sum(tuple(words[i] for i in n) >= c for c in cuts) for n in own]
        assert phrases._ranges(words, path, cuts).tolist() == want


def test_counts_go_on_over_batches(spark):
    """Sums of a range of phrases that many batches hold; a phrase's rows may lie in two of them."""
    rng = random.Random(2)
    rows = [(lang, f"{a} {b}", rng.randint(1, 9), 0) for lang in ("de", "en") for a in range(40) for b in ("x", "é", "丏") for _ in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    want = Counter()
    for lang, phrase, n, _ in rows:
        want[lang, phrase] += n
    df = spark.createDataFrame(rows, "lang string, phrase string, n long, range int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 100, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = plain(phrases.merged(df))
            assert got == sorted((*k, n) for k, n in want.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_of_many_texts():
    """Words split and numbered in bulk are those of each text by itself, whatever characters they have; a text's end parts words."""
    rng = random.Random(5)
    letters = [*map(chr, range(128)), *"  ,.\t\n\x85\xa0\u2003\u3000ñé中\U0001f600"]
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 40]))).encode() for _ in range(rng.randint(1, 4))]
        want = [b","]
        for t in texts:
            want += [*phrases.words_of(t), b","]
        trie = phrases.Trie("en")
        trie.add(texts[:1])
        trie.add(texts[1:])
        words = {n: w for w, n in trie.code.items()}
        got = [w for codes in trie.parts for w in map(words.get, codes.tolist())]
        assert phrases.numbered(texts).cast("large_binary").to_pylist() == want
        assert [w for w, v in zip(got, [None, *got]) if w != b"," or v != b","] == [w for w, v in zip(want, [None, *want]) if w != b"," or v != b","]


@pytest.mark.parametrize(("size", "most"), [(1, 1 << 22), (40, 50), (1 << 23, 1)])
def test_tries_of_slices(size, most):
    """Words are all there however many texts are split at once, and however many words a trie holds."""
    rows = [("en", "a b, c"), ("de", "d"), ("en", ""), ("en", "b a b"), ("de", "d e.")] * 7
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 9])], ["lang", "text"]) for at in range(0, len(rows), 9)]
    got, tries = Counter(), 0
    for some in phrases.gathered(iter(batches), size, most):
        tries += 1
        for lang, trie in some.items():
            words, (path,), n = trie.level(1, None)
            got.update({(lang, words[int(i)].as_py()): int(k) for i, k in zip(path, n)})
    assert got == {("en", b"a"): 14, ("en", b"b"): 21, ("en", b"c"): 7, ("de", b"d"): 14, ("de", b"e"): 7} and tries > (most < 100)
