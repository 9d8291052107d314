"""Exact, line and near-duplicate removal against brute force."""

import hashlib
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varimesh.llm import common, exact, line_dedup, linking, simhash
from varimesh.llm.common import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_fingerprints(docs, odd):
    for r in docs.collect():
        assert simhash.fingerprint(r["text"]) % (1 << 64) == plain_fingerprint(r["text"])
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("one Two") == simhash.fingerprint(" ONE\ttwo ")
    long = "a b c d e f g " * 3000
    assert simhash.fingerprint(long, block=100) == simhash.fingerprint(long)


def test_near_duplicates(docs):
    rows = docs.orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    g = groups_by(len(rows), linked)
    least = {}
    for r, k in zip(rows, g, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(docs).collect()}
    assert got == {r["doc_id"]: (f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, g, strict=True)}


@pytest.mark.parametrize("heavy", [512, 2])
def test_links_connect_all_neighbours(spark, heavy):
    """Random fingerprints with crowds around some of them; also when every cell counts as crowded."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    points = set(base.tolist()) | {0, -1, 1 << 40}
    for b in base[:4].tolist():
        for _ in range(12):
            flip = 0
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                flip ^= 1 << bit
            x = (b % (1 << 64)) ^ flip
            points.add(x - (1 << 64) if x >> 63 else x)
    points = sorted(points)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    want = groups_by(len(points), [(i, j) for i in range(len(points)) for j in range(i) if ((points[i] ^ points[j]) % (1 << 64)).bit_count() <= 4])
    got = {r["node"]: r["component"] for r in components(simhash.links(df, heavy=heavy), "a", "b").collect()}
    label = [got.get(p, p) for p in points]
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(points)) for j in range(i))


def test_near_duplicate_edges(odd, none):
    got = simhash.query(odd).collect()
    assert len(got) == odd.count()
    same = {r["component_id"] for r in got if r["doc_id"] in (4, 5, 9)}
    assert same == {4} and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.query(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 6, 7, 8, 10]
    assert simhash.keep_first(none).count() == 0


def sets(text, k=5):
    w = words(text)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_texts(spark, docs):
    """Groups of texts with a Jaccard similarity of 0.8 of five-word shingles, from all pairs; near copies with words replaced here and there are among them."""
    rng = np.random.default_rng(5)
    base = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(80).collect()]
    made = []
    for k in range(40):
        w = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(int(rng.integers(60, 400)))]
        made.append((1000 + 2 * k, " ".join(w)))
        for at in rng.choice(len(w), max(1, len(w) // 60), replace=False):
            w[at] = "other"
        made.append((1001 + 2 * k, " ".join(w)))
    rows = base + made
    own = [sets(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    g = groups_by(len(rows), linked)
    assert sum(own[i] != own[j] for i, j in linked) >= 30
    least = {}
    for (d, _), k in zip(rows, g, strict=True):
        least[k] = min(least.get(k, d), d)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: least[k] for (d, _), k in zip(rows, g, strict=True)}


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_exact(rows, got):
    groups = {}
    for r in rows:
        groups.setdefault(strip(r["text"]), []).append(r)
    want = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        want += [(r["doc_id"], best["doc_id"], len(own), r["doc_id"] == best["doc_id"], hashlib.sha256(text.encode()).hexdigest()) for r in own]
    key = lambda t: tuple((x is None, x if x is not None else 0) for x in t)
    assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "digest")) for r in got], key=key) == sorted(want, key=key)


def test_exact(spark, docs, odd, none, tmp_path):
    for name, df in (("d", docs), ("o", odd)):
        df.write.parquet(str(tmp_path / name))
        check_exact(df.collect(), exact.deduplicate(spark, str(tmp_path / name)).collect())
    none.write.parquet(str(tmp_path / "n"))
    assert exact.deduplicate(spark, str(tmp_path / "n")).count() == 0


def test_colliding_digests_are_settled_by_bytes(spark, docs, tmp_path):
    docs.limit(60).write.parquet(str(tmp_path / "d"))
    got = exact.deduplicate(spark, str(tmp_path / "d"), digest=lambda t: F.substring(exact.sha(t), 1, 1)).drop("digest").collect()
    want = exact.deduplicate(spark, str(tmp_path / "d")).drop("digest").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_state_carries_over(spark, tmp_path):
    """New files meet the state of earlier runs."""
    d, cp = str(tmp_path / "d"), str(tmp_path / "cp")
    df = spark.createDataFrame([(2, "a b"), (3, "c")], "doc_id long, text string")
    df.coalesce(1).write.parquet(d)
    assert exact.run_stream(spark, d, cp).count() == 2
    spark.createDataFrame([(1, "ab"), (4, "a  b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(d)
    state = {r["keep_id"]: r["group_size"] for r in exact.run_stream(spark, d, cp).collect()}
    assert state == {4: 3, 3: 1}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def line_units(norm):
    if norm.count(" ") >= 3 or len(norm) < 2:
        return norm.split(" ")
    q = 4 if len(norm) >= 16 else 2
    return [norm[i : i + q] for i in range(len(norm) - q + 1)]


def line_print(norm):
    """The fingerprint as the docstring has it, with plain integers."""
    w = line_units(norm)
    signed = lambda h, first: (h & ((1 << 63) - 1) & ~line_dedup.PLACE) - (1 << 63 if first else 0)
    hashed = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    if len(w) >= line_dedup.MANY_WORDS:
        last = [xxhash.xxh64_intdigest(b.encode(), hashed(a)) for a, b in zip(w, w[1:], strict=False)] + [hashed(w[-1])]
        pack = [signed(h, True) + i for i, h in enumerate(last)]
    else:
        pack = [signed(hashed(x), len(x) > 4) + i for i, x in enumerate(w)]
    top = sorted(pack)[: line_dedup.FEATURES]
    long = [x for x in top if x < 0]
    use = long if len(long) >= 3 else top
    h = [xxhash.xxh64_intdigest(((x & ~line_dedup.PLACE) % (1 << 64)).to_bytes(8, "little"), 42) for x in use]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def alike(spark, norms):
    """Pairs of different lines with the edit similarity, from all pairs and the distance alone."""
    df = spark.createDataFrame(list(enumerate(norms)), "i int, a string")
    both = df.join(df.select(F.col("i").alias("j"), F.col("a").alias("b")), F.col("j") < F.col("i"))
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * F.lit(0.2) + F.lit(1e-6)).cast("int")
    near = both.where(F.abs(F.length("a") - F.length("b")) <= most).where(F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0)
    return [(r["i"], r["j"]) for r in near.select("i", "j").collect()]


def plain_lines(spark, rows):
    """Each document's text without the lines to drop, from all pairs of lines, and how many pairs of different lines are alike."""
    places = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        for pos, line in enumerate((r["text"] or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), []).append((r["doc_id"], pos))
    names = list(places)
    linked = alike(spark, names)
    g = groups_by(len(names), linked)
    first = {}
    for n, k in zip(names, g, strict=True):
        first[k] = min([*([first[k]] if k in first else []), *places[n]])
    drop = {p for n, k in zip(names, g, strict=True) for p in places[n] if p != first[k]}
    return {r["doc_id"]: "\n".join(x for pos, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], pos) not in drop) for r in rows}, len(linked)


def test_lines(spark, docs):
    """Whole documents against the edit distance of all pairs of their lines, without fingerprints; short lines and exact copies of them too."""
    rows = docs.orderBy("doc_id").limit(60).collect()
    near = [(900, "A fine line about several matters nobody disputed yesterday evening\nshort one\nother words that stand alone here entirely today"), (901, "a fine line about several matters nobody disputed yesterday morning!\n\nshort one"), (902, "A  fine line about several matters nobody disputed yesterday evening\nshort ones")]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + near, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    want, pairs = plain_lines(spark, df.collect())
    assert pairs >= 4 and got == want
    assert got[901] == "" and got[902] == ""


def test_recall_of_alike_lines(spark):
    """Of all pairs of different lines of a table with edit similarity of 0.8, found by the distance alone, nine in ten end in one group."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = line_dedup.saved(line_dedup.lines(rows))
    again = found.groupBy("h1").count().where("count > 1").select("h1")
    group = {r["id"]: r["group"] for r in line_dedup.groups(found, again).collect()}
    lines = found.where(F.length("norm") < 120).dropDuplicates(["h1"]).select("h1", "norm").collect()
    pairs = [(lines[i]["h1"], lines[j]["h1"]) for i, j in alike(spark, [r["norm"] for r in lines])]
    assert len(pairs) > 50 and np.mean([a in group and group[a] == group.get(b) for a, b in pairs]) >= 0.9


@pytest.mark.parametrize("n", [8, 12, 18, 40])
def test_alike_lines_are_found(spark, n):
    """Of lines whose copies have every ninth word replaced, or one, all copies go, as in a comparison of all pairs without fingerprints."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts = []
    for _ in range(30):
        w = [word() for _ in range(n)]
        at = int(rng.integers(9)) if n > 18 else int(rng.integers(n))
        texts += [" ".join(w), " ".join(word() if i % (9 if n > 18 else n) == at else x for i, x in enumerate(w))]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-6]
    g = groups_by(len(texts), linked)
    assert len(linked) >= 30
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: x if g.index(g[i]) == i else "" for i, x in enumerate(texts)}


def test_line_fingerprints(spark):
    """The counts in bit planes give the brute-force fingerprint, for few words and many, short and long, repeated and not."""
    rng = np.random.default_rng(3)
    norms = [" ".join("".join(rng.choice(list("abcde"), int(rng.integers(1, 9)))) for _ in range(int(rng.integers(1, 90)))) for _ in range(60)]
    df = line_dedup.units(spark.createDataFrame([(n,) for n in norms], "norm string"))
    got = {r["norm"]: r["fp"] % (1 << 64) for r in line_dedup.fingerprints(df).collect()}
    assert got == {n: line_print(n) for n in norms}


def test_crowds_of_lines(spark):
    """Hundreds of lines from one template, and hundreds of unlike lines with one beginning; pairs stay in proportion to the lines."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    body = " ".join(word() for _ in range(20))
    template = [f"{body} number {i}" for i in range(400)]
    unlike = [f"the common beginning of many lines {' '.join(word() for _ in range(14))}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(template + unlike)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert [i for i in range(400) if got[i]] == [0] and all(got[i] for i in range(400, 800))
    found = line_dedup.saved(line_dedup.lines(df))
    rows = found.select(F.col("h1").alias("id"), "fp", F.col("anchors").alias("keys"))
    assert line_dedup.candidates(rows, rows.select("id", "fp"), line_dedup.WIDE).count() < 40 * 800


def judged(df):
    """Whether the lines ``a`` and ``b`` of each row are alike."""
    df = df.select(F.monotonically_increasing_id().alias("i"), F.col("a").alias("norm"), F.col("b").alias("norm2")).cache()
    good = {r["i"] for r in line_dedup.alike(df).collect()}
    return [r["i"] in good for r in df.orderBy("i").collect()]


def test_similarity_is_that_of_the_distance(spark):
    """Words replaced, left out and put in at the beginning, in the middle and at the end, and lines that repeat a word."""
    rng = np.random.default_rng(11)
    rows = [("x", "x y"), ("x x x x x x", "x x x x x"), ("aa", "aa aa aa"), ("same", "same"), ("a b c d e f g h i j", "a b c d e f g h i"), ("a b c", "c b a")]
    for _ in range(120):
        w = ["".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 14)))]
        v = [x for x in w if rng.random() > 0.1]
        at = int(rng.integers(len(v) + 1))
        v[at:at] = ["".join(rng.choice(list("abc"), 3))] * int(rng.integers(3))
        rows.append((" ".join(w), " ".join(v) or "z"))
    want = [distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6 for a, b in rows]
    assert judged(spark.createDataFrame(rows, "a string, b string").coalesce(1)) == want and 10 < sum(want) < 110


def test_similar_needs_as_many_words(spark):
    """Word by word costs only bound the distance if both lines have as many words."""
    a, b = "aaaaaaaaaa commonword anotherword yetanother finalwords quantities", "bbbbbb commonword anotherword yetanother finalwords quantities x y"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert distance(a, b) > 0.2 * max(len(a), len(b)) and not judged(df)[0]


def test_line_edges(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[9] == "" and got[4] != "" and len(got[7]) == 70000


def test_piecewise_similarity(spark):
    rng = np.random.default_rng(0)
    a = " ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(900))
    b = a.replace("aa", "xy")
    df = spark.createDataFrame([(a, b), (a, a[::-1]), ("", ""), ("abcde", "abcdx"), ("abcde", "abcxx")], "a string, b string")
    assert judged(df) == [True, False, True, True, False]


def test_long_lines_with_an_insertion(spark):
    """Text put in front of a long line moves every later piece, and does not count more than its length."""
    rng = np.random.default_rng(4)
    draw = lambda n: "".join(rng.choice(list("abcdef "), n))
    a, b = draw(6000), draw(20000)
    df = spark.createDataFrame([(a, draw(125) + a), (b, draw(309) + b), (a, draw(1499) + a), (a, draw(1501) + a), (a, draw(6000))], "a string, b string")
    assert judged(df) == [True, True, True, False, False]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    want = groups_by(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    least = {}
    for n, k in zip(nodes, want, strict=True):
        least.setdefault(k, n)
    assert got == {n: least[k] for n, k in zip(nodes, want, strict=True)}


def test_words_settle_what_characters_would(spark):
    """Lines of many words, with words replaced, moved, dropped and put in: the verdict is that of the distance in characters wherever half of the words agree."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 12))))
    rows = []
    for i in range(90):
        w = [word() for _ in range(int(rng.integers(16, 70)))]
        v = [word() if rng.random() < i / 250 else x for x in w]
        at, to = (int(x) for x in rng.integers(0, len(v), 2))
        v[at:at] = [v.pop(to)] if i % 3 else [word() for _ in range(i % 7)]
        rows.append((" ".join(w), " ".join(v)))

    def want(a, b):
        w, v = a.split(" "), b.split(" ")
        return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6 and distance(w, v) <= max(len(w), len(v)) // 2

    expected = [want(a, b) for a, b in rows]
    assert judged(spark.createDataFrame(rows, "a string, b string").coalesce(1)) == expected and 20 < sum(expected) < 80


def test_pairs_of_very_long_lines_take_seconds(spark):
    """Lines of a million characters are settled by the pairs of words they share, or of runs where they have no words."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(20000)])
    w = rng.choice(vocabulary, 150000)
    some, many = (np.where(rng.random(len(w)) < p, rng.choice(vocabulary, len(w)), w) for p in (0.1, 0.5))
    solid, other = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 200000)) for _ in range(2))
    rows = [(" ".join(w), " ".join(x)) for x in (some, many, w[:100000])] + [(solid, solid[:90000] + "another" + solid[90000:]), (solid[:30000], other[:30000])]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    began = time.perf_counter()
    got = {(r["n"], r["m"]) for r in line_dedup.alike(df.select(F.col("a").alias("norm"), F.col("b").alias("norm2"), F.length("a").alias("n"), F.length("b").alias("m"))).select("n", "m").collect()}
    assert got == {(len(a), len(b)) for a, b in (rows[0], rows[3])} and time.perf_counter() - began < 90


def test_one_template_is_dealt_into_bounded_parts(spark, monkeypatch):
    """Rows with one fingerprint and one key are ordered in many parts, and still all meet the first of them."""
    monkeypatch.setattr(linking, "PART", 20)
    rows = spark.range(900).select(F.col("id"), F.lit(7).cast("long").alias("fp"), F.array(F.lit(1).cast("long")).alias("keys"))
    pairs = linking.candidates(rows, rows.select("id", "fp"), 3)
    g = groups_by(900, [(r["id"], r["id2"]) for r in pairs.collect()])
    assert len(set(g)) == 1 and pairs.count() < 6 * 900


def test_a_letter_changed_in_every_word(spark):
    """Lines none of whose words agree are alike by the distance in characters, which alone decides."""
    rng = np.random.default_rng(17)
    for n in (16, 40, 200):
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(n)]
        other = [w[:4] + "z" + w[5:] for w in words]
        third = [w[:2] + "zyz" + w[5:] for w in words]
        df = spark.createDataFrame([(" ".join(words), " ".join(other)), (" ".join(words), " ".join(third))], "a string, b string")
        assert judged(df) == [True, False]


def test_slots_let_few_others_pass(spark):
    """With as many keys as a fifth of the slots, rows of other keys hardly pass, nor does any key get lost; nulls are no keys."""
    keys = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    rows = spark.range(400_000).select(F.when(F.col("id") < 399_990, F.xxhash64("id")).alias("key"))
    semi, anti = (common.in_slots(rows, "key", keys, how, "k") for how in ("left_semi", "left_anti"))
    assert semi.columns == ["key"] and 200_000 <= semi.count() < 202_000 and semi.where("key is null").count() == 0
    assert anti.count() == 400_000 - semi.count() and anti.join(keys, F.col("key") == F.col("k"), "left_semi").count() == 0


def test_crowds_lose_no_link(spark, monkeypatch):
    """Of a crowd, every pair within the radius and of like size that is not connected yet, whatever the order of fingerprints; groups that hold most of a crowd are not compared with themselves."""
    monkeypatch.setattr(linking, "CELL", 50)
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 1 << 62, 300, dtype=np.int64)
    fps = np.concatenate((fps, fps[:100] ^ ((1 << 61) | (1 << 31) | (1 << 3))))
    sizes = rng.integers(1, 40, len(fps))
    label = {i: 5 for i in range(40, 300, 2)}
    data = [(i, int(f), int(n)) for i, (f, n) in enumerate(zip(fps, sizes, strict=True))]
    rows = spark.createDataFrame(data, "id long, fp long, size int")
    crowds = rows.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "id").where("key = 1 or id < 350")
    near = linking.near(20) & (F.least("size", "size2") >= F.floor(F.greatest("size", "size2") * 0.8 - 1e-6))
    got = linking.unlinked(crowds, rows, spark.createDataFrame(list(label.items()), "id long, group long"), near, 0.8)
    found = [(min(r["id"], r["id2"]), max(r["id"], r["id2"]), r["key"]) for r in got.collect()]
    apart = lambda i, j: label.get(i, i) != label.get(j, j) and (data[i][1] ^ data[j][1]).bit_count() <= 20 and min(sizes[i], sizes[j]) >= int(max(sizes[i], sizes[j]) * 0.8 - 1e-6)
    want = {(i, j, k) for i in range(400) for j in range(i + 1, 400) for k in (1, 2) if (k == 1 or j < 350) and apart(i, j)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_alike_lines_of_a_crowd(spark):
    """Hundreds of unlike lines with the same middle, each with a twin that shares no rarer words with it: all twins within the radius go."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    texts = []
    for _ in range(150):
        a, b = word(), word()
        texts += [f"{a} every evening nobody {b}", f"z{a[1:]} every evening nobody {b[:-1]}z"]
    prints = [line_print(x) for x in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= line_dedup.WIDE and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-6]
    g = groups_by(len(texts), linked)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(linked) >= 100 and got == {i: x if g.index(g[i]) == i else "" for i, x in enumerate(texts)}


def test_near_texts_of_a_crowd(spark):
    """Texts that share a passage, and with it all of their smallest shingles: twins end in one group, others apart, as in a comparison of all pairs."""
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(60):
        w = [word() for _ in range(14)]
        rows += [(2 * k, f"{passage} {' '.join(w)}"), (2 * k + 1, f"{passage} {' '.join([*w[:7], word(), *w[8:]])}")]
    own = [sets(t) for _, t in rows]
    g = groups_by(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])])
    assert len(set(g)) == 60
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: g.index(g[i]) for i in range(len(rows))}
