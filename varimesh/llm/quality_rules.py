"""Quality rules: plain counts, and a hashed n-gram likelihood ratio between a trusted corpus and the raw one.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over buckets is counted on all raw documents, another on the
trusted ones; a document's score is the mean log ratio of the two over its n-grams, so its length does not matter. A
fixed threshold on the score decides every document alike. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, labels, saved, whole_text

BUCKETS = 1 << 16
#: Mean log ratio, in nats an n-gram, under which a document is taken for junk.
THRESHOLD = -0.09
SYMBOLS = "#*$%&|<>"
WORD = "[^\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside a window of three that the text holds twice or more, each word once.

    Hashes of the windows are sorted, so equal ones stand together; only texts with such a pair sort the windows' own strings with their
    places. That is n log n in the length, for any text. (A pair of hashes could be equal by chance; the strings then settle it.)
    """
    w = F.col("w")
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(1), F.col("n_words").cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("hashes", F.sort_array(F.transform(places, lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1]))))
    twice = F.exists(F.transform(F.col("hashes"), lambda h, k: h == F.get("hashes", k - 1)), lambda same: same)
    df = df.withColumn("twice", F.coalesce(twice, F.lit(False))).drop("hashes")
    windows = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", w[i - 1], w[i], w[i + 1]).alias("g"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.col("twice"), windows).otherwise(F.array().cast("array<struct<g:string,i:int>>"))).drop("twice")
    s = F.col("sorted")
    # get() is null outside the array
    found = F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"]), e["i"]))
    df = df.withColumn("found", F.sort_array(F.array_compact(found))).drop("sorted")
    at = F.col("found")
    new = F.aggregate(
        F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda total, x: total + x
    )
    return df.withColumn("n_repeat_words", new).drop("found")


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with its words ``w`` and the plain counts; null text has no words."""
    text = whole_text()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    df = docs.select("doc_id", words(text).alias("w"), lines.alias("lines"), text.alias("t"))
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.translate("t", SPACE, "")).cast("long"),
            "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    return _repeat_words(df.drop("lines", "t"))


def grams(df: DataFrame, *keep: str, n: int = BUCKETS) -> DataFrame:
    """A row for each word with its bucket ``one`` and, but for the last word, that of the pair with the next, ``two``; one empty row without words."""
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    rows = df.select(*keep, F.explode_outer(pairs).alias("g")).select(*keep, F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    one, two = F.when(F.col("a").isNotNull(), bucket("a")), F.when(F.col("b").isNotNull(), bucket("a", "b"))
    return rows.select(*keep, one.alias("one"), two.alias("two"))


def ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> DataFrame:
    """``(bucket, ratio)``: log of the trusted over the raw probability, both with one added to each of the ``n`` buckets.

    Counted over all documents; ``trusted`` holds a bounded number of distinct ``doc_id`` values, as it is sent to every task. A row
    for each bucket that occurs: at most ``n``.
    """
    marked = docs.select("doc_id", words(whole_text()).alias("w")).join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    buckets = grams(marked, "good", n=n).select("good", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
    c = saved(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")))
    total = c.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    ratio = F.log((F.col("good") + 1) / (total["good"] + n)) - F.log((F.col("raw") + 1) / (total["raw"] + n))
    return c.select("bucket", ratio.alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, ``score``, ``base_failed`` and ``kept`` for every row of ``docs``.

    A text without words has score 0 and fails on its length. Rows that repeat an id are judged each for itself; with no
    trusted document the ratios say nothing and only the counts decide; an empty table gives no rows.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = saved(ratios(docs, trusted, n), 1)
    rows = counts(docs).withColumn("row", F.monotonically_increasing_id())
    parts = grams(rows, "row", "doc_id", *base, n=n)
    for c in ("one", "two"):
        parts = parts.join(F.broadcast(table.select(F.col("bucket").alias(c), F.col("ratio").alias(f"r_{c}"))), c, "left")
    known = F.count("r_one") + F.count("r_two")
    total = F.coalesce(F.sum("r_one"), F.lit(0.0)) + F.coalesce(F.sum("r_two"), F.lit(0.0))
    scored = parts.groupBy("row", "doc_id", *base).agg((total / F.greatest(known, F.lit(1))).alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.col("score") >= threshold if trusted.take(1) else F.lit(True)
    return scored.select("doc_id", *base, failed.alias("base_failed"), (~failed & good).alias("kept"), "score")


def query(spark, sf_dir: str, most_trusted: int = 40_000) -> DataFrame:
    """The trusted documents are those labelled as of good quality, at most ``most_trusted`` of them, by hashed id."""
    trusted = labels(spark, sf_dir).where("quality = 1").select("doc_id").distinct()
    return judge(documents(spark, sf_dir), trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted))
