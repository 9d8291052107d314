"""Exact deduplication as a stateful stream.

Each arriving text is reduced to the SHA-256 of its normalised form. A streaming aggregation keyed by that digest keeps, in the disk-backed
state store and without any expiry, the digest, the stable id of the row that stays, and where its content lies (file and length). The stream takes all
files that are there and stops; run again with the same checkpoint it takes only new files, so the state carries over. Every hit
is then checked: the whole normalised text is compared with that of the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, in_slots, saved, shared_dir, whole_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(column: str = "text") -> Column:
    """The text without any ASCII white space; null counts as empty."""
    text = whole_text(column)
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best() -> Column:
    """Most code points, then smallest id: the largest of these structs. A null id comes last."""
    return F.struct(F.length(whole_text()).alias("n_chars"), (-F.col("doc_id")).alias("order"), F.col("locator"))


def run_stream(spark: SparkSession, path: str, checkpoint: str, digest=sha, files_per_batch: int | None = None) -> DataFrame:
    """Bring the keyed state up to date with the files at ``path`` and return it: ``(digest, keep_id, locator, group_size)``.

    ``path`` is a parquet file or folder with ``doc_id`` and ``text``; other columns are not read.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # Written as a pattern, the path may name a single file too.
    rows = stream.parquet(f"{path[:-1]}[{path[-1]}]").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("locator")
    )
    state = (
        rows.select(digest(normalised()).alias("digest"), _best().alias("best"))
        .groupBy("digest")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    settings = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes of disk
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_state(spark, checkpoint)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as the last batch left it, a row for each digest."""
    held = spark.read.format("statestore").load(checkpoint)
    best = F.col(f"value.{held.schema['value'].dataType.fieldNames()[0]}")
    size = F.col(f"value.{held.schema['value'].dataType.fieldNames()[1]}")
    return held.select(
        F.col("key.digest").alias("digest"), (-best["order"]).alias("keep_id"), best["locator"].alias("locator"), size.alias("group_size")
    )


def deduplicate(spark: SparkSession, path: str, digest=sha, checkpoint: str | None = None, rows_per_salt: int = 2000) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` for every row at ``path``.

    Of equal texts the row with the most code points stays, then the smallest id. Rows that repeat an id count each; if such rows
    are the ones that stay, each is marked kept. A null text is empty, a null id stays only where all ids of its group are null, and
    an empty table gives no rows. Should two different texts ever share a digest, the check finds it and that
    digest's rows are grouped by their full texts.
    """
    docs = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("locator"))
    if not docs.take(1):
        return docs.select("doc_id", F.lit("").alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    state = saved(run_stream(spark, path, checkpoint or shared_dir(spark), digest).withColumnRenamed("locator", "keep_at"), few=True)
    rows = docs.select("doc_id", digest(normalised()).alias("digest"))
    found = saved(rows.join(state.drop("keep_at"), "digest"), few=True)

    # The check: only rows of groups of two or more, those without an id too, are fetched with their texts, once. The text that stays is that of
    # the kept id at the kept locator; it is dealt to as many salts as its group's size asks for, so no group meets in one task.
    hits = state.where("group_size > 1").select("digest", "keep_id", "keep_at", F.ceil(F.col("group_size") / rows_per_salt).cast("int").alias("salts"), F.xxhash64("digest").alias("slot_of"))
    texts = docs.withColumn("digest", digest(normalised())).withColumn("slot_of", F.xxhash64("digest"))
    texts = in_slots(texts, "slot_of", hits, "left_semi").drop("slot_of").join(hits.drop("slot_of"), "digest")
    texts = saved(texts.select("doc_id", "locator", "digest", "keep_id", "keep_at", "salts", normalised().alias("own_text")))
    own = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).where("locator = keep_at").dropDuplicates(["digest"])
    keepers = own.select("digest", F.col("own_text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    copies = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"))
    wrong = copies.join(keepers, ["digest", "salt"]).where("own_text <> kept_text").select("digest").distinct()
    wrong = saved(wrong, few=True)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = found.withColumn("kept", kept)
    if wrong.take(1):
        apart = docs.withColumn("digest", digest(normalised())).join(wrong, "digest", "left_semi")
        apart = apart.select("doc_id", "digest", normalised().alias("own_text"), F.struct(F.length(whole_text()).alias("n_chars"), (-F.col("doc_id")).alias("order")).alias("best"))
        groups = apart.groupBy("own_text").agg((-F.max("best")["order"]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(groups, "own_text").withColumn("kept", kept)
        out = out.join(wrong, "digest", "left_anti").select("doc_id", "digest", "keep_id", "group_size", "kept").unionByName(
            apart.select("doc_id", "digest", "keep_id", "group_size", "kept")
        )
    return out.select("doc_id", "digest", "keep_id", "group_size", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


#: The same rows in plain SQL.
SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS k,
      count(*) OVER (PARTITION BY text_sha256) AS group_size,
      first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
