"""Exact deduplication through the keyed state of a streaming query.

Keys are SHA-256 digests of the normalised text. The state keeps, per key and without expiry, the stable identifier and
the content locator (file) of the row that stays and the number of rows; it lives in RocksDB on the executors' disks
and in the checkpoint folder. Rows that hit a key are compared by full bytes, and digests whose texts differ are
regrouped by the texts themselves. DataFrame functions only.

Defined results: null text counts as empty; a null id comes after the other ids of its length; repeated rows are
counted each and all carry the same answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, join_hot, narrow

BLANKS = r"[\x20\x09-\x0D]+"
#: State in RocksDB; many small stores shouldn't each reserve megabytes of disk beforehand.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share this much memory, however many partitions it holds
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Rows of one group whose bytes one task compares at a time.
SALT_ROWS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _best() -> Column:
    """Largest length, then smallest id (its complement grows as it falls); the locator rides along."""
    return F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("rank"), "locator"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful core, for any stream of (digest, doc_id, n_chars, locator): one live row per digest."""
    return stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))


def _run_state(spark: SparkSession, scratch: Scratch, keyed: DataFrame, trigger_bytes: int) -> DataFrame:
    """Feeds the staged rows through the stateful query in micro-batches and reads its final state back."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(keyed.schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(scratch.at("keyed"))
        query = (
            keyed_state(source).writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", scratch.at("state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(scratch.at("state"))
        best, count = (f"value.`{c}`" for c in state.schema["value"].dataType.names)
        return scratch.save(
            state.select(
                F.col("key.digest").alias("digest"),
                F.bitwise_not(F.col(f"{best}.rank")).alias("keep_id"),
                F.col(f"{best}.locator").alias("keep_locator"),
                F.col(count).cast("long").alias("group_size"),
            ),
            "groups",
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    trigger_bytes: int = 256 << 20,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = narrow(docs, id_col, text_col)
    keyed = scratch.save(
        rows.select(
            "doc_id",
            F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            digest(normalised(F.col("text"))).alias("digest"),
            F.input_file_name().alias("locator"),
        ),
        "keyed",
    )
    if keyed.isEmpty():
        groups = scratch.save(spark.createDataFrame([], "digest string, keep_id long, keep_locator string, group_size long"), "groups")
    else:
        groups = _run_state(spark, scratch, keyed, trigger_bytes)
        scratch.drop("state")
        give_back(spark, workers=False)
    slim = keyed.select("doc_id", "n_chars", "digest")
    found = scratch.save(join_hot(slim, groups.withColumn("n", F.col("group_size")), ["digest"], "n"), "found")
    scratch.drop("keyed", "groups")

    # rows of a group are read again by their id, or by their digest where they have none, and compared in salted parts
    hits = found.where("group_size > 1")
    salt = F.pmod(F.xxhash64("doc_id", "n_chars"), F.greatest(F.lit(1), F.ceil(F.col("group_size") / SALT_ROWS)).cast("long"))
    seen = hits.select(F.coalesce("doc_id", F.xxhash64("digest")).alias("key"), "digest", salt.alias("salt")).distinct()
    body = normalised(F.col("text"))
    whole = rows.select(F.coalesce("doc_id", F.xxhash64(digest(body))).alias("key"), body.alias("body")).join(seen, "key")
    whole = whole.where(digest(F.col("body")) == F.col("digest"))
    part = whole.groupBy("digest", "salt").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    differ = part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    clash = scratch.save(differ.select("digest"), "clash")
    if not clash.isEmpty():
        found = scratch.save(_regroup(rows, found, clash, digest), "regrouped")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "keep_locator",
    )


def _regroup(rows: DataFrame, found: DataFrame, clash: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the texts."""
    body = normalised(F.col("text"))
    sound = found.join(clash, "digest", "left_anti")
    bodies = rows.select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        digest(body).alias("digest"), F.input_file_name().alias("locator"), body.alias("body"),
    ).join(clash, "digest", "left_semi")
    best = bodies.groupBy("digest", "body").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = best.select("digest", "body", F.bitwise_not("best.rank").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
    again = bodies.drop("locator").join(best, ["digest", "body"])
    return sound.unionByName(again.select(sound.columns))
