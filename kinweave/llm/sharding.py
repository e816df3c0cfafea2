"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first (a matrix with the exact row and column sums, each
row multivariate hypergeometric given those before it). Every partition permutes its rows and deals them by its matrix
row, the rows are exchanged, and every shard permutes what it got.

Defined results: null text has no bytes and counts 8; null and repeated ids are rows like any other; equal texts are
dealt independently, as a uniform shuffle asks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, narrow

#: Rows that one task permutes within a shard.
BLOCK_ROWS = 250_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: exact sums both ways, distributed as under a uniform shuffle."""
    total = int(sum(counts))
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest = n
        pool = int(left.sum())
        for s in range(shards):
            if rest == 0:
                break
            mine = int(left[s])
            pool -= mine
            out[p, s] = drawn = _hypergeometric(rng, mine, pool, rest)
            rest -= drawn
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from good + bad are good, for populations of any size.

    Populations beyond numpy's limit are drawn by inversion outward from the mode, some standard deviations of steps.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    up = down = math.exp(log(good, mode) + log(bad, n - mode) - log(good + bad, n))
    x = y = mode
    left = rng.random() - up
    while left > 0 and (x < high or y > low):
        if x < high:
            up *= (good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))
            x += 1
            left -= up
            if left <= 0:
                return x
        if y > low:
            down *= y * (bad - n + y) / ((good - y + 1) * (n - y + 1))
            y -= 1
            left -= down
            if left <= 0:
                return y
    return mode


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot; slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    rows = narrow(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.save(rows, "rows")  # partitions are fixed from here on, whatever is read again
    # one number for each input partition comes to the driver
    counts = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    deal = spark.createDataFrame([(p, np.cumsum(m).tolist()) for p, m in zip(parts, matrix)], "part int, upto array<bigint>")

    local = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "row"), "row")) - 1
    dealt = rows.withColumn("at", local).join(F.broadcast(deal), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("at"))).cast("int"))

    total = sum(counts.values())
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    again = F.xxhash64(F.lit(seed + 1), "row")
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(again, F.lit(blocks)).cast("int").alias("block"))
    dealt = scratch.save(dealt, "dealt")
    scratch.drop("rows")
    sizes = dealt.groupBy("shard", "block").count()
    first = F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("shard", "block", F.coalesce(first, F.lit(0)).alias("first"))
    order = W.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row")
    placed = dealt.withColumn("at", F.row_number().over(order) - 1).join(sizes, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes whole rows as Parquet under shard=N/, in slot order, and returns them read back; a row goes by its number, not its id."""
    scratch = Scratch(docs.sparkSession, "write_shards")
    numbered = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # numbers are fixed from here on
    placed = shard_rows(numbered, shards, seed, "_row", text_col).select(F.col("doc_id").alias("_row"), "shard", "slot")
    numbered.join(placed, "_row").drop("_row").repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    scratch.drop("numbered")
    return docs.sparkSession.read.parquet(path)
