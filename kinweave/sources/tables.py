"""Sources and sinks of linkage: record tables, truth tables, id lists, stage caches, contract checks, subsets."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SOURCE = StructType([StructField(c, StringType()) for c in COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def _tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    head = spark.read.text(path).first()
    if head is None or head[0].rstrip("\r").split("\t") != schema.names:
        raise ValueError(f"{path}: columns must be {schema.names}")
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", True).csv(path)
    return rows.na.fill("")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records: text only, no quoting, empty rather than null."""
    return _tsv(spark, path, SOURCE)


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(reference, pool): source 1, and sources 2 and 3 with their number in src."""
    parts = [read_source(spark, f"{folder}/{split}_source{k}.tsv") for k in (1, 2, 3)]
    numbered = [df.withColumn("src", F.lit(k).cast("byte")) for k, df in zip((2, 3), parts[1:])]
    return parts[0], numbered[0].unionByName(numbered[1])


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs (q, r), queries (q)): records without a match are in the second table only."""
    raw = _tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("q"), F.split("matched_entity_ids", ",").alias("ids"))
    pairs = raw.select("q", F.explode("ids").alias("r")).select("q", F.trim("r").alias("r")).where("r <> ''").distinct()
    return pairs, raw.select("q")


def cached(df_or_make, path: str, spark: SparkSession) -> DataFrame:
    """A stage's table: read if it is there, else made and written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        made = df_or_make() if callable(df_or_make) else df_or_make
        made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's stages: under ``spark.checkpoint.dir``, else beside the warehouse; both are shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_kinweave_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Home:
    """A folder of tables for one operator, under ``spark.checkpoint.dir``, else beside the warehouse (both are shared; a
    local session without the first has a temporary one); it goes when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        local = spark.sparkContext.master.split("[")[0] == "local" and not spark.conf.get("spark.checkpoint.dir", None)
        self.path = "file://" + tempfile.mkdtemp(prefix=f"kinweave-{name}-") if local else work_folder(spark, name)
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session may be gone already
            if self.path.startswith("file:///tmp/"):
                shutil.rmtree(self.path[len("file://") :], ignore_errors=True)

    def at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def release(self) -> None:
        """Lets the driver drop finished jobs, so that executors delete their shuffle files; else these stay for the whole query."""
        self.spark._jvm.System.gc()

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(table))
        self.release()
        return self.spark.read.schema(df.schema).parquet(self.at(table))


def id_lists(refs: DataFrame, pairs: DataFrame, order: str = "rank", header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """One row per reference record: its pool ids, comma-joined in order, each once; empty without any."""
    first = pairs.groupBy("q", "r").agg(F.min(order).alias("_o"))
    lists = first.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "r"))), lambda s: s["r"].cast("string")), ",").alias("_ids"))
    return refs.select("q").join(lists, "q", "left").select(F.col("q").alias(header[0]), F.coalesce("_ids", F.lit("")).alias(header[1]))


def write_id_lists(lists: DataFrame, path: str, order: str) -> None:
    """A tab-separated text sink in the order of a column of the lists; the header is the first line of the first part."""
    a, b = [c for c in lists.columns if c != order][:2]
    rows = lists.select(F.lit(1).alias("_k"), F.col(order).alias("_o"), F.concat_ws("\t", F.col(a).cast("string"), F.col(b)).alias("value"))
    head = lists.sparkSession.range(1).select(F.lit(0).alias("_k"), F.lit(None).cast(dict(lists.dtypes)[order]).alias("_o"), F.lit(f"{a}\t{b}").alias("value"))
    head.unionByName(rows).orderBy("_k", "_o").select("value").write.mode("overwrite").text(path)


def fingerprint(df: DataFrame) -> tuple:
    """Number of rows and a sum over their hashes, whatever their order."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def contract_checks(lists: DataFrame, refs: DataFrame, pool: DataFrame) -> DataFrame:
    """(check, violations) of an id-list table: unique and complete references, no repeated or unknown ids."""
    key, ids = lists.columns[:2]
    own = lists.select(F.col(key).alias("q"), F.filter(F.split(ids, ","), lambda x: x != "").alias("ids"))
    listed = own.select("q", F.explode("ids").alias("r"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    parts = [
        count(own.groupBy("q").count().where("count > 1"), "repeated reference"),
        count(refs.select("q").join(own, "q", "left_anti"), "missing reference"),
        count(own.join(refs.select("q"), "q", "left_anti"), "unknown reference"),
        count(own.where("size(ids) <> size(array_distinct(ids))"), "repeated id"),
        count(listed.join(pool.select(F.col("id").cast("string").alias("r")), "r", "left_anti"), "unknown id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def subset(refs: DataFrame, pool: DataFrame, truth: DataFrame, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A smaller universe: a share of the references with all their matches, and the same share of unowned pool records."""
    chosen = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    ours = refs.where(chosen("id"))
    mine = truth.join(ours.select(F.col("id").alias("q")), "q", "left_semi").select(F.col("r").alias("id"))
    lone = pool.join(truth.select(F.col("r").alias("id")), "id", "left_anti").where(chosen("id"))
    return ours, pool.join(mine, "id", "left_semi").unionByName(lone)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """Metrics of a run as one line of JSON, in a folder that the whole cluster sees."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def first_seen(pairs: DataFrame, order: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(order, "r")))
