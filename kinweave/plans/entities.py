"""A linkage universe over the documents table.

A record's name is the first six tokens of its text, its address the next twelve, its country the language. The smallest
id of a (country, name) leads its group; leaders whose id is not divisible by 4 are the reference side, everything else
the pool. A pool record belongs to its leader where that is on the reference side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import prepare
from ..operators.retrieval import Index


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, business_name, business_address, country)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    tokens = F.filter(F.split(clean, " "), lambda t: t != "")
    return docs.select("doc_id", "lang", tokens.alias("t")).select(
        F.col("doc_id").alias("id"),
        F.array_join(F.slice("t", 1, 6), " ").alias("business_name"),
        F.array_join(F.slice("t", 7, 12), " ").alias("business_address"),
        F.col("lang").alias("country"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with leader and is_ref."""
    own = records(spark, sf_dir)
    lead = own.groupBy("country", "business_name").agg(F.min("id").alias("leader"))
    same = own["country"].eqNullSafe(lead["country"]) & (own["business_name"] == lead["business_name"])
    return own.join(lead, same).select(own["*"], "leader").withColumn("is_ref", (F.col("id") == F.col("leader")) & (F.col("id") % 4 != 0))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prepared (reference, pool); kept, as every channel and feature reads them (``clearCache`` lets go)."""
    every = prepare(universe(spark, sf_dir), ascii_only=True).persist()
    return every.where("is_ref"), every.where("not is_ref")


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(*sides(spark, sf_dir))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, r) of every pool record that has an owner."""
    every = universe(spark, sf_dir)
    return every.where("not is_ref and leader % 4 <> 0").select(F.col("leader").alias("q"), F.col("id").alias("r"))
