"""A training-corpus pipeline over the documents table.

Toxic documents go, then exact copies, then near copies (five-word shingles, similarity 0.8 or more, the smallest id of a
group stays); sources, languages and topics are mixed to their target weights; what is left is packed into sequences.
Every stage reads the whole table that the one before wrote. Each row is judged by itself: rows without an id come after
all others, texts that share an id are different documents, and repeated rows count as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import exact_dedup, minhash, mixing, packing, toxicity
from kinweave.llm.common import Scratch, give_back, partitions, table, text_bytes
from kinweave.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows with a column _row of their own, in the order of ids, null last: the id itself where ids are unique."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = partitions(spark, text_bytes(docs, "text"))
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return Scratch(spark, "keyed").save(dealt.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _without(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that an operator, which had _row as their id, keeps."""
    gone = found.where("not kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(gone, "_row", "left_anti").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    network = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    give_back(spark)
    return toxicity.keep_clean(docs, network)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark, workers=False)
    keyed = _keyed(spark, docs)
    return _without(keyed, exact_dedup.exact_dedup(keyed, id_col="_row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, docs)
    return _without(keyed, minhash.near_duplicates(keyed, width=5, per_hundred=80, id_col="_row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw goes by id (by text without one) and is held against a cell's probability, so rows go by draw and cell."""
    give_back(spark, workers=False)
    keys = ("draw", *mixing.AXES)
    gone = mixing.mix(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), *[F.col(a).alias(f"gone_{a}") for a in keys]).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = {a: F.coalesce(docs[a].cast("string"), F.lit("")) for a in ("source", "lang")} | {"topic": mixing.surface_topic(text)}
    own["draw"] = mixing.uniform(docs["doc_id"].cast("long"), text, mixing.SEED)
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"])
    for axis in keys:
        same = same & (own[axis] == gone[f"gone_{axis}"])
    return docs.join(gone, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network decides the first stage, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
