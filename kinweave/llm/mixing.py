"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to the three marginals in turn, never above what a cell
has; a document is then drawn with its cell's ratio of raked to present tokens. DataFrame functions only. The table of
cells has one row per combination of categories, however many documents there are.

Raking stops when a block of passes moves no weight any more, or after ``rounds`` passes; ``residuals`` says what the
marginals are then (a category that has fewer tokens than its target can't meet it and gets all it has).

Defined results: null source, language or text count as ''; documents without tokens take part with probability 1 where
their cell has no tokens at all; equal ids draw equal numbers, and rows without an id draw by their text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, narrow

AXES = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
SEED = 7
#: Cells above which the table of probabilities isn't broadcast.
BROADCAST_CELLS = 50_000


def surface_topic(text: Column) -> Column:
    """A coarse topic by the look of a text; any column may stand in for it."""
    return (
        F.when(text.contains("|"), "table")
        .when(text.contains("icense") | text.contains("opyright"), "legal")
        .when(F.length(F.regexp_replace(text, "[^0-9]", "")) * 20 > F.length(text), "record")
        .when(F.length(text) < 600, "short")
        .otherwise("prose")
    )


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id, or on the text of a row without one."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.encode(text, "UTF-8"))))
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**12))


def _total(df: DataFrame, value: str | Column) -> float:
    """The one number that a sum over cells or categories is."""
    return float(df.agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0])


def tempered(cells: DataFrame, axis: str, power: float, total: float) -> DataFrame:
    """Target shares of an axis: present shares to a power below 1, which lifts small categories."""
    present = cells.groupBy(axis).agg(F.sum("tokens").alias("own"))
    flat = present.select(axis, F.pow(F.col("own") / F.lit(max(total, 1.0)), F.lit(power)).alias("flat"))
    return flat.select(axis, (F.col("flat") / F.lit(max(_total(flat, "flat"), 1e-300))).alias(f"{axis}_share"))


def rake(scratch: Scratch, cells: DataFrame, budget: float, rounds: int, total: float, each: int = 4, tolerance: float = 1e-12) -> DataFrame:
    """Cells with a column weight, 0 to tokens, after passes over the marginals; lineage is cut after each block of them."""
    cells = cells.withColumn("want", F.lit(total * budget)).withColumn("weight", F.col("tokens") * F.lit(budget))
    cells = cells.withColumn("before", F.col("weight"))
    for k in range(rounds):
        for axis in AXES:
            have = F.sum("weight").over(W.partitionBy(axis))
            scale = F.when(have > 0, F.col(f"{axis}_share") * F.col("want") / have).otherwise(0.0)
            cells = cells.withColumn("weight", F.least(F.col("tokens"), F.col("weight") * scale))
        if k % each == each - 1 or k == rounds - 1:
            cells = scratch.save(cells, f"raked{k}")
            moved = cells.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
            cells = cells.withColumn("before", F.col("weight"))
            if moved <= tolerance * total:
                break
    return cells


def residuals(raked: DataFrame) -> DataFrame:
    """(axis, category, tokens, wanted, weight): every marginal of raked cells beside its target."""
    each = []
    for axis in AXES:
        wanted = F.first(F.col(f"{axis}_share") * F.col("want"))
        each.append(raked.groupBy(F.lit(axis).alias("axis"), F.col(axis).alias("category")).agg(F.sum("tokens").alias("tokens"), wanted.alias("wanted"), F.sum("weight").alias("weight")))
    return reduce(DataFrame.union, each)


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    budget: float = 0.8,
    power: float = 0.7,
    rounds: int = 12,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, probability, draw, kept.

    ``targets`` maps an axis to shares by category (categories left out get none); axes without targets are tempered.
    ``budget`` is the share of all tokens to keep. ``topic`` is a column over ``text``.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = narrow(docs, id_col, text_col, **{source_col: "source", lang_col: "lang"})
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (surface_topic(F.col("text")) if topic is None else F.coalesce(topic, F.lit(""))).alias("topic"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"),
        uniform(F.col("doc_id"), F.col("text"), seed).alias("draw"),
    )
    rows = scratch.save(rows, "rows")
    raked = raked_cells(scratch, rows, targets, budget, power, rounds)
    odds = raked.select(*AXES, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("probability"))
    if odds.count() <= BROADCAST_CELLS:
        odds = F.broadcast(odds)
    return rows.join(odds, list(AXES)).select("doc_id", *AXES, "n_tokens", "probability", "draw", (F.col("draw") < F.col("probability")).alias("kept"))


def raked_cells(scratch: Scratch, rows: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, power: float, rounds: int) -> DataFrame:
    """Cells of (source, lang, topic, n_tokens) with tokens, target shares and raked weight."""
    cells = rows.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells = scratch.save(cells, "cells")
    total = _total(cells, "tokens")
    shares = cells
    for axis in AXES:
        if targets and axis in targets:
            whole = sum(targets[axis].values()) or 1.0
            wanted = cells.sparkSession.createDataFrame([(k, float(v) / whole) for k, v in targets[axis].items()], f"{axis} string, {axis}_share double")
        else:
            wanted = tempered(cells, axis, power, total)
        shares = shares.join(wanted, axis, "left").fillna(0.0, [f"{axis}_share"])
    return rake(scratch, shares, budget, rounds, total)
