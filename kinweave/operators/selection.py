"""Which scored pairs to keep: exclusivity, thresholds, expected F0.5, and their tuning. Pairs are (q, r, p, ...)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metric import f05

# --- fixed values: grids ---
TUNE_GRID = [round(0.2 + 0.05 * k, 2) for k in range(16)]
STUDY_GRID = [round(0.3 + 0.025 * k, 3) for k in range(25)]
C_GRID = [0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.4]
W0_GRID = [0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0]
# ---------------------------


@dataclass(frozen=True)
class Rule:
    """A selection rule; thr for "threshold", the others for "expf"."""

    method: str = "threshold"
    thr: float = 0.5
    c: float = 1.0
    w0: float = 1.0
    floor: float = 0.0


def won(score: str = "p") -> Column:
    """Whether a pair is the best of its pool record; ties go to the smaller query."""
    return F.row_number().over(W.partitionBy("r").orderBy(F.desc(score), "q")) == 1


def expected_f(pairs: DataFrame, c: float = 1.0, w0: float = 1.0, score: str = "p", by: tuple[str, ...] = ("q",)) -> DataFrame:
    """Adds keep: the prefix of a query's pairs with the highest expected F0.5, if that beats keeping none."""
    group = W.partitionBy(*by)
    order = group.orderBy(F.desc(score), "r").rowsBetween(W.unboundedPreceding, 0)
    k = F.row_number().over(group.orderBy(F.desc(score), "r"))
    ef = 1.25 * F.sum(score).over(order) / (0.25 * F.lit(c) * F.sum(score).over(group) + k)
    capped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1 - 1e-7))
    none = F.lit(w0) * F.exp(F.sum(F.log1p(-capped)).over(group))
    out = pairs.withColumns({"_k": k, "_ef": F.coalesce(ef, F.lit(0.0)), "_none": none})
    out = out.withColumn("_best", F.max("_ef").over(group))
    out = out.withColumn("_kb", F.min(F.when(F.col("_ef") >= F.col("_best"), F.col("_k"))).over(group))
    return out.withColumn("keep", (F.col("_k") <= F.col("_kb")) & (F.col("_best") > F.col("_none"))).drop("_k", "_ef", "_none", "_best", "_kb")


def select(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that a rule keeps; exclusivity comes first, over all pairs."""
    if rule.method == "threshold":
        return pairs.withColumn("_won", won()).where(F.col("_won") & (F.col("p") >= rule.thr)).drop("_won")
    eff = pairs.withColumn("_q", F.when(won(), F.col("p")).otherwise(0.0))
    return expected_f(eff, rule.c, rule.w0, "_q").where(F.col("keep") & (F.col("_q") >= rule.floor)).drop("keep", "_q")


def tune_threshold(pairs: DataFrame, truth: DataFrame, refs: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """(thr, macro_f05) of every threshold of a grid, in one aggregation."""
    thresholds = F.explode(F.array(*[F.lit(float(t)) for t in grid or TUNE_GRID]))
    kept = pairs.withColumn("_won", won()).where("_won").withColumn("thr", thresholds).where(F.col("p") >= F.col("thr"))
    hits = kept.join(truth.withColumn("_true", F.lit(1)), ["q", "r"], "left")
    found = hits.groupBy("thr", "q").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_true").alias("tp"))
    sizes = refs.join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true")), "q", "left").fillna(0, ["n_true"])
    every = sizes.withColumn("thr", thresholds).join(found, ["thr", "q"], "left").fillna(0, ["n_pred", "tp"])
    return every.groupBy("thr").agg(F.round(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("macro_f05"))


def best_rule(pairs: DataFrame, truth: DataFrame, refs: DataFrame) -> tuple[Rule, list[tuple[Rule, float]]]:
    """Compares thresholds with expected-F rules. The grids are small and every score comes from aggregations; of equal
    scores thresholds come first, then the order of the grids. Calibrated scores are the caller's.

    A value of c decides a query's prefix, w0 only whether it is kept; so pairs are read once and the grid is spread over
    queries, not over pairs.
    """
    table = [(Rule("threshold", thr=r["thr"]), r["macro_f05"]) for r in tune_threshold(pairs, truth, refs, STUDY_GRID).orderBy("thr").collect()]
    eff = pairs.select("q", "r", F.when(won(), F.col("p")).otherwise(0.0).alias("_q"))
    hits = eff.join(truth.select("q", "r", F.lit(1).alias("_true")), ["q", "r"], "left")
    group = W.partitionBy("q")
    order = group.orderBy(F.desc("_q"), "r").rowsBetween(W.unboundedPreceding, 0)
    capped = F.least(F.greatest(F.col("_q"), F.lit(0.0)), F.lit(1 - 1e-7))
    placed = hits.select(
        "q", F.row_number().over(group.orderBy(F.desc("_q"), "r")).alias("k"), F.sum("_q").over(order).alias("s"), F.sum("_q").over(group).alias("t"),
        F.count("_true").over(order).alias("tp"), F.exp(F.sum(F.log1p(-capped)).over(group)).alias("none"),
    )
    ef = lambda c: F.coalesce(1.25 * F.col("s") / (0.25 * F.lit(c) * F.col("t") + F.col("k")), F.lit(0.0))
    prefix = [F.max(F.struct(ef(c).alias("ef"), (-F.col("k")).alias("k"), "tp")).alias(f"c{n}") for n, c in enumerate(C_GRID)]  # the shortest of the best
    found = placed.groupBy("q").agg(F.max("none").alias("none"), *prefix)
    sizes = refs.select("q").join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true")), "q", "left").fillna(0, ["n_true"])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"c{n}").alias("best")) for n, c in enumerate(C_GRID)])).alias("g")
    every = sizes.join(found, "q", "left").select("n_true", "none", each).select("n_true", "none", "g.c", "g.best", F.explode(F.array(*map(F.lit, W0_GRID))).alias("w0"))
    kept = F.col("best.ef") > F.col("w0") * F.col("none")
    f = f05(F.when(kept, F.col("best.tp")).otherwise(0), F.when(kept, -F.col("best.k")).otherwise(0), F.col("n_true"))
    scores = {(r["c"], r["w0"]): r["f"] for r in every.groupBy("c", "w0").agg(F.round(F.avg(f), 6).alias("f")).collect()}
    table += [(Rule("expf", c=c, w0=w), scores[c, w]) for c in C_GRID for w in W0_GRID]
    table.sort(key=lambda x: -x[1])
    return table[0][0], table


def shift_logit(p: Column, delta: float | Column) -> Column:
    z = F.log(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)) / F.least(F.greatest(1 - p, F.lit(1e-7)), F.lit(1.0)))
    return 1 / (1 + F.exp(-(z + delta)))


def logit(p: Column) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / F.least(F.greatest(1 - p, F.lit(1e-6)), F.lit(1.0)))


def count_match(pairs: DataFrame, refs: DataFrame, thr: float, target: float) -> DataFrame:
    """(country, delta): the logit shift that makes a country keep ``target`` pairs a reference record under a threshold.

    A shift changes no order, so it follows from one order statistic: the wanted number of winners' logits.
    """
    sizes = refs.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    winners = pairs.withColumn("_won", won()).where("_won").join(refs.select("q", "country"), "q")
    # scores have six decimals, so a country has a bounded number of different ones
    counted = winners.groupBy("country", F.round(logit(F.col("p")), 6).alias("z")).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(W.partitionBy("country").orderBy(F.desc("z")).rowsBetween(W.unboundedPreceding, 0))
    want = F.greatest(F.lit(1), F.round(F.col("n") * target))
    cut = counted.withColumn("_upto", upto).join(sizes, "country").where((F.col("_upto") >= want) & (F.col("_upto") - F.col("_m") < want))
    edge = math.log(thr / (1 - thr))
    return cut.select("country", F.round(F.lit(edge) - F.col("z"), 6).alias("delta"))


def count_match_rule(pairs: DataFrame, refs: DataFrame, rule: Rule, target: float, steps: int = 22) -> DataFrame:
    """(country, delta) for any rule: closed for a threshold, else by halving an interval of shifts for all countries at
    once; the driver holds one interval a country."""
    if rule.method == "threshold":
        return count_match(pairs, refs, rule.thr, target)
    spark = pairs.sparkSession
    sizes = {r["country"]: r["count"] for r in refs.groupBy("country").count().collect()}
    own = pairs.join(refs.select("q", "country"), "q").persist()
    span = {c: (-8.0, 8.0) for c in sizes}
    for _ in range(steps):
        middle = spark.createDataFrame([(c, (lo + hi) / 2) for c, (lo, hi) in span.items()], "country string, delta double")
        moved = own.join(F.broadcast(middle), "country").withColumn("p", shift_logit(F.col("p"), F.col("delta")))
        kept = {r["country"]: r["count"] for r in select(moved, rule).groupBy("country").count().collect()}
        for c, (lo, hi) in span.items():
            half = (lo + hi) / 2
            span[c] = (lo, half) if kept.get(c, 0) > sizes[c] * target else (half, hi)
    own.unpersist()
    return spark.createDataFrame([(c, (lo + hi) / 2) for c, (lo, hi) in span.items()], "country string, delta double")


def clone_decoys(pairs: DataFrame, truth: DataFrame, weight: float, seed: int = 42) -> DataFrame:
    """Repeats the pairs of pool records that nobody owns, weight - 1 times more (a fraction by hash), as new records."""
    whole = int(weight - 1)
    part = weight - 1 - whole
    lone = pairs.join(truth.select("r").distinct(), "r", "left_anti")
    extra = F.when(F.pmod(F.xxhash64(F.col("r"), F.lit(seed)), F.lit(10000)) < round(part * 10000), 1).otherwise(0)
    copies = lone.withColumn("_n", F.lit(whole) + extra).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    return pairs.withColumn("copy", F.lit(0)).unionByName(copies)
