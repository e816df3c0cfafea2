"""Labels, blocking recall, and macro F0.5 over all reference records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5, 10, 20, 30)


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one record: 1 if nothing is true or predicted, 0 if only one side is empty."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds y: 1 for true pairs (q, r)."""
    return pairs.join(truth.select("q", "r", F.lit(1).alias("y")), ["q", "r"], "left").fillna(0, ["y"])


def owners(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """(r, owner): null for decoys."""
    return pool.select(F.col("id").alias("r")).join(truth.select("r", F.col("q").alias("owner")), "r", "left")


def by_record(pred: DataFrame, truth: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, n_true, n_pred, tp, f) of every reference record, those without candidates included."""
    hits = pred.select("q", "r").distinct().join(truth.withColumn("_true", F.lit(1)), ["q", "r"], "left")
    found = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_true").alias("tp"))
    sizes = truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true"))
    every = refs.join(sizes, "q", "left").join(found, "q", "left").fillna(0, ["n_true", "n_pred", "tp"])
    return every.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(pred: DataFrame, truth: DataFrame, refs: DataFrame, by: str | None = None) -> DataFrame:
    """(records, macro_f05, precision, recall), overall or by a column of refs."""
    rows = by_record(pred, truth, refs)
    agg = [
        F.count(F.lit(1)).alias("records"), F.round(F.avg("f"), 6).alias("macro_f05"),
        F.round(F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_pred")), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_true")), F.lit(0.0)), 6).alias("recall"),
    ]
    return rows.groupBy(by).agg(*agg) if by else rows.agg(*agg)


def blocking_report(cand: DataFrame, truth: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per scope (all, each country): pairs, recall, recall among the first k by name + address."""
    score = F.round(F.col("name_cos") + F.col("addr_cos"), 6)
    ranked = cand.select("q", "r", F.row_number().over(W.partitionBy("q").orderBy(F.desc(score), "r")).alias("rank"))
    labelled = label_pairs(ranked, truth).join(refs.select("q", "country"), "q")
    found = labelled.rollup("country").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("y").alias("hits"), *[F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)).alias(f"h{k}") for k in DEPTHS]
    )
    total = truth.join(refs.select("q", "country"), "q").rollup("country").agg(F.count(F.lit(1)).alias("n_true"))
    size = refs.rollup("country").agg(F.count(F.lit(1)).alias("n_ref"))
    named = lambda df: df.withColumn("country", F.coalesce("country", F.lit("(all)")))
    out = named(size).join(named(total), "country", "left").join(named(found), "country", "left").fillna(0)
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n_true")), F.lit(0.0)), 6)
    return out.select("country", "pairs", F.round(F.col("pairs") / F.col("n_ref"), 6).alias("pairs_per_ref"), rate("hits").alias("recall"), *[rate(f"h{k}").alias(f"recall_at_{k}") for k in DEPTHS])


def oracle_f05(cand: DataFrame, truth: DataFrame, refs: DataFrame) -> DataFrame:
    """What a perfect classifier over the candidates would score."""
    return macro_f05(cand.join(truth, ["q", "r"], "left_semi"), truth, refs)


def channel_gain(lists: dict[str, DataFrame], truth: DataFrame, over: str = "base") -> DataFrame:
    """Per channel: pairs, true pairs, true pairs that the base channel lacks, pairs that it lacks."""
    base = lists[over].select("q", "r")
    out = None
    for name, df in lists.items():
        own = df.select("q", "r").distinct().join(base.withColumn("_base", F.lit(1)), ["q", "r"], "left").join(truth.withColumn("_true", F.lit(1)), ["q", "r"], "left")
        fresh = F.col("_base").isNull()
        row = own.agg(F.count(F.lit(1)).alias("pairs"), F.count("_true").alias("hits"), F.coalesce(F.sum(fresh.cast("long")), F.lit(0)).alias("new_pairs"), F.count(F.when(fresh, F.col("_true"))).alias("new_hits"))
        row = row.select(F.lit(name).alias("channel"), "*")
        out = row if out is None else out.union(row)
    return out


def greedy_union(lists: dict[str, DataFrame], truth: DataFrame, n_ref: int, start: str = "base", gain: float = 0.002, efficiency: float = 0.0005, most: float = 80.0) -> list[str]:
    """Channels worth adding, best recall gain first, while a step gains enough in all and per extra pair of a record.

    The pair table with one flag a channel is computed once; the driver sees counts only.
    """
    names = list(lists)
    flagged = None
    for name, df in lists.items():
        part = df.select("q", "r").distinct().withColumn("ch", F.lit(name))
        flagged = part if flagged is None else flagged.union(part)
    wide = flagged.groupBy("q", "r").agg(*[F.max(F.when(F.col("ch") == n, 1).otherwise(0)).alias(n) for n in names])
    patterns = label_pairs(wide, truth).groupBy(*names).agg(F.count(F.lit(1)).alias("pairs"), F.sum("y").alias("hits")).collect()
    total = truth.count() or 1
    size = lambda own: tuple(sum(r[k] for r in patterns if any(r[n] for n in own)) for k in ("hits", "pairs"))
    chosen = [start]
    while True:
        hits, pairs = size(chosen)
        best = None
        for n in names:
            if n not in chosen:
                h, p = size([*chosen, n])
                more, cost = (h - hits) / total, (p - pairs) / n_ref
                if more >= gain and p / n_ref <= most and more >= efficiency * cost and (best is None or more > best[0]):
                    best = (more, n)
        if best is None:
            return chosen
        chosen.append(best[1])
