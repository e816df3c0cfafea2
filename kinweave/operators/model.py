"""Two-stage pair classifier on Spark ML: folds, out-of-fold scores, calibration, learned blocking, stage two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import context, group_features, p_context, sibling_features


@dataclass(frozen=True)
class Config:
    """Knobs of training; trees and depth are small by default."""

    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 63
    least: int = 20
    rows: float = 0.8
    columns: str = "0.8"
    folds: int = 3
    seed: int = 42
    valid: float = 0.0  # share of queries that say when to stop adding trees; 0 adds all
    gain: float = 0.01  # relative gain on them that keeps training going


def fold_of(q: Column, folds: int, seed: int = 42) -> Column:
    """Fold of a query's pairs, by hash, so a query is never split."""
    return F.pmod(F.xxhash64(q, F.lit(seed)), F.lit(folds)).cast("int")


def holdout_split(q: Column, seed: int = 42) -> Column:
    """train, valid or test for 70, 15 and 15 percent of queries."""
    b = F.pmod(F.xxhash64(q, F.lit(seed + 1)), F.lit(100))
    return F.when(b < 70, "train").when(b < 85, "valid").otherwise("test")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    numbers = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(numbers)


def train(df: DataFrame, config: Config = Config(), weight: str | None = None) -> GBTClassificationModel:
    """Boosted trees on assembled pairs with a label y."""
    gbt = GBTClassifier(
        labelCol="y", maxIter=config.trees, maxDepth=config.depth, stepSize=config.rate, maxBins=config.bins,
        minInstancesPerNode=config.least, subsamplingRate=config.rows, featureSubsetStrategy=config.columns, seed=config.seed,
    )
    if config.valid:
        df = df.withColumn("_valid", F.pmod(F.xxhash64("q", F.lit(config.seed + 2)), F.lit(1000)) < int(config.valid * 1000))
        gbt = gbt.setValidationIndicatorCol("_valid").setValidationTol(config.gain)
    return (gbt.setWeightCol(weight) if weight else gbt).fit(df)


def load(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def predict(model: GBTClassificationModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, F.round(vector_to_array("probability")[1], 6))
    return out.drop("rawPrediction", "probability", "prediction")


def average(parts: list[DataFrame], name: str = "p") -> DataFrame:
    """Bagging: the mean score of a pair over several predictions."""
    every = parts[0].select("q", "r", name)
    for p in parts[1:]:
        every = every.union(p.select("q", "r", name))
    return every.groupBy("q", "r").agg(F.round(F.avg(name), 6).alias(name))


def mean_score(models: list[GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """(q, r, p): the mean score of several models, all in one pass over assembled pairs."""
    for k, model in enumerate(models):
        rows = predict(model, rows, f"_p{k}")
    total = F.col("_p0")
    for k in range(1, len(models)):
        total = total + F.col(f"_p{k}")
    return rows.select("q", "r", F.round(total / len(models), 6).alias("p"))


def out_of_fold(df: DataFrame, features: list[str], config: Config = Config(), weight: str | None = None) -> tuple[DataFrame, list[GBTClassificationModel]]:
    """Scores of every pair by a model that never saw its query, and the models."""
    rows = assemble(df, features).withColumn("fold", fold_of(F.col("q"), config.folds, config.seed)).persist()
    models = [train(rows.where(F.col("fold") != k), config, weight) for k in range(config.folds)]
    scored = [predict(m, rows.where(F.col("fold") == k)) for k, m in enumerate(models)]
    out = scored[0]
    for s in scored[1:]:
        out = out.union(s)
    return out.drop("features"), models


def fit_calibrator(scored: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol="p", labelCol="y").fit(scored.select(F.col("p").cast("double"), F.col("y").cast("double")))


def calibrate(model: IsotonicRegressionModel, scored: DataFrame, name: str = "p_cal") -> DataFrame:
    return model.transform(scored).withColumn(name, F.round(F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)), 6)).drop("prediction")


def cross_calibrate(scored: DataFrame, name: str = "p_cal") -> DataFrame:
    """Each fold calibrated on the others."""
    folds = [r[0] for r in scored.select("fold").distinct().orderBy("fold").collect()]
    parts = [calibrate(fit_calibrator(scored.where(F.col("fold") != k)), scored.where(F.col("fold") == k), name) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def prune_cut(scored: DataFrame, loss: float = 0.002, recall: float = 1.0, least_recall: float = 0.98) -> float:
    """Learned blocking: the score below which pairs go, losing at most ``loss`` of the true ones."""
    allowed = max(0.0, min(loss, 1 - least_recall / recall)) if recall else 0.0
    cut = scored.where("y = 1").agg(F.percentile("p", allowed)).first()[0]
    return 0.0 if cut is None else float(cut)


def stack_features(pairs: DataFrame, pool: DataFrame) -> tuple[DataFrame, list[str]]:
    """Stage-two table of scored pairs, and its feature columns."""
    out = group_features(sibling_features(p_context(context(pairs)), pool), pool)
    skip = {"q", "r", "y", "p", "fold", "features"}
    return out, [c for c, t in out.dtypes if c not in skip and t != "string"]


def blend(pairs: DataFrame, other: DataFrame, weight: float = 0.5) -> DataFrame:
    """Mixes in another run's scores; pairs that it lacks keep their own."""
    theirs = other.select("q", "r", F.col("p").alias("_other"))
    mixed = pairs.join(theirs, ["q", "r"], "left")
    return mixed.withColumn("p", F.round(F.coalesce(F.col("p") * (1 - weight) + F.col("_other") * weight, F.col("p")), 6)).drop("_other")


def country_holdout(df: DataFrame, features: list[str], config: Config = Config()) -> DataFrame:
    """Each country scored by a model trained on the others; countries whose others have one label only are left out."""
    rows = assemble(df, features)
    parts = []
    for (country,) in rows.select("country").distinct().orderBy("country").collect():
        rest = rows.where(F.col("country") != country)
        if rest.select("y").distinct().count() == 2:
            parts.append(predict(train(rest, config), rows.where(F.col("country") == country)))
    if not parts:
        return df.limit(0).withColumn("p", F.lit(None).cast("double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.drop("features")
