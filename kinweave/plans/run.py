"""The linkage pipeline end to end: block, stage one out of fold, learned blocking, stage two, rule, id lists.

Stages write Parquet under a work folder and are read back from it, which cuts lineage and lets a run resume; the folder
is named by options and inputs. ``learn`` leaves its models there, and ``predict`` scores another split with them.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import metric as M
from ..operators import model as MD
from ..operators import retrieval as R
from ..operators import selection as SEL
from ..sources import tables as T


@dataclass(frozen=True)
class Options:
    """Knobs of a run."""

    channels: str = "base,conj:20,bm25:5,name_noaddr:5,rescue"
    rrf_m: int = 0  # pairs kept per reference by fused rank; 0 keeps all
    df_cap: int = 2500
    stage1: MD.Config = field(default_factory=MD.Config)
    stage2: MD.Config = field(default_factory=MD.Config)
    prune_loss: float = 0.002
    min_cand_recall: float = 0.98
    decoy_weight: float = 1.0  # weight of pairs whose pool record nobody owns
    stage2_margin: float = 0.0005  # gain that stage two must show over stage one
    count_match: float | None = None  # pairs per reference record wanted in a country
    count_scale: float = 1.0
    count_scope: str = "all"  # countries to match: all, unseen (those not in seen), none
    seen: tuple[str, ...] = ()
    text_features: bool = True


def block(index: R.Index, options: Options) -> DataFrame:
    return R.retrieve(index, options.channels, options.rrf_m)


def pair_features(index: R.Index, cand: DataFrame, options: Options) -> tuple[DataFrame, list[str]]:
    """All stage-one columns of candidates; competition is measured over all of them."""
    q, p = index.queries, index.pool
    out = FT.context2(FT.context(cand))
    out = FT.name_ambiguity(FT.crowd_features(out, q, p), q, p)
    out = R.pair_conj_cos(index, out)
    out = FT.profile_features(out, FT.profiles(q), FT.profiles(p))
    if options.text_features:
        out = FT.house_number_features(FT.string_features(out, q, p), q, p)
    names = [c for c, kind in out.dtypes if c not in ("q", "r") and kind != "string"]
    return out, names


def _weighted(pairs: DataFrame, truth: DataFrame, weight: float) -> DataFrame:
    owned = truth.select("r").distinct().withColumn("_owned", F.lit(1))
    return pairs.join(owned, "r", "left").withColumn("weight", F.when(F.col("_owned").isNull(), weight).otherwise(1.0)).drop("_owned")


def run_key(options: Options, *tables: DataFrame) -> str:
    """Names what a run depends on: its options and the rows of its inputs, so no stage of another run is read back."""
    marks = [str(T.fingerprint(t)) for t in tables]
    return hashlib.sha1("|".join([repr(options), *marks]).encode()).hexdigest()[:16]


def _stage(rows: DataFrame, names: list[str], config: MD.Config, path: str, weight: str | None = None) -> DataFrame:
    """Out-of-fold scores (q, r, y, fold, p), written with the fold models beside them."""

    def make() -> DataFrame:
        scored, models = MD.out_of_fold(rows, names, config, weight)
        for k, model in enumerate(models):
            model.write().overwrite().save(f"{path}_models/{k}")
        return scored.select("q", "r", "y", "fold", "p")

    return T.cached(make, path, rows.sparkSession)


def _studied(scored: DataFrame, truth: DataFrame, refs: DataFrame) -> tuple[SEL.Rule, float, bool]:
    """The best rule, its score, and whether it wants calibrated scores; raw scores go first at equal scores."""
    rule, table = SEL.best_rule(scored.select("q", "r", "p"), truth, refs)
    calibrated = MD.cross_calibrate(scored).select("q", "r", F.col("p_cal").alias("p"))
    other, table2 = SEL.best_rule(calibrated, truth, refs)
    return (other, table2[0][1], True) if table2[0][1] > table[0][1] else (rule, table[0][1], False)


def learn(index: R.Index, truth: DataFrame, work: str, options: Options = Options()) -> tuple[DataFrame, SEL.Rule, dict]:
    """Out-of-fold scores p of the candidates, the best selection rule on them, and metrics.

    Stages, fold models and metrics are under ``work``, in a folder named by the options and the inputs (metrics["key"]).
    """
    spark = index.queries.sparkSession
    key = run_key(options, index.queries, index.pool, truth)
    work = f"{work}/{key}"
    refs = index.queries.select(F.col("id").alias("q"), "country")
    cand = T.cached(lambda: block(index, options), f"{work}/candidates", spark)
    table, names = pair_features(index, cand, options)
    table = T.cached(M.label_pairs(table, truth), f"{work}/features", spark)
    weight = "weight" if options.decoy_weight != 1.0 else None
    rows = _weighted(table, truth, options.decoy_weight) if weight else table
    one = _stage(rows, names, options.stage1, f"{work}/stage1", weight)
    recall = M.oracle_f05(cand, truth, refs).first().recall
    cut = MD.prune_cut(one, options.prune_loss, recall, options.min_cand_recall)
    kept = one.where(F.col("p") >= cut).drop("fold").join(cand, ["q", "r"])
    deep, more = MD.stack_features(kept, index.pool)
    deep = T.cached(deep.select("q", "r", "y", *more), f"{work}/stack", spark)
    two = _stage(deep, more, options.stage2, f"{work}/stage2")
    (rule1, f1, cal1), (rule2, f2, cal2) = _studied(one, truth, refs), _studied(two, truth, refs)
    better = f2 >= f1 + options.stage2_margin
    pairs, rule, calibrated = (two, rule2, cal2) if better else (one, rule1, cal1)
    metrics = {"key": key, "recall": recall, "prune_cut": cut, "stage1": f1, "stage2": f2, "stage": 2 if better else 1, "calibrated": calibrated}
    metrics |= {"rule": asdict(rule), "names": names, "stack_names": more}
    T.write_metrics(spark, metrics, f"{work}/metrics")
    out = MD.cross_calibrate(pairs).select("q", "r", "y", F.col("p_cal").alias("p")) if calibrated else pairs.select("q", "r", "y", "p")
    return out, rule, metrics


def predict(index: R.Index, work: str, key: str, options: Options = Options()) -> tuple[DataFrame, SEL.Rule]:
    """Scores (q, r, p) of another split's candidates by the models of a learnt run, and the run's rule.

    A pair's score is the mean over the fold models; where the rule wants it, it is calibrated on all out-of-fold scores.
    Candidates, columns and scores are written once each, as several steps read them.
    """
    spark, work = index.queries.sparkSession, f"{work}/{key}"
    said = T.read_metrics(spark, f"{work}/metrics")
    cand = index.home.save(block(index, options), "candidates")
    table = index.home.save(pair_features(index, cand, options)[0], "features")
    scored = index.home.save(_mean_score(table, said["names"], f"{work}/stage1_models", options.stage1.folds), "scored1")
    if said["stage"] == 2:
        kept = scored.where(F.col("p") >= said["prune_cut"]).join(cand, ["q", "r"])
        deep = index.home.save(MD.stack_features(kept, index.pool)[0], "stack")
        scored = index.home.save(_mean_score(deep.drop("p"), said["stack_names"], f"{work}/stage2_models", options.stage2.folds), "scored2")
    if said["calibrated"]:
        model = MD.fit_calibrator(spark.read.parquet(f"{work}/stage{said['stage']}"))
        scored = MD.calibrate(model, scored).select("q", "r", F.col("p_cal").alias("p"))
    return scored, SEL.Rule(**said["rule"])


def _mean_score(table: DataFrame, names: list[str], path: str, folds: int) -> DataFrame:
    return MD.mean_score([MD.load(f"{path}/{k}") for k in range(folds)], MD.assemble(table, names))


def matched(pairs: DataFrame, refs: DataFrame, rule: SEL.Rule, options: Options) -> DataFrame:
    """Scores shifted by country so that the rule keeps the wanted number of pairs; unchanged without that wish."""
    if options.count_match is None or options.count_scope == "none":
        return pairs
    wanted = refs.where(~F.col("country").isin(list(options.seen))) if options.count_scope == "unseen" and options.seen else refs
    delta = SEL.count_match_rule(pairs, wanted, rule, options.count_match * options.count_scale)
    moved = pairs.join(refs.select("q", "country"), "q").join(F.broadcast(delta), "country", "left")
    shifted = SEL.shift_logit(F.col("p"), F.col("delta") + 1e-6)
    return moved.withColumn("p", F.when(F.col("delta").isNull(), F.col("p")).otherwise(shifted)).drop("country", "delta")


def id_lists(index: R.Index, pairs: DataFrame, rule: SEL.Rule, options: Options = Options()) -> DataFrame:
    """One row per reference record with the ids that the rule keeps, best first."""
    refs = index.queries.select(F.col("id").alias("q"), "country")
    kept = SEL.select(matched(pairs, refs, rule, options), rule)
    return T.id_lists(refs, kept.withColumn("rank", -F.col("p")))
