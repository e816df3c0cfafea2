"""Why true pairs are missed: bucket features, failure modes, flags, presence, slices, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import last_component, postcodes, script_of
from .features import _split, jaccard, with_sides

C = F.col
# --- fixed values: failure modes in order, flags ---
MODES = [
    ("empty_address_record", "r_addr_empty"),
    ("native_script_name", "r_native"),
    ("alias_or_web_name_form", "r_alias_or_web"),
    ("name_replaced_same_address", "name_tok_jac = 0 and name_skel_jac = 0 and addr_tok_jac >= 0.5"),
    ("name_replaced_address_changed", "name_tok_jac = 0 and name_skel_jac = 0"),
    ("address_rewritten_name_kept", "addr_tok_jac < 0.25 and name_tok_jac >= 0.5"),
    ("common_name_crowd", "s1_name_freq >= 20"),
    ("no_key_survives_df_cap", "comb <= 0"),
    ("partial_name_and_address_noise", "name_tok_jac < 0.5 and addr_tok_jac < 0.5"),
    ("similar_but_outranked", "comb > 0"),
]
FLAGS = {
    "r_native": "r_native", "r_addr_empty": "r_addr_empty", "r_alias_or_web": "r_alias_or_web", "source_S2": "source = 'S2'",
    "name_tok_jac=0": "name_tok_jac = 0", "name_tok_jac<0.5": "name_tok_jac < 0.5", "name_skel_jac=0": "name_skel_jac = 0",
    "name_compact_eq": "name_compact_eq", "addr_tok_jac<0.25": "addr_tok_jac < 0.25", "addr_tok_jac>=0.75": "addr_tok_jac >= 0.75",
    "num_jac=0 (both have numbers)": "s1_has_num and r_has_num and num_jac = 0", "r_has_no_number": "not r_has_num",
    "postcode_both": "postcode_both", "postcode_eq": "postcode_eq", "last_component_eq (state/region)": "last_comp_eq",
    "s1_name_tokens=1": "s1_name_tokens = 1", "s1_name_tokens>=4": "s1_name_tokens >= 4", "s1_name_chars<=6": "s1_name_chars <= 6",
    "r_addr_tokens<=3": "r_addr_tokens <= 3", "common_name (freq>=20)": "s1_name_freq >= 20", "rare_name (freq<=1)": "s1_name_freq <= 1",
    "no_surviving_key (comb=0)": "comb <= 0",
}
# ---------------------------------------------------


def name_frequency(pool: DataFrame) -> DataFrame:
    """(country, name_core, s1_name_freq) over the pool."""
    return pool.groupBy("country", "name_core").agg(F.count(F.lit(1)).alias("s1_name_freq"))


def pair_table(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Bucket features of true pairs (q, r, comb)."""
    columns = ["business_name", "business_address", "country", "name_core", "name_skel", "name_compact", "name_native", "name_has_alias", "name_is_web", "addr_clean", "addr_nums", "addr_empty"]
    t = with_sides(pairs, queries, pool, columns)
    src = pool.select(C("id").alias("r"), F.concat(F.lit("S"), C("src").cast("string")).alias("source")) if "src" in pool.columns else None
    t = t.join(src, "r") if src is not None else t.withColumn("source", F.lit("S2"))
    freq = name_frequency(pool).withColumnsRenamed({"country": "l_country", "name_core": "l_name_core"})
    t = t.join(freq, ["l_country", "l_name_core"], "left").fillna(0, ["s1_name_freq"])
    lp, rp = postcodes(C("l_business_address")), postcodes(C("r_business_address"))
    count = lambda c: F.size(_split(c))
    t = t.withColumns(
        {
            "country": C("l_country"), "r_script": script_of(C("r_business_name")), "r_native": C("r_name_native"),
            "r_alias_or_web": C("r_name_has_alias") | C("r_name_is_web"), "s1_name_tokens": count("l_name_core"), "r_name_tokens": count("r_name_core"),
            "s1_name_chars": F.length("l_name_core"), "name_tok_jac": jaccard("l_name_core", "r_name_core"), "name_skel_jac": jaccard("l_name_skel", "r_name_skel"),
            "name_compact_eq": C("l_name_compact") == C("r_name_compact"), "s1_addr_tokens": count("l_addr_clean"), "r_addr_tokens": count("r_addr_clean"),
            "addr_tok_jac": jaccard("l_addr_clean", "r_addr_clean"), "num_jac": jaccard("l_addr_nums", "r_addr_nums"),
            "s1_has_num": C("l_addr_nums") != "", "r_has_num": C("r_addr_nums") != "", "postcode_both": (F.size(lp) > 0) & (F.size(rp) > 0),
            "postcode_eq": F.arrays_overlap(lp, rp), "last_comp_eq": last_component(C("l_business_address")) == last_component(C("r_business_address")),
        }
    )
    return t.drop(*[f"{s}_{c}" for s in "lr" for c in columns if f"{s}_{c}" != "r_addr_empty"])


def assign_modes(table: DataFrame) -> DataFrame:
    """Adds mode: the first rule that holds."""
    mode = F.lit("other")
    for name, rule in reversed(MODES):
        mode = F.when(F.expr(rule), name).otherwise(mode)
    return table.withColumn("mode", mode)


def flag_table(table: DataFrame, missed: str = "missed") -> DataFrame:
    """(flag, share_of_misses, share_of_hits, lift), from one aggregation."""
    share = lambda rule, side: F.coalesce(F.avg(F.when(C(missed) == side, F.expr(rule).cast("double"))), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("flag"), F.round(share(r, True), 6).alias("share_of_misses"), F.round(share(r, False), 6).alias("share_of_hits")) for n, r in FLAGS.items()])
    out = table.agg(rows.alias("rows")).select(F.explode("rows").alias("x")).select("x.*")
    return out.withColumn("lift", F.round(F.try_divide("share_of_misses", "share_of_hits"), 6))


def mode_by_country(table: DataFrame) -> DataFrame:
    return table.groupBy("mode", "country").agg(F.count(F.lit(1)).alias("pairs"))


def presence_table(found: DataFrame, rank: str = "rank") -> DataFrame:
    """True pairs by where their rank falls, overall and by country; found has country and a rank or null."""
    bucket = F.when(C(rank).isNull(), "absent")
    for upto, name in ((1, "1"), (5, "2-5"), (10, "6-10"), (30, "11-30")):
        bucket = bucket.when(C(rank) <= upto, name)
    out = found.withColumn("bucket", bucket.otherwise("31+")).cube("country", "bucket").agg(F.count(F.lit(1)).alias("pairs")).where("bucket is not null")
    return out.withColumn("country", F.coalesce("country", F.lit("(all)")))


def selection_stats(kept: DataFrame, refs: DataFrame) -> DataFrame:
    """Per country: reference records, selected pairs, pairs a record, share of records without any."""
    sizes = kept.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    every = refs.join(sizes, "q", "left").fillna(0, ["n"])
    return every.groupBy("country").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("per_record"),
        F.round(F.avg((C("n") == 0).cast("double")), 6).alias("share_without"),
    )


def rank_quantiles(ranks: DataFrame, refs: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per country: quantiles of the rank that true pairs have among all pool records, and how many share no key (rank 0)."""
    found = ranks.join(refs.select("q", "country"), "q")
    cuts = [F.round(F.percentile(F.when(C("comb_rank") > 0, C("comb_rank")), q), 6).alias(f"rank_p{round(100 * q)}") for q in at]
    return found.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(C("comb_rank") == 0).alias("without_key"), *cuts)


def slices(refs: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, slice): singletons, native or Latin matches, cluster sizes, shared or unique address."""
    native = pool.select(C("id").alias("r"), C("name_native").cast("int").alias("nat"))
    sizes = truth.join(native, "r", "left").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("nat").alias("nat"))
    shared = (F.count(F.lit(1)).over(W.partitionBy("addr_clean")) >= 2) & (C("addr_clean") != "")
    rows = refs.select(C("id").alias("q"), shared.alias("shared")).join(sizes, "q", "left").fillna(0, ["n", "nat"])
    rules = [
        ("singleton", "n = 0"), ("true_native", "nat = 1"), ("true_latin_only", "n > 0 and nat = 0"), ("true_size_1", "n = 1"), ("true_size_2_4", "n between 2 and 4"),
        ("true_size_5p", "n >= 5"), ("s1_addr_shared", "shared"), ("s1_addr_unique", "not shared"),
    ]
    return rows.select("q", F.explode(F.filter(F.array(*[F.when(F.expr(r), n) for n, r in rules]), lambda x: x.isNotNull())).alias("slice"))


def match_histogram(refs: DataFrame, truth: DataFrame, most: int = 15) -> DataFrame:
    sizes = refs.select("q").join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").fillna(0, ["n"])
    return sizes.groupBy(F.least("n", F.lit(most)).alias("matches")).agg(F.count(F.lit(1)).alias("records"))


def file_stats(records: DataFrame) -> DataFrame:
    """Per country: rows, empty fields, null-like addresses, native names, mean lengths."""
    return records.groupBy("country").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(C("business_name") == "").alias("empty_names"), F.count_if(C("business_address") == "").alias("empty_addresses"),
        F.count_if(F.lower("business_address").rlike(r"\bnull\b")).alias("null_like"), F.count_if(script_of(C("business_name")) != "Latin").alias("not_latin"),
        F.round(F.avg(F.length("business_name")), 6).alias("name_chars"), F.round(F.avg(F.length("business_address")), 6).alias("address_chars"),
    )


def id_leakage(truth: DataFrame) -> DataFrame:
    """Whether ids give matches away: correlation and median distance of numeric ids of true pairs."""
    return truth.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr("q", "r"), 6).alias("id_corr"), F.round(F.percentile(F.abs(C("q") - C("r")), 0.5), 6).alias("median_gap"))
