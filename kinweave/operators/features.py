"""Features of candidate pairs (q, r): competition, strings, crowds, record profiles, stage-two context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.normalize import skeleton, skeleton_of
from .selection import logit

# --- fixed values: legal forms in bit order, noise words ---
LEGAL_FORMS = {
    "PVT": "private pvt pvte prvt prv privat praivet praivate prayvet pvtltd", "LTD": "limited ltd limitad limted lmtd pvtltd",
    "PUB": "public", "LLP": "llp", "LLC": "llc", "PLLC": "pllc", "INC": "inc incorporated", "CORP": "corp corporation",
    "CO": "co company cie compagnie", "LP": "lp", "PC": "pc", "PLC": "plc", "SARL": "sarl", "SAS": "sas", "SASU": "sasu",
    "EURL": "eurl", "SA": "sa", "SCI": "sci", "SNC": "snc", "EI": "ei", "ETS": "ets etablissements etablissement",
    "SOC": "societe ste", "GMBH": "gmbh",
}
NOISE_WORDS = (
    "center centre services service partners com www shri sri smt mr mrs dr ms the id dba and of m s district metro"
).split()
# -----------------------------------------------------------
BIT = {form: 1 << k for k, form in enumerate(LEGAL_FORMS)}


def rank_gap(pairs: DataFrame, score: str, group: str, name: str, side: str) -> DataFrame:
    """Adds <name>_rank_<side> (ties share the best rank) and <name>_gap_<side> (distance to the group's best)."""
    w = W.partitionBy(group)
    return pairs.withColumns(
        {
            f"{name}_rank_{side}": F.rank().over(w.orderBy(F.desc(score))),
            f"{name}_gap_{side}": F.round(F.col(score) - F.max(score).over(w), 6),
        }
    )


def context(pairs: DataFrame) -> DataFrame:
    """Competition by name + address (and by rrf where there is one) on both sides, over all pairs."""
    out = pairs.withColumn("comb", F.round(F.col("name_cos") + F.col("addr_cos"), 6))
    scores = ["comb", *(["rrf"] if "rrf" in pairs.columns else [])]
    for side, group in (("s1", "q"), ("r", "r")):  # one exchange a side
        for score in scores:
            out = rank_gap(out, score, group, score, side)
        out = out.withColumn(f"n_cand_{side}", F.count(F.lit(1)).over(W.partitionBy(group)))
    ranks = [f"{score}_{what}_{side}" for score in scores for side in ("s1", "r") for what in ("rank", "gap")]
    return out.select(*pairs.columns, "comb", *ranks, "n_cand_s1", "n_cand_r")


def context2(pairs: DataFrame, most: int = 2048) -> DataFrame:
    """Competition by name on both sides and by address on the pool's, with how many are about as good as the best."""
    out = rank_gap(rank_gap(rank_gap(pairs, "name_cos", "q", "name", "s1"), "name_cos", "r", "name", "r"), "addr_cos", "r", "addr", "r")
    ties = F.sum((F.col("addr_gap_r") >= -0.02).cast("int")).over(W.partitionBy("r"))
    out = out.withColumn("addr_ties_r", ties)
    return out.withColumns({c: F.least(F.col(c), F.lit(most)) for c in ("name_rank_s1", "name_rank_r", "addr_rank_r", "addr_ties_r")})


def dense_context(pairs: DataFrame, full: str = "dense_cos", name: str | None = None) -> DataFrame:
    out = rank_gap(rank_gap(pairs, full, "q", "dense", "s1"), full, "r", "dense", "r")
    return rank_gap(out, name, "q", "dense_name", "s1") if name else out


def with_sides(pairs: DataFrame, queries: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """Adds l_<column> and r_<column> of both records."""
    left = queries.select(F.col("id").alias("q"), *[F.col(c).alias(f"l_{c}") for c in columns])
    right = pool.select(F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    return pairs.join(left, "q").join(right, "r")


def _split(column: str) -> Column:
    return F.filter(F.split(column, " "), lambda t: t != "")


def jaccard(a: str, b: str) -> Column:
    x, y = F.array_distinct(_split(a)), F.array_distinct(_split(b))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.round(share, 6)).otherwise(0.0)


def number_features(sided: DataFrame) -> DataFrame:
    """Adds a_num_jac and a_first_num_eq from l_addr_nums and r_addr_nums."""
    first = F.array_contains(_split("r_addr_nums"), F.coalesce(F.try_element_at(_split("l_addr_nums"), F.lit(1)), F.lit("")))
    return sided.withColumns({"a_num_jac": jaccard("l_addr_nums", "r_addr_nums"), "a_first_num_eq": first.cast("int")})


_STRINGS = [
    ("n_ratio", sim.ratio_udf, "name_core"), ("n_tset", sim.token_set_udf, "name_core"), ("n_tsort", sim.token_sort_udf, "name_core"),
    ("n_partial", sim.partial_udf, "name_core"), ("n_jw", sim.jaro_winkler_udf, "name_core"), ("n_skel_ratio", sim.ratio_udf, "name_skel"),
    ("n_skel_tset", sim.token_set_udf, "name_skel"), ("n_compact_ratio", sim.ratio_udf, "name_compact"),
    ("n_compact_partial", sim.partial_udf, "name_compact"), ("n_clean_tset", sim.token_set_udf, "name_clean"),
    ("a_ratio", sim.ratio_udf, "addr_clean"), ("a_tset", sim.token_set_udf, "addr_clean"), ("a_tsort", sim.token_sort_udf, "addr_clean"),
    ("a_alpha_tset", sim.token_set_udf, "addr_alpha"), ("a_skel_tset", sim.token_set_udf, "addr_skel"),
]
TEXT_COLUMNS = ["name_core", "name_skel", "name_compact", "name_clean", "addr_clean", "addr_alpha", "addr_skel", "addr_nums"]
FLAG_COLUMNS = ["name_is_web", "name_has_alias", "name_native", "addr_empty", "addr_ncomp"]


def string_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The 27 similarity columns of each pair (r_src only where the pool has src)."""
    sided = with_sides(pairs, queries, pool, TEXT_COLUMNS + FLAG_COLUMNS)
    out = sided.withColumns({name: f(F.col(f"l_{c}"), F.col(f"r_{c}")) for name, f, c in _STRINGS})
    out = number_features(out).withColumns(
        {
            "n_core_eq": (F.col("l_name_core") == F.col("r_name_core")).cast("int"),
            "n_ntok_l": F.length("l_name_core") - F.length(F.replace(F.col("l_name_core"), F.lit(" "), F.lit(""))) + 1,
            "n_ntok_r": F.length("r_name_core") - F.length(F.replace(F.col("r_name_core"), F.lit(" "), F.lit(""))) + 1,
            "r_is_web": F.col("r_name_is_web").cast("int"), "r_has_alias": F.col("r_name_has_alias").cast("int"),
            "r_native": F.col("r_name_native").cast("int"), "r_empty": F.col("r_addr_empty").cast("int"),
            "r_ncomp": F.col("r_addr_ncomp"), "l_ncomp": F.col("l_addr_ncomp"),
        }
    )
    if "src" in pool.columns:
        out = out.join(pool.select(F.col("id").alias("r"), F.col("src").alias("r_src")), "r")
    raw = [f"{side}_{c}" for side in "lr" for c in TEXT_COLUMNS + FLAG_COLUMNS]
    return out.drop(*raw)


def house_number_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds a_num_tset, a_hnum_partial, a_hnum_ratio."""
    sided = with_sides(pairs, queries, pool, ["addr_nums"])
    first = lambda c: F.substring_index(c, " ", 1)
    return sided.withColumns(
        {
            "a_num_tset": sim.token_set_udf("l_addr_nums", "r_addr_nums"),
            "a_hnum_partial": sim.partial_udf(first("l_addr_nums"), first("r_addr_nums")),
            "a_hnum_ratio": sim.ratio_udf(first("l_addr_nums"), first("r_addr_nums")),
        }
    ).drop("l_addr_nums", "r_addr_nums")


def _count_of(records: DataFrame, keys: list[str], name: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def crowd_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds l_addr_dup and r_addr_dup (reference records with exactly that address; 0 for an empty one) and a_exact."""
    crowd = queries.where("addr_clean <> ''").groupBy("addr_clean").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    out = pairs  # counts go to the records, numbers to the pairs
    for side, key, records in (("l", "q", queries), ("r", "r", pool)):
        known = records.select(F.col("id").alias(key), "addr_clean").join(crowd, "addr_clean", "left")
        out = out.join(known.select(key, F.coalesce("n", F.lit(0)).alias(f"{side}_addr_dup"), F.col("least").alias(f"_{side}")), key)
    return out.withColumn("a_exact", F.coalesce(F.col("_l") == F.col("_r"), F.lit(False)).cast("int")).drop("_l", "_r")


def name_ambiguity(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds l_name_s1dup, r_name_s1cnt, r_name_s23cnt: records with that core name on either side; 0 for an empty one."""
    ours = _count_of(queries.where("name_core <> ''"), ["name_core"], "n1")
    theirs = _count_of(pool.where("name_core <> ''"), ["name_core"], "n2")
    zero = lambda n, name: F.coalesce(n, F.lit(0)).alias(name)
    left = queries.select(F.col("id").alias("q"), "name_core").join(ours, "name_core", "left").select("q", zero("n1", "l_name_s1dup"))
    right = pool.select(F.col("id").alias("r"), "name_core").join(ours, "name_core", "left").join(theirs, "name_core", "left")
    return pairs.join(left, "q").join(right.select("r", zero("n1", "r_name_s1cnt"), zero("n2", "r_name_s23cnt")), "r")


def _mask(tokens: Column, bits: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for word, bit in bits.items() for x in (word, bit)])
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.coalesce(F.element_at(table, t), F.lit(0)).cast("long")))


def legal_bits() -> dict[str, int]:
    """Word to the bits of the legal forms that it stands for."""
    out: dict[str, int] = {}
    for form, listed in LEGAL_FORMS.items():
        for word in listed.split():
            out[word] = out.get(word, 0) | BIT[form]
    return out


def noise_bits() -> dict[str, int]:
    return {w: 1 << k for k, w in enumerate(NOISE_WORDS)}


def sound_bits() -> dict[str, int]:
    """Skeletons that misspelt legal words share."""
    return {skeleton_of("private"): BIT["PVT"], skeleton_of("limited"): BIT["LTD"]}


def profiles(records: DataFrame) -> DataFrame:
    """Adds legal, noise (bit masks), wsig (64-bit signature of the other words), hnum, hlen (first number)."""
    legal, noise, sounds = legal_bits(), noise_bits(), sound_bits()
    tokens = _split("name_clean")
    plain = F.filter(tokens, lambda t: ~t.isin(list(legal)))
    other = F.filter(plain, lambda t: ~t.isin(list(noise)))
    misspelt = F.transform(F.filter(other, lambda t: F.length(t) >= 5), skeleton)
    rest = F.filter(other, lambda t: (F.length(t) < 5) | ~skeleton(t).isin(list(sounds)))
    marks = F.filter(F.transform(rest, skeleton), lambda k: k != "")
    digits = F.regexp_extract(F.substring_index("addr_nums", " ", 1), r"^([0-9]+)", 1)
    signature = F.aggregate(marks, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.crc32(F.encode(k, "UTF-8")).bitwiseAND(F.lit(63)).cast("int"))))
    return records.withColumns(
        {
            "legal": _mask(tokens, legal).bitwiseOR(_mask(misspelt, sounds)),
            "noise": _mask(plain, noise),
            "wsig": signature,
            "hnum": F.when(digits != "", F.substring(digits, 1, 15).cast("long")).otherwise(F.lit(-1)),
            "hlen": F.length(digits),
        }
    )


def profile_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The 18 profile columns of each pair; of records that went through ``profiles``."""
    ours = _count_of(queries, ["name_core", "legal"], "n")
    columns, sided = ["legal", "noise", "wsig", "hnum", "hlen"], pairs
    for side, key, name, records in (("l", "q", "namelg_s1dup", queries), ("r", "r", "namelg_r_s1cnt", pool)):
        known = records.select("id", "name_core", *columns).join(ours, ["name_core", "legal"], "left")
        known = known.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias(name), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        sided = sided.join(known, key)
    l, r = F.col("l_legal"), F.col("r_legal")  # noqa: E741
    minus = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    main, pub = F.lit(BIT["PVT"] | BIT["LTD"]), F.lit(BIT["PUB"])
    both = (F.col("l_hnum") >= 0) & (F.col("r_hnum") >= 0)
    off = F.abs(F.col("l_hnum") - F.col("r_hnum"))
    magnitude = F.when(both & (off > 0), F.length(off.cast("string"))).otherwise(0)
    out = sided.withColumns(
        {
            "lg_l_n": F.bit_count(l), "lg_r_n": F.bit_count(r), "lg_add": minus(r, l), "lg_drop": minus(l, r),
            "lg_add_other": F.bit_count(r.bitwiseAND(F.bitwise_not(l)).bitwiseAND(F.bitwise_not(main))), "lg_same": (l == r).cast("int"),
            "lg_pub_flip": ((l.bitwiseAND(pub) > 0) != (r.bitwiseAND(pub) > 0)).cast("int"),
            "w_extra": minus(F.col("r_wsig"), F.col("l_wsig")), "w_miss": minus(F.col("l_wsig"), F.col("r_wsig")),
            "w_same": (F.col("l_wsig") == F.col("r_wsig")).cast("int"), "nz_extra": minus(F.col("r_noise"), F.col("l_noise")),
            "hn_both": both.cast("int"), "hn_eq": (both & (off == 0)).cast("int"), "hn_diff_mag": magnitude,
            "hn_diff_lead": F.when(both, magnitude - F.col("l_hlen")).otherwise(0), "hn_len_eq": (F.col("l_hlen") == F.col("r_hlen")).cast("int"),
        }
    )
    added = [c for c in out.columns if c not in (*pairs.columns, "namelg_s1dup", "namelg_r_s1cnt") and c[2:] not in columns]
    return out.select(*pairs.columns, "namelg_s1dup", "namelg_r_s1cnt", *added)


def p_context(pairs: DataFrame, p: str = "p") -> DataFrame:
    """How a pair's probability stands among its query's."""
    g = W.partitionBy("q")
    order = g.orderBy(F.desc(p), "r")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v, best, total = F.col(p), F.max(p).over(g), F.sum(p).over(g)
    rank, second = F.rank().over(g.orderBy(F.desc(p))), F.coalesce(F.nth_value(p, 2).over(whole), F.lit(0.0))
    six = lambda c: F.round(c, 6)
    return pairs.withColumns(
        {
            "p1": v, "p1_logit": six(logit(v)), "p1_rank_s1": rank, "p1_gap_s1": six(v - best), "p1_max_s1": best,
            "p1_ratio_s1": six(v / F.greatest(best, F.lit(1e-6))), "p1_second_s1": second,
            "p1_margin": six(F.when(rank == 1, v - second).otherwise(v - best)), "p1_sum_s1": six(total), "p1_sum_others": six(total - v),
            "p1_cnt50_s1": F.sum((v >= 0.5).cast("int")).over(g), "p1_cnt20_s1": F.sum((v >= 0.2).cast("int")).over(g),
        }
    )


def sibling_features(pairs: DataFrame, pool: DataFrame, top: int = 3, least: float = 0.2) -> DataFrame:
    """Agreement of a record with its query's most confident other records (at most three, never itself)."""
    columns = ["addr_clean", "name_core", "name_skel", "addr_alpha", "addr_nums"]
    best = pairs.select("q", "r", "p", F.row_number().over(W.partitionBy("q").orderBy(F.desc("p"), "r")).alias("place")).where((F.col("place") <= top) & (F.col("p") >= least))
    own = pool.select(F.col("id").alias("r"), *[F.col(c).alias(f"x_{c}") for c in columns])
    sib = pool.select(F.col("id").alias("sib"), *[F.col(c).alias(f"y_{c}") for c in columns])
    sibs = best.select("q", F.col("r").alias("sib"), F.col("p").alias("sp"), "place").join(sib, "sib")
    sibs = sibs.groupBy("q").agg(F.collect_list(F.struct(*[c for c in sibs.columns if c != "q"])).alias("_sibs"))
    met = pairs.select("q", "r").join(own, "r").join(sibs, "q").withColumn("_sib", F.explode("_sibs")).select("q", "r", *[f"x_{c}" for c in columns], "_sib.*").where("r <> sib")
    hnum = lambda s: F.substring_index(f"{s}_addr_nums", " ", 1)
    met = met.withColumns(
        {
            "addr": sim.token_set_udf("x_addr_clean", "y_addr_clean"), "name": sim.token_set_udf("x_name_core", "y_name_core"),
            "skel": sim.ratio_udf("x_name_skel", "y_name_skel"), "alpha": sim.token_set_udf("x_addr_alpha", "y_addr_alpha"),
            "hnum": ((hnum("x") != "") & (hnum("x") == hnum("y"))).cast("double"),
        }
    )
    agg = met.groupBy("q", "r").agg(
        *[F.max(k).alias(f"sib_{k}_max") for k in ("addr", "name", "skel", "alpha", "hnum")],
        F.round(F.sum(F.col("sp") * F.col("addr")) / F.greatest(F.sum("sp"), F.lit(1e-6)), 6).alias("sib_addr_wmean"),
        F.count(F.lit(1)).alias("sib_n"), F.min_by("addr", "place").alias("sib_top1_addr"), F.min_by("name", "place").alias("sib_top1_name"),
    )
    return pairs.join(agg, ["q", "r"], "left").fillna(0, [c for c in agg.columns if c.startswith("sib_")])


GROUPS = {"addr": "addr_clean", "name": "name_core", "hnum": "hnum_text"}


def group_features(pairs: DataFrame, pool: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """Probability mass of a record's group (equal address, name, house number, ...) within its query.

    An empty value is a group of its own; groups given as numbers (legal, profile) have no empty value.
    """
    groups = groups or GROUPS
    records = pool.withColumn("hnum_text", F.substring_index("addr_nums", " ", 1)) if "addr_nums" in pool.columns else pool
    own = records.select("id", *[F.col(c).cast("string").alias(f"_{k}") for k, c in groups.items()])
    known = own.select(F.col("id").alias("r"), *[f"_{k}" for k in groups])
    for k in groups:  # a group goes by its least id, so pairs carry no texts
        least = own.groupBy(F.col(f"_{k}").alias("_v")).agg(F.min("id").alias("_least"))
        number = F.when(F.col(f"_{k}") == "", F.col("r")).otherwise(F.col("_least"))
        known = known.join(least, F.col(f"_{k}").eqNullSafe(F.col("_v"))).withColumn(f"_{k}", number).drop("_v", "_least")
    out = pairs.join(known, "r").repartition("q")  # one exchange for all windows
    total = F.sum("p").over(W.partitionBy("q"))
    for k in groups:
        out = out.withColumn("_g", F.col(f"_{k}"))
        mass = F.sum("p").over(W.partitionBy("q", "_g"))
        out = out.withColumns({"_mass": mass, f"grp_{k}_n": F.count(F.lit(1)).over(W.partitionBy("q", "_g"))})
        out = out.withColumns(
            {
                f"grp_{k}_psum_oth": F.round(F.col("_mass") - F.col("p"), 6),
                f"grp_{k}_share": F.round(F.col("_mass") / F.greatest(total, F.lit(1e-6)), 6),
                f"grp_{k}_gap": F.round(F.max("_mass").over(W.partitionBy("q")) - F.col("_mass"), 6),
            }
        ).drop("_g", "_mass")
    return out.drop(*[f"_{k}" for k in groups])
