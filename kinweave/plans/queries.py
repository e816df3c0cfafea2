"""Registered queries of the linkage operators, with the SQL that they must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import diagnostics as DG
from ..operators import features as FT
from ..operators import metric as M
from ..operators import model as MD
from ..operators import retrieval as R
from ..operators import selection as SEL
from ..sources import tables as T
from . import entities as E
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- records and normalisation -------------------------------------------------------------------------------------


@query(f"WITH {S.UNIVERSE} SELECT id, business_name, business_address, country, leader, is_ref FROM ent")
def entity_view(spark: SparkSession, d: str) -> DataFrame:
    return E.universe(spark, d).select("id", "business_name", "business_address", "country", "leader", "is_ref")


@query(f"""WITH {S.PREPARED} SELECT id, array_to_string(nc, ' ') AS name_clean, array_to_string(core, ' ') AS name_core, compact AS name_compact,
    array_to_string(sk, ' ') AS name_skel FROM full_""")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.normalize import normalize_names as run

    return run(E.universe(spark, d), ascii_only=True).select("id", "name_clean", "name_core", "name_compact", "name_skel")


@query(f"""WITH {S.PREPARED} SELECT id, array_to_string(ac, ' ') AS addr_clean, array_to_string(nu, ' ') AS addr_nums, array_to_string(al, ' ') AS addr_alpha,
    array_to_string(ask, ' ') AS addr_skel, addr_empty FROM full_""")
def normalize_addresses(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.normalize import normalize_addresses as run

    return run(E.universe(spark, d), ascii_only=True).select("id", "addr_clean", "addr_nums", "addr_alpha", "addr_skel", "addr_empty")


@query(r"""SELECT doc_id, md5(f) AS folded_md5, len(regexp_extract_all(f, '[a-z0-9]+'))::INT AS n_words, NOT regexp_full_match(coalesce(text, ''), '[\x00-\x7F]*') AS folded
    FROM (SELECT doc_id, text, lower(strip_accents(replace(replace(coalesce(text, ''), chr(8217), chr(39)), chr(8216), chr(39)))) AS f FROM documents)""")
def fold_texts(spark: SparkSession, d: str) -> DataFrame:
    """Folding and words of whole texts in every script; the SQL holds as long as no compatibility forms occur."""
    from ..functions.normalize import fold, words

    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias("text"), fold(text).alias("f"))
    return docs.select("doc_id", F.md5(F.encode("f", "UTF-8")).alias("folded_md5"), F.size(words(F.col("f"))).alias("n_words"), (~F.col("text").rlike(r"\A[\x00-\x7F]*\z")).alias("folded"))


# ---- retrieval -----------------------------------------------------------------------------------------------------


@query(f"{S.pairs()}, {S.base()} SELECT q, r, score FROM base")
def channel_base(spark: SparkSession, d: str) -> DataFrame:
    return R.base(E.index(spark, d))


@query(f"{S.pairs()} {S.top(200, 'name_cos + addr_cos')}")
def channel_base_wide(spark: SparkSession, d: str) -> DataFrame:
    return R.base_wide(E.index(spark, d))


@query(f"{S.pairs(None)} {S.top(20, 'addr_cos')}")
def channel_addr_only(spark: SparkSession, d: str) -> DataFrame:
    return R.addr_only(E.index(spark, d))


@query(f"{S.pairs()}, bare AS (SELECT p.* FROM prs p JOIN full_ f ON p.r = f.id WHERE addr_empty) {S.top(10, 'name_cos', 'bare')}")
def channel_name_noaddr(spark: SparkSession, d: str) -> DataFrame:
    return R.name_noaddr(E.index(spark, d))


@query(f"WITH {S.PREPARED}, {S.KEYS}, {S.conj_pairs()} {S.top(50, 'c', 'cprs')}")
def channel_conj(spark: SparkSession, d: str) -> DataFrame:
    return R.conj(E.index(spark, d))


@query(f"WITH {S.PREPARED}, {S.KEYS}, {S.bm25_pairs()} {S.top(50, 'c', 'bprs')}")
def channel_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(E.index(spark, d))


@query(f"WITH {S.PREPARED}, {S.RESCUE} SELECT q, r, score FROM resc")
def channel_rescue(spark: SparkSession, d: str) -> DataFrame:
    return R.rescue(E.index(spark, d))


@query(f"""{S.pairs(2000)}, kept AS (SELECT q, r FROM ({S.top(40, 'name_cos + addr_cos')}) UNION SELECT q, r FROM ({S.top(10, 'name_cos')}))
    SELECT q, r, name_cos, addr_cos FROM prs JOIN kept USING (q, r)""")
def legacy_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.legacy_candidates(E.index(spark, d))


# ---- fusion, dense, labels, metrics --------------------------------------------------------------------------------

_FUSED = f"""{S.pairs()}, {S.base()}, {S.conj_pairs()}, {S.RESCUE},
l1 AS (SELECT q, r, score, 'base' AS ch FROM base), l2 AS (SELECT *, 'conj' AS ch FROM ({S.top(20, 'c', 'cprs')})), l3 AS (SELECT q, r, score, 'rescue' AS ch FROM resc),
lr AS (SELECT *, row_number() OVER (PARTITION BY ch, q ORDER BY score DESC, r) AS rank FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)),
fused AS (SELECT q, r, round(sum(1 / (60 + rank)), 9) AS rrf, count(*) AS n_ch, coalesce(min(rank) FILTER (ch = 'base'), 999)::INT AS rank_base,
  coalesce(min(rank) FILTER (ch = 'conj'), 999)::INT AS rank_conj, coalesce(min(rank) FILTER (ch = 'rescue'), 999)::INT AS rank_rescue FROM lr GROUP BY ALL)"""


@query(f"""{_FUSED} SELECT f.*, coalesce(name_cos, 0) AS name_cos, coalesce(addr_cos, 0) AS addr_cos
    FROM (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY q ORDER BY rrf DESC, r) <= 30 OR rank_rescue < 999) f LEFT JOIN prs USING (q, r)""")
def retrieve_fused(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve(E.index(spark, d), "base,conj:20,rescue", m=30)


@query(f"WITH {S.UNIVERSE}, {S.TRUTH} SELECT id AS r, q AS owner FROM ent LEFT JOIN truth ON id = r WHERE NOT is_ref")
def owner_map(spark: SparkSession, d: str) -> DataFrame:
    return M.owners(E.universe(spark, d).where("not is_ref"), E.truth(spark, d))


def _scored(spark: SparkSession, d: str) -> tuple[R.Index, DataFrame]:
    """Base candidates with a plain score p, for the operators that follow a model."""
    index = E.index(spark, d)
    pairs = index.home.save(R.base_pairs(index).drop("score"), "base_pairs")
    return index, pairs.withColumn("p", F.round(0.6 * F.col("name_cos") + 0.4 * F.col("addr_cos"), 6))


def _refs(index: R.Index) -> DataFrame:
    return index.queries.select(F.col("id").alias("q"), "country")


_S = f"{S.pairs()}, {S.TRUTH}, {S.SCORED}, refs AS (SELECT id AS q, country FROM ent WHERE is_ref)"
_WON = "won AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY p DESC, q) = 1)"
_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END"


def _macro(pred: str) -> str:
    return f"""rows_ AS (SELECT refs.q, country, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM refs
  LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q)
  LEFT JOIN (SELECT p.q, count(*) AS n_pred, count(t.r) AS tp FROM {pred} p LEFT JOIN truth t ON p.q = t.q AND p.r = t.r GROUP BY p.q) USING (q))"""


_RATES = f"""count(*) AS records, round(avg({_F05}), 6) AS macro_f05, round(coalesce(sum(tp) / nullif(sum(n_pred), 0), 0), 6) AS "precision",
  round(coalesce(sum(tp) / nullif(sum(n_true), 0), 0), 6) AS recall"""


@query(f"{_S}, {_WON} SELECT q, r, p FROM won WHERE p >= 0.5")
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    return SEL.select(_scored(spark, d)[1], SEL.Rule("threshold", thr=0.5)).select("q", "r", "p")


_EXPF = f"""{_S}, eff AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY p DESC, q) = 1 THEN p ELSE 0.0 END AS e FROM scored),
x1 AS (SELECT *, row_number() OVER w AS k, sum(e) OVER (PARTITION BY q ORDER BY e DESC, r ROWS UNBOUNDED PRECEDING) AS s, sum(e) OVER (PARTITION BY q) AS t,
  exp(sum(ln(1 - least(greatest(e, 0), 1 - 1e-7))) OVER (PARTITION BY q)) AS ef0 FROM eff WINDOW w AS (PARTITION BY q ORDER BY e DESC, r)),
x2 AS (SELECT *, 1.25 * s / (0.25 * t + k) AS ef FROM x1), x3 AS (SELECT *, max(ef) OVER (PARTITION BY q) AS best FROM x2),
x4 AS (SELECT *, min(CASE WHEN ef >= best THEN k END) OVER (PARTITION BY q) AS kb FROM x3)"""


@query(f"{_EXPF} SELECT q, r, p FROM x4 WHERE k <= kb AND best > ef0 AND e >= 0.2")
def select_expected_f(spark: SparkSession, d: str) -> DataFrame:
    return SEL.select(_scored(spark, d)[1], SEL.Rule("expf", floor=0.2)).select("q", "r", "p")


@query(f"""{_S}, {_WON}, keep AS (SELECT q, r FROM won WHERE p >= 0.5), {_macro('keep')} SELECT country, {_RATES} FROM rows_ GROUP BY country""")
def macro_f05_by_country(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return M.macro_f05(SEL.select(pairs, SEL.Rule(thr=0.5)), E.truth(spark, d), _refs(index), "country")


@query(f"""{_S}, keep AS (SELECT s.q, s.r FROM scored s JOIN truth t ON s.q = t.q AND s.r = t.r), {_macro('keep')} SELECT {_RATES} FROM rows_""")
def oracle_macro_f05(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return M.oracle_f05(pairs, E.truth(spark, d), _refs(index))


@query(f"""{_S}, rk AS (SELECT s.q, s.r, country, t.r IS NOT NULL AS y, row_number() OVER (PARTITION BY s.q ORDER BY round(name_cos + addr_cos, 6) DESC, s.r) AS rank
    FROM scored s JOIN refs USING (q) LEFT JOIN truth t ON s.q = t.q AND s.r = t.r),
  a AS (SELECT coalesce(country, '(all)') AS country, count(*) AS pairs, sum(y::INT) AS hits, {', '.join(f'count(*) FILTER (y AND rank <= {k}) AS h{k}' for k in (1, 3, 5, 10, 20, 30))}
    FROM rk GROUP BY ROLLUP (country)),
  b AS (SELECT coalesce(country, '(all)') AS country, count(*) AS n_true FROM truth JOIN refs USING (q) GROUP BY ROLLUP (country)),
  c AS (SELECT coalesce(country, '(all)') AS country, count(*) AS n_ref FROM refs GROUP BY ROLLUP (country))
  SELECT country, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / n_ref, 6) AS pairs_per_ref, round(coalesce(hits / nullif(n_true, 0), 0), 6) AS recall,
  {', '.join(f'round(coalesce(h{k} / nullif(n_true, 0), 0), 6) AS recall_at_{k}' for k in (1, 3, 5, 10, 20, 30))} FROM c LEFT JOIN b USING (country) LEFT JOIN a USING (country)""")
def blocking_report(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return M.blocking_report(pairs, E.truth(spark, d), _refs(index))


@query(f"""{_S}, {_WON}, thr AS (SELECT unnest([{', '.join(map(str, SEL.TUNE_GRID))}])::DOUBLE AS thr),
  f AS (SELECT thr, w.q, count(*) AS n_pred, count(t.r) AS tp FROM won w JOIN thr ON p >= thr LEFT JOIN truth t ON w.q = t.q AND w.r = t.r GROUP BY ALL),
  e AS (SELECT thr, q, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM refs CROSS JOIN thr
    LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q) LEFT JOIN f USING (thr, q))
  SELECT thr, round(avg({_F05}), 6) AS macro_f05 FROM e GROUP BY thr""")
def tune_threshold(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return SEL.tune_threshold(pairs, E.truth(spark, d), _refs(index))


@query(f"""{_S}, {_WON}, keep AS (SELECT q, r, p FROM won WHERE p >= 0.5)
  SELECT refs.q AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM refs LEFT JOIN
  (SELECT q, string_agg(r::VARCHAR, ',' ORDER BY -p, r) AS ids FROM keep GROUP BY q) USING (q)""")
def link_records(spark: SparkSession, d: str) -> DataFrame:
    """End to end: normalise, block, score, select exclusively, list ids per reference record."""
    index, pairs = _scored(spark, d)
    kept = SEL.select(pairs, SEL.Rule(thr=0.5)).withColumn("rank", -F.col("p"))
    return T.id_lists(_refs(index), kept)


@query(f"""{_S}, c AS (SELECT *, round(name_cos + addr_cos, 6) AS comb FROM scored)
  SELECT q, r, comb, rank() OVER (PARTITION BY q ORDER BY comb DESC) AS comb_rank_s1, round(comb - max(comb) OVER (PARTITION BY q), 6) AS comb_gap_s1,
  rank() OVER (PARTITION BY r ORDER BY comb DESC) AS comb_rank_r, round(comb - max(comb) OVER (PARTITION BY r), 6) AS comb_gap_r,
  count(*) OVER (PARTITION BY q) AS n_cand_s1, count(*) OVER (PARTITION BY r) AS n_cand_r FROM c""")
def context_features(spark: SparkSession, d: str) -> DataFrame:
    return FT.context(_scored(spark, d)[1]).select("q", "r", "comb", "comb_rank_s1", "comb_gap_s1", "comb_rank_r", "comb_gap_r", "n_cand_s1", "n_cand_r")


@query(f"""{_S}, c AS (SELECT *, round(addr_cos - max(addr_cos) OVER (PARTITION BY r), 6) AS addr_gap_r FROM scored)
  SELECT q, r, least(rank() OVER (PARTITION BY q ORDER BY name_cos DESC), 2048) AS name_rank_s1, round(name_cos - max(name_cos) OVER (PARTITION BY q), 6) AS name_gap_s1,
  least(rank() OVER (PARTITION BY r ORDER BY name_cos DESC), 2048) AS name_rank_r, round(name_cos - max(name_cos) OVER (PARTITION BY r), 6) AS name_gap_r,
  least(rank() OVER (PARTITION BY r ORDER BY addr_cos DESC), 2048) AS addr_rank_r, addr_gap_r, least(sum((addr_gap_r >= -0.02)::INT) OVER (PARTITION BY r), 2048)::BIGINT AS addr_ties_r FROM c""")
def context2_features(spark: SparkSession, d: str) -> DataFrame:
    names = ["name_rank_s1", "name_gap_s1", "name_rank_r", "name_gap_r", "addr_rank_r", "addr_gap_r", "addr_ties_r"]
    return FT.context2(_scored(spark, d)[1]).select("q", "r", *names)


@query(f"""{_S}, s2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, r) AS rn, rank() OVER (PARTITION BY q ORDER BY p DESC) AS rk,
    max(p) OVER (PARTITION BY q) AS mx, sum(p) OVER (PARTITION BY q) AS t FROM scored),
  s3 AS (SELECT *, coalesce(max(CASE WHEN rn = 2 THEN p END) OVER (PARTITION BY q), 0) AS second FROM s2)
  SELECT q, r, rk AS p1_rank_s1, round(p - mx, 6) AS p1_gap_s1, second AS p1_second_s1, round(CASE WHEN rk = 1 THEN p - second ELSE p - mx END, 6) AS p1_margin,
  round(t, 6) AS p1_sum_s1, round(t - p, 6) AS p1_sum_others, (sum((p >= 0.5)::INT) OVER (PARTITION BY q))::BIGINT AS p1_cnt50_s1,
  round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / least(greatest(1 - p, 1e-6), 1)), 6) AS p1_logit FROM s3""")
def p_context(spark: SparkSession, d: str) -> DataFrame:
    names = ["p1_rank_s1", "p1_gap_s1", "p1_second_s1", "p1_margin", "p1_sum_s1", "p1_sum_others", "p1_cnt50_s1", "p1_logit"]
    return FT.p_context(_scored(spark, d)[1]).select("q", "r", *names)


_SIDED = f"{_S}, pp AS (SELECT s.q, s.r, s.p, a.core AS lcore, b.core AS rcore, a.ac AS lac, b.ac AS rac, a.nu AS lnu, b.nu AS rnu FROM scored s JOIN full_ a ON s.q = a.id JOIN full_ b ON s.r = b.id)"


@query(f"""{_SIDED}, ca AS (SELECT ac, count(*) AS n FROM full_ WHERE is_ref AND len(ac) > 0 GROUP BY ac)
  SELECT q, r, coalesce(x.n, 0) AS l_addr_dup, coalesce(y.n, 0) AS r_addr_dup, (lac = rac AND len(lac) > 0)::INT AS a_exact
  FROM pp LEFT JOIN ca x ON lac = x.ac LEFT JOIN ca y ON rac = y.ac""")
def crowd_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return FT.crowd_features(pairs, index.queries, index.pool).select("q", "r", "l_addr_dup", "r_addr_dup", "a_exact")


@query(f"""{_SIDED}, c1 AS (SELECT core, count(*) AS n FROM full_ WHERE is_ref AND len(core) > 0 GROUP BY core), c2 AS (SELECT core, count(*) AS n FROM full_ WHERE NOT is_ref AND len(core) > 0 GROUP BY core)
  SELECT q, r, coalesce(x.n, 0) AS l_name_s1dup, coalesce(y.n, 0) AS r_name_s1cnt, coalesce(z.n, 0) AS r_name_s23cnt
  FROM pp LEFT JOIN c1 x ON lcore = x.core LEFT JOIN c1 y ON rcore = y.core LEFT JOIN c2 z ON rcore = z.core""")
def name_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return FT.name_ambiguity(pairs, index.queries, index.pool).select("q", "r", "l_name_s1dup", "r_name_s1cnt", "r_name_s23cnt")


@query(f"""{_SIDED} SELECT q, r, CASE WHEN len(lnu) > 0 AND len(rnu) > 0 THEN round(len(list_intersect(list_distinct(lnu), list_distinct(rnu))) / len(list_distinct(list_concat(lnu, rnu))), 6) ELSE 0 END AS a_num_jac,
  CASE WHEN len(lnu) > 0 AND len(rnu) > 0 THEN list_contains(rnu, lnu[1])::INT ELSE 0 END AS a_first_num_eq FROM pp""")
def number_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    sided = FT.with_sides(pairs, index.queries, index.pool, ["addr_nums"])
    return FT.number_features(sided).select("q", "r", F.col("a_num_jac").cast("double").alias("a_num_jac"), "a_first_num_eq")


@query(f"""{_SIDED}, n AS (SELECT id, business_address <> '' AS has FROM ent)
  SELECT pp.q, pp.r, (lcore = rcore)::INT AS n_core_eq, greatest(len(lcore), 1)::INT AS n_ntok_l, greatest(len(rcore), 1)::INT AS n_ntok_r,
  round(CASE WHEN lcore = rcore THEN 1 ELSE jaro_winkler_similarity(array_to_string(lcore, ' '), array_to_string(rcore, ' ')) END, 6) AS n_jw,
  (NOT y.has)::INT AS r_empty, x.has::INT AS l_ncomp, y.has::INT AS r_ncomp FROM pp JOIN n x ON x.id = pp.q JOIN n y ON y.id = pp.r""")
def pair_flags(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the string features that plain SQL can say."""
    index, pairs = _scored(spark, d)
    names = ["n_core_eq", "n_ntok_l", "n_ntok_r", "r_empty", "l_ncomp", "r_ncomp"]
    return FT.string_features(pairs, index.queries, index.pool).select("q", "r", *names, "n_jw")


@query()
def string_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return FT.house_number_features(FT.string_features(pairs, index.queries, index.pool), index.queries, index.pool)


def _minus(a: str, b: str) -> str:
    return f"bit_count({a} & ~{b})::INT"


@query(f"""{_S}, {S.profiles(FT.legal_bits(), FT.noise_bits(), FT.sound_bits())}, nl AS (SELECT core, legal, count(*) AS n FROM pro WHERE is_ref GROUP BY core, legal),
  f AS (SELECT s.*, a.core AS lc, b.core AS rc, a.legal AS ll, b.legal AS rl, a.noise AS ln_, b.noise AS rn, a.wsig AS lw, b.wsig AS rw, a.hnum AS lh, b.hnum AS rh, a.hlen AS lhl, b.hlen AS rhl,
    a.hnum >= 0 AND b.hnum >= 0 AS both_, abs(a.hnum - b.hnum) AS off_ FROM scored s JOIN pro a ON s.q = a.id JOIN pro b ON s.r = b.id),
  g AS (SELECT *, CASE WHEN both_ AND off_ > 0 THEN length(off_::VARCHAR) ELSE 0 END AS mag FROM f)
  SELECT q, r, name_cos, addr_cos, p, coalesce(x.n, 0) AS namelg_s1dup, coalesce(y.n, 0) AS namelg_r_s1cnt, bit_count(ll)::INT AS lg_l_n, bit_count(rl)::INT AS lg_r_n,
  {_minus('rl', 'll')} AS lg_add, {_minus('ll', 'rl')} AS lg_drop, bit_count(rl & ~ll & ~{FT.BIT['PVT'] | FT.BIT['LTD']}::BIGINT)::INT AS lg_add_other, (ll = rl)::INT AS lg_same,
  (((ll & {FT.BIT['PUB']}) > 0) <> ((rl & {FT.BIT['PUB']}) > 0))::INT AS lg_pub_flip, {_minus('rw', 'lw')} AS w_extra, {_minus('lw', 'rw')} AS w_miss, (lw = rw)::INT AS w_same,
  {_minus('rn', 'ln_')} AS nz_extra, both_::INT AS hn_both, (both_ AND off_ = 0)::INT AS hn_eq, mag::INT AS hn_diff_mag, CASE WHEN both_ THEN mag - lhl ELSE 0 END::INT AS hn_diff_lead, (lhl = rhl)::INT AS hn_len_eq
  FROM g LEFT JOIN nl x ON x.core = lc AND x.legal = ll LEFT JOIN nl y ON y.core = rc AND y.legal = rl""")
def profile_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return FT.profile_features(pairs, FT.profiles(index.queries), FT.profiles(index.pool))


@query()
def stack_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return MD.stack_features(pairs, index.pool)[0]


@query(f"""{_S}, g AS (SELECT s.*, CASE WHEN len(ac) = 0 THEN '#' || r ELSE array_to_string(ac, ' ') END AS gk FROM scored s JOIN full_ f ON s.r = f.id),
  m AS (SELECT *, sum(p) OVER (PARTITION BY q, gk) AS mass, count(*) OVER (PARTITION BY q, gk) AS n, sum(p) OVER (PARTITION BY q) AS t FROM g)
  SELECT q, r, n AS grp_addr_n, round(mass - p, 6) AS grp_addr_psum_oth, round(mass / greatest(t, 1e-6), 6) AS grp_addr_share,
  round(max(mass) OVER (PARTITION BY q) - mass, 6) AS grp_addr_gap FROM m""")
def group_features(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return FT.group_features(pairs, index.pool, {"addr": "addr_clean"}).select("q", "r", "grp_addr_n", "grp_addr_psum_oth", "grp_addr_share", "grp_addr_gap")


@query()
def train_predict(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of boosted trees, calibrated across folds."""
    index, pairs = _scored(spark, d)
    labelled = M.label_pairs(FT.context2(FT.context(pairs)), E.truth(spark, d)).drop("p")
    names = ["name_cos", "addr_cos", "comb_rank_s1", "comb_gap_s1", "comb_rank_r", "comb_gap_r", "n_cand_s1", "name_rank_s1", "name_gap_r", "addr_ties_r"]
    scored, _ = MD.out_of_fold(labelled, names, MD.Config(trees=5, depth=3, folds=2))
    return MD.cross_calibrate(scored).select("q", "r", "y", "fold", "p", "p_cal")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  p AS (SELECT a.vec_id AS q, b.vec_id AS r, round(2 + list_cosine_similarity(a.v, b.v), 6) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0)
  SELECT q, r, round(s - 2, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, r) <= 10""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every id divisible by 20 against all rows, itself among them."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.dense_topk(e.where("id % 20 = 0"), e, 10)


@query(f"""WITH {S.UNIVERSE}, {S.TRUTH}, n AS (SELECT e.id, count(r) AS m FROM ent e LEFT JOIN truth ON e.id = q WHERE is_ref GROUP BY e.id)
  SELECT least(m, 15) AS matches, count(*) AS records FROM n GROUP BY 1""")
def match_histogram(spark: SparkSession, d: str) -> DataFrame:
    return DG.match_histogram(E.universe(spark, d).where("is_ref").select(F.col("id").alias("q")), E.truth(spark, d))


@query(f"""WITH {S.UNIVERSE} SELECT country, count(*) AS records, count_if(business_name = '') AS empty_names, count_if(business_address = '') AS empty_addresses,
  count_if(regexp_matches(business_address, '\\bnull\\b')) AS null_like, count_if(NOT regexp_matches(business_name, '[a-z]')) AS not_latin,
  round(avg(length(business_name)), 6) AS name_chars, round(avg(length(business_address)), 6) AS address_chars FROM ent GROUP BY country""")
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    return DG.file_stats(E.records(spark, d))


@query(f"WITH {S.UNIVERSE}, {S.TRUTH} SELECT count(*) AS pairs, round(corr(q, r), 6) AS id_corr, round(median(abs(q - r)), 6) AS median_gap FROM truth")
def id_leakage(spark: SparkSession, d: str) -> DataFrame:
    return DG.id_leakage(E.truth(spark, d))


def _missed(spark: SparkSession, d: str) -> DataFrame:
    """True pairs with bucket features; missed where the base channel does not have them."""
    index = E.index(spark, d)
    true = R.pair_cos(index, E.truth(spark, d), 2500).withColumn("comb", F.col("name_cos") + F.col("addr_cos"))
    found = R.base(index, k_comb=3, k_name=1).select("q", "r", F.lit(False).alias("missed"))
    return DG.pair_table(true.select("q", "r", "comb").join(found, ["q", "r"], "left").fillna(True, ["missed"]), index.queries, index.pool)


@query(f"{S.pairs()}, {S.TRUTH}, {S.MISSED} {S.modes(DG.MODES)}")
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return DG.mode_by_country(DG.assign_modes(_missed(spark, d).where("missed")))


@query(f"{S.pairs()}, {S.TRUTH}, {S.MISSED} {S.flags(DG.FLAGS)}")
def flag_table(spark: SparkSession, d: str) -> DataFrame:
    return DG.flag_table(_missed(spark, d))


@query(f"""WITH {S.PREPARED}, {S.TRUTH},
  sizes AS (SELECT q, count(*) AS n, max(regexp_matches(business_name, '[\u0900-\u0D7F]')::INT) AS nat FROM truth JOIN full_ ON r = id GROUP BY q),
  own AS (SELECT id, coalesce(n, 0) AS n, coalesce(nat, 0) AS nat, count(*) OVER (PARTITION BY ac) >= 2 AND len(ac) > 0 AS shared FROM full_ LEFT JOIN sizes ON id = q WHERE is_ref)
  SELECT slice, count(*) AS records FROM (SELECT unnest([CASE WHEN n = 0 THEN 'singleton' END, CASE WHEN nat = 1 THEN 'true_native' END, CASE WHEN n > 0 AND nat = 0 THEN 'true_latin_only' END,
    CASE WHEN n = 1 THEN 'true_size_1' END, CASE WHEN n BETWEEN 2 AND 4 THEN 'true_size_2_4' END, CASE WHEN n >= 5 THEN 'true_size_5p' END,
    CASE WHEN shared THEN 's1_addr_shared' END, CASE WHEN NOT shared THEN 's1_addr_unique' END]) AS slice FROM own) WHERE slice IS NOT NULL GROUP BY slice""")
def eval_slices(spark: SparkSession, d: str) -> DataFrame:
    index = E.index(spark, d)
    return DG.slices(index.queries, index.pool, E.truth(spark, d)).groupBy("slice").agg(F.count(F.lit(1)).alias("records"))


@query(f"""{S.pairs()}, {S.base()}, {S.conj_pairs()}, {S.bm25_pairs()}, {S.RESCUE}, {S.TRUTH},
  ch AS (SELECT 'base' AS channel, q, r FROM base UNION ALL SELECT 'conj', q, r FROM ({S.top(20, 'c', 'cprs')}) UNION ALL SELECT 'bm25', q, r FROM ({S.top(20, 'c', 'bprs')})
    UNION ALL SELECT 'rescue', q, r FROM resc UNION ALL SELECT 'addr_only', q, r FROM ({S.top(20, 'addr_cos')}))
  SELECT channel, count(*) AS pairs, count(t.q) AS hits, count_if(b.q IS NULL)::BIGINT AS new_pairs, count(CASE WHEN b.q IS NULL THEN t.q END) AS new_hits
  FROM ch LEFT JOIN base b ON b.q = ch.q AND b.r = ch.r LEFT JOIN truth t ON t.q = ch.q AND t.r = ch.r GROUP BY channel""")
def channel_gain(spark: SparkSession, d: str) -> DataFrame:
    index = E.index(spark, d)
    lists = {"base": R.base(index), "conj": R.conj(index, 20), "bm25": R.bm25(index, 20), "rescue": R.rescue(index), "addr_only": R.addr_only(index, cap=2500)}
    return M.channel_gain({name: index.home.save(found, f"list_{name}") for name, found in lists.items()}, E.truth(spark, d))


@query(f"""{_S}, {_WON}, z AS (SELECT won.*, country, ln(least(greatest(p, 1e-6), 1 - 1e-6) / least(greatest(1 - p, 1e-6), 1.0)) AS z FROM won JOIN refs USING (q)),
  o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY z DESC) AS k FROM z), n AS (SELECT country, count(*) AS n FROM refs GROUP BY country)
  SELECT country, round(0 - z, 6) AS delta FROM o JOIN n USING (country) WHERE k = greatest(1, round(n * 0.3))""")
def count_match(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return SEL.count_match(pairs, _refs(index), 0.5, 0.3)


@query(f"""{_S}, {_WON}, l AS (SELECT refs.q, list(won.r) FILTER (won.r IS NOT NULL) AS ids FROM refs LEFT JOIN won ON won.q = refs.q AND p >= 0.5 GROUP BY refs.q),
  x AS (SELECT q, unnest(ids) AS r FROM l)
  SELECT 'repeated reference' AS "check", (SELECT count(*) FROM (SELECT q FROM l GROUP BY q HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'missing reference', (SELECT count(*) FROM refs ANTI JOIN l USING (q)) UNION ALL SELECT 'unknown reference', (SELECT count(*) FROM l ANTI JOIN refs USING (q))
  UNION ALL SELECT 'repeated id', (SELECT count(*) FROM l WHERE len(ids) <> len(list_distinct(ids)))
  UNION ALL SELECT 'unknown id', (SELECT count(*) FROM x ANTI JOIN (SELECT id AS r FROM ent WHERE NOT is_ref) USING (r))""")
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    index = E.index(spark, d)
    return T.contract_checks(link_records(spark, d), _refs(index), index.pool)


@query(f"""{S.pairs()}, {S.TRUTH}, c AS (SELECT q, r, name_cos + addr_cos AS comb FROM prs), m AS (SELECT t.q, t.r, coalesce(comb, 0) AS mine FROM truth t LEFT JOIN c USING (q, r))
  SELECT m.q, m.r, CASE WHEN any_value(mine) > 0 THEN count(c.q) + 1 ELSE 0 END AS comb_rank FROM m LEFT JOIN c ON c.q = m.q AND c.comb > mine + 1e-6 GROUP BY m.q, m.r""")
def true_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.true_rank(E.index(spark, d), E.truth(spark, d))


_RANKS = f"""{_S}, c AS (SELECT q, r, name_cos + addr_cos AS comb FROM prs), m AS (SELECT t.q, t.r, coalesce(comb, 0) AS mine FROM truth t LEFT JOIN c USING (q, r)),
  tr AS (SELECT m.q, m.r, CASE WHEN any_value(mine) > 0 THEN count(c.q) + 1 ELSE 0 END AS comb_rank FROM m LEFT JOIN c ON c.q = m.q AND c.comb > mine + 1e-6 GROUP BY m.q, m.r)"""


@query(f"""{_RANKS} SELECT country, count(*) AS pairs, count_if(comb_rank = 0)::BIGINT AS without_key,
  {', '.join(f'round(quantile_cont(comb_rank, {x}) FILTER (comb_rank > 0), 6) AS rank_p{round(100 * x)}' for x in (0.5, 0.9, 0.99))} FROM tr JOIN refs USING (q) GROUP BY country""")
def rank_quantiles(spark: SparkSession, d: str) -> DataFrame:
    index = E.index(spark, d)
    return DG.rank_quantiles(R.true_rank(index, E.truth(spark, d)), _refs(index))


@query(f"""{_S}, rk AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY round(name_cos + addr_cos, 6) DESC, r) AS rank FROM scored),
  f AS (SELECT country, CASE WHEN rank IS NULL THEN 'absent' WHEN rank <= 1 THEN '1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 30 THEN '11-30' ELSE '31+' END AS bucket
    FROM truth JOIN refs USING (q) LEFT JOIN rk USING (q, r))
  SELECT coalesce(country, '(all)') AS country, bucket, count(*) AS pairs FROM f GROUP BY GROUPING SETS ((country, bucket), (bucket))""")
def presence(spark: SparkSession, d: str) -> DataFrame:
    """Where true pairs stand among the base candidates."""
    index, pairs = _scored(spark, d)
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round(F.col("name_cos") + F.col("addr_cos"), 6)), "r"))
    found = E.truth(spark, d).join(_refs(index), "q").join(pairs.select("q", "r", place.alias("rank")), ["q", "r"], "left")
    return DG.presence_table(found)


@query(f"""{_S}, {_WON}, n AS (SELECT refs.q, country, count(won.r) AS n FROM refs LEFT JOIN won ON won.q = refs.q AND p >= 0.5 GROUP BY ALL)
  SELECT country, count(*) AS records, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS per_record, round(avg((n = 0)::INT::DOUBLE), 6) AS share_without FROM n GROUP BY country""")
def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return DG.selection_stats(SEL.select(pairs, SEL.Rule(thr=0.5)), _refs(index))


@query()
def fit_predict(spark: SparkSession, d: str) -> DataFrame:
    """Learns on the training part of the reference records and selects matches for the rest; small trees, to show the path."""
    from . import run

    queries, pool = E.sides(spark, d)
    part = MD.holdout_split(F.col("id"))
    small = MD.Config(trees=4, depth=3, folds=2)
    options = run.Options(channels="base,conj:10,rescue", stage1=small, stage2=small, text_features=False)
    work = T.work_folder(spark, "fit_predict")
    ours = queries.where(part == "train")
    owners = E.truth(spark, d)
    _, _, said = run.learn(R.Index(ours, pool), owners.join(ours.select(F.col("id").alias("q")), "q", "left_semi"), work, options)
    other = R.Index(queries.where(part != "train"), pool)
    scored, rule = run.predict(other, work, said["key"], options)
    return SEL.select(scored, rule).select("q", "r", "p")


@query(f"{_S}, {S.conj_pairs()} SELECT b.q, b.r, round(coalesce(c, 0), 6) AS conj_cos FROM base b LEFT JOIN cprs USING (q, r)")
def pair_conj_cos(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    return R.pair_conj_cos(index, pairs.select("q", "r"))


@query(f"""{_S}, {S.CRC}, g AS (SELECT id, unnest(list_transform(range(1, greatest(length(business_name), 1) + 1), lambda i: substr(' ' || lower(business_name) || ' ', i::INT, 3))) AS gram FROM full_),
  h AS (SELECT id, {S.crc32('gram')} % 64 AS bin, count(*) AS n FROM g, crc GROUP BY ALL), u AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM h),
  c AS (SELECT b.q, b.r, sum(x.w * y.w) AS cos FROM base b JOIN u x ON x.id = b.q JOIN u y ON y.id = b.r AND x.bin = y.bin GROUP BY ALL)
  SELECT q, r, round(coalesce(cos, 0), 6) AS dense_cos FROM base LEFT JOIN c USING (q, r)""")
def trigram_cos(spark: SparkSession, d: str) -> DataFrame:
    index, pairs = _scored(spark, d)
    vectors = R.trigram_vectors(index.queries.select("id", "business_name").union(index.pool.select("id", "business_name")), F.col("business_name"))
    return R.pair_dense_cos(pairs.select("q", "r"), vectors)
