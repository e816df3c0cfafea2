import random

import pytest

from kinweave.functions import similarity as sim
from kinweave.functions.normalize import prepare
from kinweave.operators import features as FT
from kinweave.operators import metric as M
from kinweave.operators import model as MD
from kinweave.operators import retrieval as R
from kinweave.operators import selection as SEL
from kinweave.sources import tables as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def records(spark, names):
    df = frame(spark, [(k, n, a, "US") for k, (n, a) in enumerate(names)], "id long, business_name string, business_address string, country string")
    return prepare(df)


def test_metric(spark):
    truth = frame(spark, [("1", "47"), ("1", "812")], "q string, r string")
    pred = frame(spark, [("1", "47"), ("1", "193"), ("1", "812")], "q string, r string")
    refs = frame(spark, [("1",)], "q string")
    assert M.macro_f05(pred, truth, refs).first().macro_f05 == pytest.approx(0.714286)
    two = frame(spark, [("1",), ("2",)], "q string")
    assert M.macro_f05(pred.limit(0), truth, two).first().macro_f05 == 0.5  # nothing true, nothing predicted: 1
    assert M.macro_f05(frame(spark, [("2", "9")], "q string, r string"), truth, two).first().macro_f05 == 0.0


def test_expected_f(spark):
    p = [(0, 10, 0.95), (0, 11, 0.9), (0, 12, 0.05), (1, 13, 0.05), (1, 14, 0.02)]
    df = frame(spark, p, "q int, r int, p double")
    got = {(r.q, r.r): r.keep for r in SEL.expected_f(df).collect()}
    assert [got[q, r] for q, r, _ in p] == [True, True, False, False, False]


def test_exclusive_ties_go_to_the_smaller_query(spark):
    df = frame(spark, [(2, 1, 0.8), (1, 1, 0.8), (3, 2, 0.6), (3, 3, 0.1)], "q int, r int, p double")
    assert {(r.q, r.r) for r in SEL.select(df, SEL.Rule(thr=0.5)).collect()} == {(1, 1), (3, 2)}


def test_selection_study_and_clones(spark):
    pairs = frame(spark, [(1, 10, 0.9), (1, 11, 0.4), (2, 12, 0.35), (3, 13, 0.8)], "q int, r int, p double")
    truth = frame(spark, [(1, 10), (3, 13)], "q int, r int")
    refs = frame(spark, [(1,), (2,), (3,)], "q int")
    rule, table = SEL.best_rule(pairs, truth, refs)
    assert len(table) == 25 + 56 and table[0][1] == 1.0 and rule.method == "threshold"
    assert SEL.clone_decoys(pairs, truth, 2.0).count() == 6
    lone = SEL.clone_decoys(pairs, truth, 3.0).where("r = 11")
    assert sorted(r.copy for r in lone.collect()) == [0, 1, 2]


def test_count_match_reaches_its_target(spark):
    rnd = random.Random(1)
    pairs = frame(spark, [(k % 20, k, round(rnd.random(), 4)) for k in range(80)], "q int, r int, p double")
    refs = frame(spark, [(k, "X") for k in range(20)], "q int, country string")
    delta = SEL.count_match(pairs, refs, 0.5, 1.5).first().delta
    moved = pairs.withColumn("p", SEL.shift_logit(pairs["p"], delta + 1e-5))
    assert SEL.select(moved, SEL.Rule(thr=0.5)).count() == 30


def test_p_context(spark):
    df = frame(spark, [(0, 1, 0.9), (0, 2, 0.2), (0, 3, 0.6), (1, 4, 0.1)], "q int, r int, p double")
    rows = FT.p_context(df).orderBy("r").collect()
    assert [r.p1_rank_s1 for r in rows] == [1, 3, 2, 1] and [r.p1_second_s1 for r in rows] == [0.6, 0.6, 0.6, 0.0]
    assert [r.p1_margin for r in rows] == [0.3, -0.7, -0.3, 0.1] and [r.p1_sum_s1 for r in rows] == [1.7, 1.7, 1.7, 0.1]


def test_rank_gap_on_ties(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(20), round(rnd.randrange(9) / 10, 1)) for k in range(600)]
    got = FT.rank_gap(frame(spark, rows, "r int, q int, s double"), "s", "q", "x", "s1").collect()
    for g in got:
        own = [s for _, q, s in rows if q == g.q]
        assert g.x_rank_s1 == 1 + sum(s > g.s for s in own) and g.x_gap_s1 == pytest.approx(g.s - max(own))


def test_group_and_sibling_features(spark):
    pool = records(spark, [("a", "12 main st"), ("a", "12 main st"), ("b", "99 elm rd")])
    pairs = frame(spark, [(0, 0, 0.95), (0, 1, 0.1), (0, 2, 0.1)], "q int, r long, p double")
    rows = FT.sibling_features(pairs, pool).orderBy("r").collect()
    assert rows[1].sib_addr_max == 1 and rows[2].sib_addr_max < 0.5
    assert [r.sib_hnum_max for r in rows] == [0, 1, 0] and [r.sib_n for r in rows] == [0, 1, 1]
    groups = frame(spark, [(1, "A", ""), (2, "A", ""), (3, "A", "2"), (4, "B", "3"), (5, "B", "3")], "id int, addr string, hnum string")
    mass = frame(spark, [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.3), (1, 4, 0.6), (1, 5, 0.5)], "q int, r int, p double")
    rows = FT.group_features(mass, groups, {"addr": "addr", "hnum": "hnum"}).orderBy("r").collect()
    assert [r.grp_addr_n for r in rows] == [3, 3, 3, 2, 2] and [r.grp_hnum_n for r in rows] == [1, 1, 1, 2, 2]
    assert [r.grp_addr_psum_oth for r in rows] == [1.1, 1.2, 1.7, 0.5, 0.6] and [r.grp_hnum_gap for r in rows] == [0, 0.1, 0.6, 0, 0]


def test_profiles(spark):
    ours = FT.profiles(records(spark, [("Acme Tools Private Limited", "12 Main St"), ("Acme Tools LLC", "100 Elm")]))
    pool = FT.profiles(records(spark, [("Acme Tools Public Limited", "13 Main"), ("Acme Tools Limtied", "112 Main"), ("Acme Tools LLC", "")]))
    got = {(r.q, r.r): r for r in FT.profile_features(frame(spark, [(0, 0), (0, 1), (1, 2)], "q long, r long"), ours, pool).collect()}
    assert got[0, 0].lg_pub_flip == 1 and got[0, 0].lg_drop == 1 and got[0, 0].w_extra == 0 and got[0, 0].hn_diff_mag == 1
    assert got[0, 1].lg_drop == 1 and got[0, 1].w_same == 1 and got[0, 1].hn_diff_mag == 3
    assert got[1, 2].lg_same == 1 and got[1, 2].hn_both == 0 and got[1, 2].hn_len_eq == 0


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similarities():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abé ") for _ in range(rnd.randrange(14))) for _ in range(2))
        assert sim.lcs(a, b) == naive_lcs(a, b)
    assert sim.ratio("", "") == 1 and sim.token_set_ratio("", "") == 0 and sim.partial_ratio("", "a") == 0
    assert sim.token_sort_ratio("b a", "a b") == 1 and sim.token_set_ratio("a b", "a b c") == 1
    assert sim.partial_ratio("300", "5300") == 1 and sim.partial_ratio("abcd", "xxcd") == pytest.approx(2 / 3)
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5) and sim.jaro_winkler("a", "") == 0


def test_unseen_and_capped_keys_count_in_norms(spark):
    """An absent key counts in a query's norm, a capped key in nobody's; all keys capped means no pair."""
    pool = frame(spark, [(k, "X", w) for k, w in enumerate(["a b", "a c", "a"])], "id long, country string, w string")
    query = frame(spark, [(9, "X", "b zz"), (8, "X", "a")], "id long, country string, w string")
    keys = lambda df: R.postings(df, ("name", __import__("pyspark").sql.functions.split(df["w"], " ")))
    found = R.frequencies(pool, keys(pool))
    got = R.scores(R.cosine_weights(keys(query), found, pool, 2), R.cosine_weights(keys(pool), found, pool, 2)).collect()
    import math

    b, zz = math.log(4 / 2), math.log(4)
    assert [(r.q, r.r) for r in got] == [(9, 0)] and got[0].name_cos == pytest.approx(b / math.hypot(b, zz), abs=1e-6)


def test_rescue_blocks_and_fusion(spark):
    pool = records(spark, [("Blue Lagoon Cafe", f"{k} st") for k in range(31)] + [("Red Roof Inn", "1 a")])
    index = R.Index(records(spark, [("Blue Lagoon Cafe", ""), ("Red Roof Inn", "2")]), pool)
    assert {(r.q, r.r) for r in R.rescue(index).collect()} == {(1, 31)}
    assert R.rescue(index, 31).where("q = 0").count() == 31
    lists = {"base": frame(spark, [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)], "q long, r long, score double"), "rescue": frame(spark, [(0, 3, 1.0)], "q long, r long, score double")}
    rows = {r.r: r for r in R.fuse(lists, m=1).collect()}
    assert set(rows) == {3} or set(rows) == {1, 3}
    assert rows[3].rank_rescue == 1 and rows[3].n_ch == 2
    assert {r.r: r.rank_rescue for r in R.fuse(lists).collect()}[1] == R.NO_RANK
    with pytest.raises(ValueError):
        R.parse_spec("nothing:3")


def test_sources(spark, tmp_path):
    text = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA \"quoted\t\tUS\n"
    for k in (1, 2, 3):
        (tmp_path / f"t_source{k}.tsv").write_text(text.replace("S1-", f"S{k}-"))
    ours, pool = T.read_split(spark, str(tmp_path), "t")
    assert ours.first().business_name == 'A "quoted' and ours.first().business_address == ""
    assert sorted((r.entity_id, r.src) for r in pool.collect()) == [("S2-1", 2), ("S3-1", 3)]
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    pairs, queries = T.read_truth(spark, str(tmp_path / "gt.tsv"))
    assert pairs.count() == 2 and queries.count() == 2
    refs = frame(spark, [("S1-1",), ("S1-2",)], "q string")
    kept = frame(spark, [("S1-1", "S3-1", 1), ("S1-1", "S2-1", 2), ("S1-1", "S3-1", 3)], "q string, r string, rank int")
    lists = T.id_lists(refs, kept)
    assert dict(map(tuple, lists.collect())) == {"S1-1": "S3-1,S2-1", "S1-2": ""}
    known = pool.select(pool["entity_id"].alias("id"))
    assert {r.violations for r in T.contract_checks(lists, refs, known).collect()} == {0}
    (tmp_path / "bad.tsv").write_text("x\ty\n")
    with pytest.raises(ValueError):
        T.read_source(spark, str(tmp_path / "bad.tsv"))
    made = []
    for _ in range(2):
        T.cached(lambda: made.append(1) or refs, str(tmp_path / "stage"), spark)
    assert made == [1]


def test_model_learns(spark):
    rnd = random.Random(7)
    rows = [(k % 60, k, rnd.random()) for k in range(600)]
    df = frame(spark, [(q, r, s, int(s > 0.6)) for q, r, s in rows], "q long, r long, s double, y int")
    scored, models = MD.out_of_fold(df, ["s"], MD.Config(trees=3, depth=2, folds=2, columns="all"))
    got = scored.collect()
    assert len(got) == 600 and sum((r.p > 0.5) == (r.y == 1) for r in got) > 560 and len(models) == 2
    assert all(0 <= r.p_cal <= 1 for r in MD.cross_calibrate(scored).collect())
    assert 0 <= MD.prune_cut(scored) <= 1
    assert MD.blend(scored, scored.limit(10)).count() == 600


def test_greedy_union(spark):
    schema = "q int, r int, score double"
    lists = {"base": frame(spark, [(1, 1, 1.0)], schema), "good": frame(spark, [(1, 2, 1.0), (2, 3, 1.0)], schema), "useless": frame(spark, [(1, 9, 1.0)], schema)}
    truth = frame(spark, [(1, 1), (1, 2), (2, 3)], "q int, r int")
    assert M.greedy_union(lists, truth, 2) == ["base", "good"]


def _postings(spark, n, seed):
    """Weighed postings of n records: few keys, so that many pairs share one; two countries and a record without one."""
    rnd = random.Random(seed)
    rows = [("AB"[k % 2] if k else None, f, f"{f}{x}", k, rnd.randrange(1, 5) / 8) for k in range(n) for f in ("name", "addr") for x in rnd.sample(range(12), 3)]
    return rows, frame(spark, rows, "country string, field string, k string, id long, w double")


@pytest.mark.parametrize("chunk", [4, 1 << 19])
def test_best_by_products(spark, monkeypatch, chunk):
    """blocks of queries against cells of the pool give what all pairs give, over several cells and on ties."""
    from kinweave.operators import products as P

    monkeypatch.setattr(P, "POOL_BLOCK", 16)
    monkeypatch.setattr(P, "CHUNK", chunk)
    (asked, wq), (own, wp) = _postings(spark, 40, 1), _postings(spark, 90, 2)
    sums = {}
    for c, f, k, q, a in asked:
        for c2, f2, k2, r, b in own:
            if c and (c, f, k) == (c2, f2, k2):
                pair = sums.setdefault((q, r), [0.0, 0.0])
                pair[f == "addr"] += a * b
    want = {}
    for bit, (score, k) in enumerate([(lambda s: s[0] + s[1], 7), (lambda s: s[0], 3)]):
        for q in {q for q, _ in sums}:
            best = sorted((-round(score(s), 6), r) for (q2, r), s in sums.items() if q2 == q and score(s) > 0)[:k]
            for _, r in best:
                want[q, r] = want.get((q, r), 0) | 1 << bit
    met = P.Products(wq, wp, R.NAMES)
    assert len(met.written) > 4
    got = {(x.q, x.r): x for x in met.best(P.Rule((0, 1), 7), P.Rule((0,), 3)).collect()}
    assert {k: x.lists for k, x in got.items()} == want
    assert all((x["name"], x.addr) == (round(sums[k][0], 6), round(sums[k][1], 6)) for k, x in got.items())
    marks = frame(spark, [("AB"[q % 2], q, m) for q in range(1, 40) for m in (0.1, 0.5)], "country string, q long, mark double")
    above = {(x.q, x.mark): x.above for x in met.above(marks).collect()}
    assert above == {(q, m): sum(s[0] + s[1] > m for (q2, _), s in sums.items() if q2 == q) for q in range(1, 40) for m in (0.1, 0.5)}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_long_lists_give_what_all_sums_give(spark, monkeypatch, k):
    """lists added up one by one leave out no pair of a query's best, on ties and on ids that occur twice."""
    import numpy as np
    import pyarrow as pa

    from kinweave.operators import products as P

    monkeypatch.setattr(P, "LONG", 0)
    (asked, wq), (_, wp) = _postings(spark, 40, 1), _postings(spark, 400, 2)
    wp = wp.where("field = 'addr' and country = 'B'")
    met = P.Products(wq, wp.union(wp.where("id % 7 = 0")), ("addr",))
    cell = P.Cell(f"{met.home.at('cells')}/cell={min(met.written)}")
    rows = [(key, q, 0, w) for c, f, key, q, w in asked if c == "B" and f == "addr"]
    block = P.Block.of(pa.table(dict(zip(("k", "q", "field", "w"), zip(*rows)))))
    best = []
    for found in (block.sums(cell, 1), block.leading(cell, k)):
        query, record, sums = (np.concatenate(c) for c in zip(*((q, r, s) for q, r, (s,) in found)))
        at, _ = P._kept(query, cell.ids[record], [sums], (P.Rule((0,), k),))
        best.append([x[at].tolist() for x in (query, record, sums)])
    assert best[0] == best[1] and len(best[0][0]) == 20 * k


@pytest.mark.parametrize("channel", ["base", "base_wide", "addr_only", "name_noaddr", "conj", "bm25"])
def test_channels_do_not_shuffle_pairs(spark, channel):
    """no plan groups or ranks the pairs that share a key; only kept pairs leave a task."""
    pool = records(spark, [(f"acme {k} tools", f"{k} main st") for k in range(20)])
    plan = R.CHANNELS[channel](R.Index(pool, pool))._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :]
    assert "MapInArrow" in plan and "keys=[q#" not in plan and "Window" not in plan


def test_pairs_carry_no_texts(spark):
    """counts are joined to records, windows share an exchange a side; results stay."""
    recs = records(spark, [("acme tools llc", "12 main st"), ("acme tools llc", "12 main st"), ("bolt works", "")])
    pairs = frame(spark, [(0, 0, 0.5, 0.25, 0.6), (0, 1, 0.5, 0.5, 0.5), (2, 2, 0.75, 0.0, 0.4), (0, 2, 0.1, 0.0, 0.2)], "q long, r long, name_cos double, addr_cos double, p double")
    plan = lambda df: (lambda text: text[text.index("== Physical Plan ==") :])(df._jdf.queryExecution().toString())
    context = plan(FT.context(pairs))
    assert context.count("Exchange hashpartitioning(q#") == 1 and context.count("Exchange hashpartitioning(r#") == 1
    crowd, names = FT.crowd_features(pairs, recs, recs), FT.name_ambiguity(pairs, recs, recs)
    profile = FT.profile_features(pairs, FT.profiles(recs), FT.profiles(recs))
    groups = FT.group_features(pairs, recs, {"addr": "addr_clean"})
    assert all(f"{side}_{text}" not in plan(df) for df in (crowd, names, profile) for side in "lr" for text in ("addr_clean", "name_core"))
    assert plan(groups).count("Exchange hashpartitioning(q#") == 1
    assert sorted((x.q, x.r, x.l_addr_dup, x.r_addr_dup, x.a_exact) for x in crowd.collect()) == [(0, 0, 2, 2, 1), (0, 1, 2, 2, 1), (0, 2, 2, 0, 0), (2, 2, 0, 0, 0)]
    assert sorted((x.q, x.r, x.l_name_s1dup, x.r_name_s1cnt, x.r_name_s23cnt) for x in names.collect()) == [(0, 0, 2, 2, 2), (0, 1, 2, 2, 2), (0, 2, 2, 1, 1), (2, 2, 1, 1, 1)]
    assert sorted((x.q, x.r, x.namelg_s1dup, x.namelg_r_s1cnt) for x in profile.collect()) == [(0, 0, 2, 2), (0, 1, 2, 2), (0, 2, 2, 1), (2, 2, 1, 1)]
    assert sorted((x.q, x.r, x.grp_addr_n) for x in groups.collect()) == [(0, 0, 2), (0, 1, 2), (0, 2, 1), (2, 2, 1)]


def test_written_tables_let_go_of_shuffles(spark):
    """What a table was shuffled by goes once it is written, not at the end of the query."""
    import time

    from pyspark.sql import functions as F

    home = T.Home(spark, "release")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    for k in range(6):
        home.save(spark.range(500).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), f"t{k}")
    end = time.time() + 10
    while tracker.shuffleStatuses().size() > before + 2 and time.time() < end:
        time.sleep(0.2)
    assert tracker.shuffleStatuses().size() <= before + 2
