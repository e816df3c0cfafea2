import random

from kinweave.functions.normalize import prepare
from kinweave.operators import model as MD
from kinweave.operators import retrieval as R
from kinweave.plans import run


def test_two_stages_recover_planted_matches(spark, tmp_path):
    rnd = random.Random(11)
    syllables = ["ka", "lo", "mi", "tu", "re", "sha", "ben", "dor"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(3))
    refs, pool, truth = [], [], []
    for k in range(40):
        name, address = f"{word()} {word()}", f"{rnd.randrange(1, 900)} {word()} street, {word()}"
        refs.append((k, name + " llc", address, "US"))
        for copy in range(2):
            pool.append((1000 + 2 * k + copy, name if copy else f"{name} inc", address if copy == 0 else "", "US"))
            truth.append((k, 1000 + 2 * k + copy))
    pool += [(5000 + k, f"{word()} {word()}", f"{k} {word()}", "US") for k in range(30)]
    schema = "id long, business_name string, business_address string, country string"
    index = R.Index(*(prepare(spark.createDataFrame(rows, schema), ascii_only=True) for rows in (refs, pool)))
    owners = spark.createDataFrame(truth, "q long, r long")
    small = MD.Config(trees=3, depth=2, folds=2, least=2, columns="all")
    options = run.Options(channels="base,conj:10,rescue", stage1=small, stage2=small, text_features=False)
    pairs, rule, metrics = run.learn(index, owners, str(tmp_path), options)
    assert metrics["recall"] > 0.95 and max(metrics["stage1"], metrics["stage2"]) > 0.8
    lists = dict(map(tuple, run.id_lists(index, pairs, rule, options).collect()))
    assert len(lists) == 40 and sum(bool(v) for v in lists.values()) > 30
    # the same run is read back, another one is not
    again = run.learn(index, owners, str(tmp_path), options)
    assert again[2] == metrics and run.run_key(options, index.queries, index.pool, owners.limit(5)) != metrics["key"]
    # the models left behind score records that training never saw
    fresh = spark.createDataFrame([(9000 + q, name, address, "US") for q, name, address, _ in refs[:12]], schema)
    other = R.Index(prepare(fresh, ascii_only=True), index.pool)
    scored, found = run.predict(other, str(tmp_path), metrics["key"], options)
    assert found == rule
    hits = {(r.q - 9000, r.r) for r in run.SEL.select(scored, found).collect()}
    assert len(hits & set(truth)) >= 0.7 * len(hits) and len(hits & set(truth)) >= 12


def test_scores_of_a_split_are_written_once(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3))
    refs = [(k, f"{word()} {word()}", f"{k} {word()} street", "US") for k in range(24)]
    pool = [(1000 + k, name, address, "US") for k, name, address, _ in refs] + [(2000 + k, f"{word()} {word()}", f"{k} {word()}", "US") for k in range(12)]
    schema = "id long, business_name string, business_address string, country string"
    index = R.Index(*(prepare(spark.createDataFrame(rows, schema), ascii_only=True) for rows in (refs, pool)))
    small = MD.Config(trees=2, depth=2, folds=2, least=2, columns="all")
    options = run.Options(channels="base,rescue", stage1=small, stage2=small, text_features=False)
    _, _, said = run.learn(index, spark.createDataFrame([(k, 1000 + k) for k in range(24)], "q long, r long"), str(tmp_path), options)
    scored, _ = run.predict(index, str(tmp_path), said["key"], options)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan  # columns are not made again for each model, or each time scores are read
    assert scored.count() == scored.select("q", "r").distinct().count() > 0


def test_study_scores_are_those_of_the_rules(spark):
    rnd = random.Random(7)
    pairs = spark.createDataFrame([(q, r, round(rnd.random(), 2)) for q in range(12) for r in range(100, 140) if rnd.random() < 0.3], "q int, r int, p double")
    truth = spark.createDataFrame([(q, 100 + 3 * q + k) for q in range(9) for k in range(1 + q % 3)], "q int, r int")
    refs = spark.createDataFrame([(q, "X") for q in range(14)], "q int, country string")
    table = dict(run.SEL.best_rule(pairs, truth, refs)[1])
    for c, w0 in ((0.7, 0.6), (1.0, 1.0), (1.4, 3.0), (1.1, 1.5)):
        rule = run.SEL.Rule("expf", c=c, w0=w0)
        assert table[rule] == run.M.macro_f05(run.SEL.select(pairs, rule), truth, refs).first().macro_f05


def test_counts_are_met_by_either_kind_of_rule(spark):
    rnd = random.Random(3)
    pairs = spark.createDataFrame([(k % 40, k, round(rnd.random(), 6)) for k in range(200)], "q int, r int, p double")
    refs = spark.createDataFrame([(k, "X" if k < 20 else "Y") for k in range(40)], "q int, country string")
    for rule in (run.SEL.Rule(thr=0.5), run.SEL.Rule("expf")):
        kept = run.SEL.select(run.matched(pairs, refs, rule, run.Options(count_match=1.5)), rule).join(refs, "q").groupBy("country").count().collect()
        assert all(abs(r["count"] - 30) <= 4 for r in kept) and len(kept) == 2, rule
    some = run.matched(pairs, refs, run.SEL.Rule(), run.Options(count_match=1.5, count_scope="unseen", seen=("X",)))
    same = some.join(pairs.withColumnRenamed("p", "was"), ["q", "r"]).join(refs, "q")
    assert same.where("country = 'X' and p <> was").count() == 0 and same.where("country = 'Y' and p <> was").count() > 0
