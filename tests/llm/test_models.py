import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import mixing, queries, toxicity
from kinweave.llm.common import Scratch


def corpus(n, seed):
    """Texts whose label shows in marked words."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "sha"]) for _ in range(rnd.randrange(1, 4)))
    texts, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rnd.randrange(5, 120))]
        if k % 4 == 0:
            for _ in range(1 + len(w) // 15):
                w[rnd.randrange(len(w))] = rnd.choice(["vileword", "nastybit", "zzhate" + word()])
        texts.append(" ".join(w))
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def network():
    texts, labels = corpus(600, 1)
    return toxicity.fit(texts, labels, 0.25, toxicity.Bounds(steps=60))


def test_held_out_accuracy(network):
    texts, labels = corpus(300, 2)
    scores = network.scores(toxicity._corpus(texts))
    assert ((scores >= 0.3) == labels).mean() > 0.95


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = toxicity.Network.new(1)
    x = rng.standard_normal((9, toxicity.DIM)).astype(np.float32)
    tokens, length = rng.integers(0, 9, (4, toxicity.WINDOW)), np.array([32, 5, 32, 1])
    target, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        z = net.run(x, tokens, length).astype(np.float64)
        return float((np.log1p(np.exp(z)) - target * z).mean())

    grads, dx = net.gradient(x, tokens, length, target, weight)
    for name in ("Uf", "Wb", "cb", "a", "v", "o"):
        at = tuple(s // 2 for s in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3, name
    old = x[3, 2]
    x[3, 2] = old + 1e-2
    up = loss()
    x[3, 2] = old - 1e-2
    assert abs((up - loss()) / 2e-2 - dx[3, 2]) < 2e-3


def test_windows_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        text, start, length = toxicity.all_windows(np.array([0, n]))
        seen = np.zeros(n, int)
        for s, k in zip(start, length):
            seen[s : s + k] += 1
        assert (seen > 0).all() and start.tolist() == toxicity.window_starts(n).tolist()


def test_scores_of_odd_rows(odd, odd_rows, none, network):
    got = toxicity.score(odd, network).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (200, 201, 202)} == {0.0}
    assert toxicity.score(none, network).count() == 0
    kept = toxicity.keep_clean(odd, network)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.3 for r in got)
    untrained = toxicity.train(odd, none.select("doc_id", F.lit(1).alias("toxic")))
    assert {r.score for r in toxicity.score(odd, untrained).collect()} == {0.0}


def test_mixing(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.probability <= 1 for r in got)
    assert mixing.mix(none).count() == 0
    again = mixing.mix(odd.repartition(2)).collect()
    key = lambda r: (r.doc_id or -1, r.source, r.n_tokens, r.draw, r.kept)
    assert sorted(map(key, got)) == sorted(map(key, again))  # draws go by id, or by text, not by partitions
    assert len({r.draw for r in got if r.doc_id is None}) == 2


def brute_rake(cells, shares, budget, rounds):
    """Plain raking of {(source, lang, topic): tokens}."""
    total = sum(cells.values())
    weight = {c: t * budget for c, t in cells.items()}
    for _ in range(rounds):
        for k, axis in enumerate(mixing.AXES):
            have = collections.Counter()
            for c, w in weight.items():
                have[c[k]] += w
            weight = {c: min(cells[c], w * (shares[axis][c[k]] * total * budget / have[c[k]] if have[c[k]] else 0)) for c, w in weight.items()}
    return weight


def test_mixing_against_plain_raking(spark):
    rnd = random.Random(8)
    rows = [(k, "w " * rnd.randrange(1, 300) + rnd.choice(["", "|", "a license"]), rnd.choice("abc"), rnd.choice(["big"] * 5 + ["mid", "small"])) for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rounds=5).collect()
    cells = collections.Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    total, shares = sum(cells.values()), {}
    for k, axis in enumerate(mixing.AXES):
        own = collections.Counter()
        for c, t in cells.items():
            own[c[k]] += t
        flat = {c: (t / total) ** 0.7 for c, t in own.items()}
        shares[axis] = {c: f / sum(flat.values()) for c, f in flat.items()}
    want = brute_rake(cells, shares, 0.8, 5)
    assert all(abs(r.probability - want[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic]) < 1e-9 for r in got)
    assert all(r.kept == (r.draw < r.probability) for r in got)


def test_raking_meets_marginals(spark):
    rows = [(k, "w " * (5 + k % 7), "en" if k % 3 else "fr", "big" if k % 4 else "small") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"big": 0.6, "small": 0.4}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"short": 1.0}}
    got = mixing.mix(df, targets, budget=0.4, rounds=20).collect()
    share = lambda axis: {k: v / total for k, v in sums(axis).items()}

    def sums(axis):
        out = collections.Counter()
        for r in got:
            out[r[axis]] += r.n_tokens * r.probability
        return out

    total = sum(sums("source").values())
    assert abs(total / sum(r.n_tokens for r in got) - 0.4) < 1e-6
    assert abs(share("source")["small"] - 0.4) < 1e-6 and abs(share("lang")["fr"] - 0.3) < 1e-6
    scratch = Scratch(spark, "t")
    raked = mixing.raked_cells(scratch, spark.createDataFrame([(r.source, r.lang, r.topic, r.n_tokens) for r in got], "source string, lang string, topic string, n_tokens long"), targets, 0.4, 0.7, 20)
    assert all(abs(r.wanted - r.weight) < 1e-4 * r.wanted for r in mixing.residuals(raked).collect())
    kept = sum(r.kept for r in got)
    assert abs(kept - sum(r.probability for r in got)) < 60


def test_pipeline_stages(odd, plain, tmp_path, spark):
    """Each stage against plain Python, on its own input."""
    from tests.llm.test_dedup import brute_near

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    texts, labels = corpus(240, 3)
    base = [(k, t, "en", "s0") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(base + [(500, base[1][1], "en", "s1"), (501, base[2][1] + " end", "en", "s1"), (None, "lone", None, None)], "doc_id long, text string, lang string, source string")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        after = spark.read.parquet(f"{sf}/{k}")
        if name != "packing":
            assert after.columns == docs.columns
        rows = [tuple(r) for r in after.select("doc_id", *(["text"] if name != "packing" else [])).collect()]
        if name == "toxicity":
            network = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            scored = collections.Counter(map(tuple, toxicity.score(now, network).where("predicted = 0").select("doc_id").collect()))
            assert collections.Counter((r[0],) for r in rows) == scored  # what op8 rejects goes, and nothing else
            gone = {d for d, _ in before if d is not None and d < 240} - {r[0] for r in rows}
            assert sum(labels[d] for d in gone) >= 0.8 * len(gone) and sum(labels[d] for d in gone) >= 0.8 * labels.sum()
        if name == "exact_dedup":
            assert (500 not in {r[0] for r in rows}) or 1 not in {b[0] for b in before}
            assert len({"".join(t.split()) for _, t in rows}) == len(rows)
        if name == "near_dedup":
            want = {d for d, (_, c) in brute_near([b for b in before if b[0] is not None], 5).items() if c == d}
            assert {r[0] for r in rows} - {None} == want and (None in {r[0] for r in rows}) == (None in {b[0] for b in before})
        if name == "mixing":
            assert {r[0] for r in rows} <= {b[0] for b in before} and rows
        if name == "packing":
            assert {r[0] for r in rows} == {b[0] for b in before}
        now = after


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
