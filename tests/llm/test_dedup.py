import collections
import gc
import hashlib
import os
import random
import re
import types

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import common, exact_dedup, minhash, substring
from kinweave.llm.common import Scratch
from kinweave.llm.components import components


def brute_exact(rows):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for doc, text, *_ in rows:
        groups[norm(text)].append((-len(text or ""), doc is None, doc or 0, doc))
    keep = {k: min(v)[3] for k, v in groups.items()}
    return collections.Counter((d, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows)


def test_exact(odd, odd_rows, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(odd_rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_survives_digest_collisions(odd, odd_rows):
    """With digests of one letter nearly everything collides, and only full bytes can tell texts apart."""
    got = exact_dedup.exact_dedup(odd, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect()
    want = collections.Counter()
    for (doc, keep, size, _), n in brute_exact(odd_rows).items():
        want[doc, keep, size] += n
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def test_exact_compares_bytes_of_rows_without_ids(spark):
    rows = [(1, "aaa"), (None, "bbb"), (None, "ccc"), (2, "bbb"), (None, "ccc ")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.substring(F.sha2(c, 256), 1, 0)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == collections.Counter((d, k, n) for d, k, n, _ in brute_exact(rows).elements())


def brute_near(rows, k, per=80):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_two_and_five_words(plain):
    rows, df = plain
    extra = [(1000 + k, " ".join(f"w{(k * 7 + i) % 97 if i % 23 == k else i}" for i in range(90)), "en", "s") for k in range(20)]
    df = df.union(df.sparkSession.createDataFrame(extra, df.schema))
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=width).collect()}
        assert got == brute_near(rows + extra, width)


def test_near_edges(odd, none, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[200].n_shingles == 0 and by[200].component_id == 200 and by[200].kept
    assert by[308].component_id == by[7].component_id
    assert minhash.near_duplicates(none).count() == 0


def test_grid_blocks_find_links_that_pivots_miss(spark, monkeypatch):
    """A chain of near copies whose ends are far apart, in buckets of several blocks, stars of several parts, hot keys."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    monkeypatch.setattr(common.join_hot, "__defaults__", ("inner", 5))
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[2 * k :] + [f"v{j}" for j in range(2 * k)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=2).collect()}
    assert got == brute_near(rows, 2)


def test_near_judges_rows_by_their_own_text(spark):
    """Repeated ids with different texts, null ids, repeated rows: linked by text, kept by id."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    c = " ".join(f"c{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, b + " more"), (None, c), (None, c + " more"), (9, c + " other"), (None, a + " too"), (8, "one"), (8, "one"), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    want = [(5, 36, 5, True), (5, 36, 3, False), (3, 37, 3, True), (None, 36, 9, False), (None, 37, 9, False), (9, 37, 9, True), (None, 37, 5, False)]
    want += [(8, 1, 8, True), (8, 1, 8, True), (None, 0, None, False), (7, 0, 7, True)]
    assert got == collections.Counter(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(50, 40), (60, 50), (70, 71)] + [(90, x) for x in range(91, 99)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    want = {k: 0 for k in range(31)} | {40: 40, 50: 40, 60: 40, 70: 70, 71: 70} | {k: 90 for k in range(90, 99)}
    assert got == want


def brute_substring(rows, width=50):
    """Counter of (doc_id, n_words, n_removed, kept_sha256), row by row; a null id is the largest."""
    order = lambda d: float("inf") if d is None else d
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, float("inf")), order(d))
    out = collections.Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(d):
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def removed(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df).collect())


def test_substring(odd, none, odd_rows):
    want = brute_substring(odd_rows)
    assert removed(odd) == want
    assert sum(w[2] > 0 for w in want) >= 11
    assert substring.substring_dedup(none).count() == 0


def test_substring_of_few_rows_and_shared_ids(spark):
    """Partitions without blocks; null and repeated ids whose texts differ; a passage at every offset."""
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    p = word("p", 60)
    tables = [[(1, word("a", 30))], [(1, word("a", 60)), (2, word("b", 70))], [(1, p), (2, "x " + p)]]
    tables += [[(1, p), (5, word("c", 10) + " " + p), (5, word("d", 120)), (None, p + " z"), (None, word("e", 90)), (None, p)]]
    tables += [[(9, "same " * 300), (3, "same " * 200), (4, "same " * 49), (3, "same " * 60)]]
    for rows in tables:
        assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_substring(rows), rows


def test_substring_in_two_steps(odd, odd_rows, monkeypatch):
    """Small slices, and more partitions than one step deals to."""
    monkeypatch.setattr(substring, "COARSE", 2)
    monkeypatch.setattr(substring, "SLICE", 1 << 12)
    monkeypatch.setattr(substring, "PROBE_BYTES", 8 << 10)
    assert removed(odd) == brute_substring(odd_rows)


def test_near_copies_are_confirmed_about_once_each(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for group in range(3):
        words = [f"w{group}x{k}" for k in range(150)]
        for copy in range(40):
            own = list(words)
            for _ in range(2):
                own[rnd.randrange(150)] = f"c{copy}"
            rows.append((100 * group + copy, " ".join(own)))
    asked = []
    plain = minhash.confirm

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(minhash, "confirm", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i // 100 * 100 for i, _ in rows}
    assert sum(asked) < 2 * len(rows)  # not once for each pivot of their buckets


def test_only_wanted_sets_are_moved(spark):
    docs = spark.createDataFrame([(k if k else None, f"a{k} b c d e f{k}") for k in range(400)], "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    reps = docs.where("doc_id is null or doc_id % 100 = 7").selectExpr("coalesce(doc_id, -1) as node", "doc_id as rep_id", "mark as rep_mark")
    sets = minhash.full_sets(docs, reps, 5, 5)
    assert sorted(r.node for r in sets.collect()) == [-1, 7, 107, 207, 307]
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # texts don't meet the nodes, sets do
    words = minhash._bitmap(reps.select(F.xxhash64("rep_id", "rep_mark").alias("spot")), 5)
    assert sum(bin(int(w) & (2**64 - 1)).count("1") for w in words) == 5


def test_briefs_rule_out_no_similar_pair():
    rnd = np.random.default_rng(5)
    ruled = 0
    for n in (1, 2, 40, 400, minhash.MANY - 1, minhash.MANY + 3):
        for gone in (0, n // 20, n // 9, n // 3):
            left = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            right = np.unique(np.append(left[gone:], rnd.integers(0, 1 << 64, gone, dtype=np.uint64)))
            cut = [minhash.read_brief(minhash.brief(x)) for x in (left, right)]
            assert [len(c) for c in cut] == [len(left), len(right)]
            assert minhash.possible(*cut, 80) >= minhash.similar(left, right, 80)
            ruled += not minhash.possible(*cut, 80)
    assert ruled >= 4  # a third exchanged: no pair for the full sets


def test_full_sets_go_to_few_cells(spark, monkeypatch):
    """Texts that share a bucket but are not similar: their full sets are not dealt to the cells of the grid."""
    rnd = random.Random(4)
    rows = []
    for k in range(120):
        own = [f"w{i}" for i in range(300)]
        for i in rnd.sample(range(300), 14):
            own[i] = f"c{k}x{i}"
        rows.append((k, " ".join(own)))
    dealt = []
    plain = minhash._forest

    def counted(cells, *rest):
        dealt.append(cells.count())
        return plain(cells, *rest)

    monkeypatch.setattr(minhash, "_forest", counted)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == brute_near(rows, 2)
    assert len(dealt) == 1 and dealt[0] < len(rows)  # all of them, most several times, before


def test_executors_give_memory_back(spark, monkeypatch):
    """The tasks of give_back collect by themselves, here with the driver's own collection left out."""
    monkeypatch.setattr(common, "release", lambda _: None)
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    waste = [jvm.java.nio.ByteBuffer.allocate(48 << 20) for _ in range(3)]
    used = runtime.totalMemory() - runtime.freeMemory()
    del waste
    gc.collect()
    cluster = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="local-cluster[1,2,1000]", defaultParallelism=2), range=spark.range, _jvm=jvm)
    for workers in (False, True):
        common.give_back(cluster, workers)
    assert runtime.totalMemory() - runtime.freeMemory() < used - (96 << 20)


def test_near_and_pipeline_give_memory_back(spark, odd, monkeypatch):
    import corpus_pipeline

    calls = []
    for module in (minhash, exact_dedup, corpus_pipeline):
        monkeypatch.setattr(module, "give_back", lambda *_, **__: calls.append(module.__name__))
    minhash.near_duplicates(odd).count()
    assert len(calls) >= 4
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        calls.clear()
        stage(spark, odd.select("doc_id", "text", "lang", "source"), "")
        assert calls


def test_scratch_tables_have_no_marker_file(spark):
    scratch = Scratch(spark, "marker")
    assert scratch.save(spark.range(5), "five").count() == 5
    assert not os.path.exists(f"{scratch.at('five').removeprefix('file://')}/_SUCCESS")
