"""Queries see every row: cases that an earlier cut lost."""

import math
import random

import pytest

from kinweave.plans import queries as linkage


def test_dense_topk_returns_rows_whose_id_ends_in_zero(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    rows[30] = (30, [x + 1e-4 for x in rows[20][1]])  # the nearest neighbour of query 20
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in linkage.QUERIES["dense_topk"](spark, str(tmp_path)).orderBy("q", "score", ascending=[True, False]).collect():
        got.setdefault(r.q, []).append(r.r)
    assert sorted(got) == [0, 20, 40] and all(len(v) == 10 for v in got.values())
    assert set(got[20][:2]) == {20, 30}


def test_entity_view_keeps_rows_without_a_language(spark, tmp_path):
    rows = [(1, "some name", "en"), (2, "some name", None), (3, "some name", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = linkage.QUERIES["entity_view"](spark, str(tmp_path)).collect()
    assert {(r.id, r.country, r.leader) for r in got} == {(1, "en", 1), (2, None, 2), (3, None, 2)}


def test_addr_only_weighs_keys_of_any_frequency(spark, tmp_path):
    """an address word of more than 2500 pool records still finds them, and is one of the keys of longer addresses."""
    address = {4 * k: "harbour" if k <= 2550 else "jetty" if k <= 2553 else "orchard" for k in range(1, 2601)} | {1: "harbour", 5: "harbour jetty"}
    rows = [(k, f"name{k} b c d e f {a}", "en") for k, a in address.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in linkage.QUERIES["channel_addr_only"](spark, str(tmp_path)).collect():
        got.setdefault(r.q, {})[r.r] = r.score
    many, few = (math.log(2601 / (n + 1)) for n in (2550, 3))
    first = [4 * k for k in range(1, 21)]
    assert got[1] == dict.fromkeys(first, 1.0)
    assert sorted(got[5]) == first[:17] + [4 * 2551, 4 * 2552, 4 * 2553]
    assert got[5][4] == pytest.approx(many / math.hypot(many, few), abs=1e-6) and got[5][4 * 2551] == pytest.approx(few / math.hypot(many, few), abs=1e-6)
