"""Operators and stages see every row: cases that an earlier cut lost."""

import corpus_pipeline
from kinweave.llm import merkle, mixing, sharding


def rows_left(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_pipeline_judges_rows_by_themselves(spark):
    words = [f"w{k}" for k in range(60)]
    one, other = " ".join(words), " ".join(f"v{k}" for k in range(60))
    rows = [(1, one), (5, one + " end"), (5, other), (None, one + " more"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_left(corpus_pipeline.drop_near_copies(spark, docs, "")) == sorted([(1, one), (5, other), (None, "lone")], key=str)
    docs = spark.createDataFrame([(1, "same text"), (2, "sametext"), (None, "same  text"), (7, "a b"), (7, "a b"), (7, "c")], "doc_id long, text string")
    left = rows_left(corpus_pipeline.drop_copies(spark, docs, ""))
    assert left == sorted([(None, "same  text"), (7, "a b"), (7, "c")], key=str)


def test_pipeline_mixes_rows_by_cell(spark):
    rows = [(k, "w " * 9, "en", "big") for k in range(40)] + [(100 + k, "w " * 9, "en", f"small{k % 12}") for k in range(60)]
    rows += [(None, "w " * 9, "en", "big"), (None, "w " * 9, "en", "small3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(((r.doc_id, r.lang, r.source) for r in mixing.mix(docs).collect() if r.kept), key=str)
    got = corpus_pipeline.mix_sources(spark, docs, "").select("doc_id", "lang", "source").collect()
    assert sorted(map(tuple, got), key=str) == want and (None, "en", "small3") in want and (None, "en", "big") not in want


def test_locate_goes_on_after_a_long_section():
    lines = ["same"] * 300 + [f"line {k} " + " ".join(f"w{k * 31 + i}" for i in range(30)) for k in range(40)]
    before = "\n".join(lines)
    lines[320] = "something else altogether"
    assert merkle.locate(*merkle.fingerprints([before, "\n".join(lines)])) == [(320, 321)]


def test_shard_files_hold_every_row_once(spark, tmp_path):
    rows = [(k, f"t{k}") for k in range(20)] + [(None, "a"), (None, "b"), (3, "c"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.write_shards(docs, f"{tmp_path}/out", 4)
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == sorted(rows, key=str)
