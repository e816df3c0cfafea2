import random

import pytest

CLASH = ["digest", "group_size", "row", "part", "block", "hits", "key", "n", "sig", "shard", "slot", "ord", "guard", "score", "topic", "kept"]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies, repeated rows."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    passage = " ".join(word() for _ in range(70))
    rows = [(k, " ".join(word() for _ in range(rnd.randrange(1, 160))), rnd.choice(["en", "fr"]), f"s{min(k % 5, 2)}") for k in range(60)]
    rows += [(100 + k, f"{word()} {passage}\n{word()} x{k}", "en", "s0") for k in range(12)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t ", "en", "s1"), (203, "Same  text", "en", "s1"), (204, "Sametext", "en", "s1")]
    rows += [(205, "long " * 4000 + "end", "en", "s0"), (206, "z" * 30000, "en", "s0"), (207, "Ünïcödé 🙂 it's", "de", "s1")]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1"), (None, rows[5][1], "en", "s1")]
    rows += [(300 + k, rows[7][1], "en", "s0") for k in range(9)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in CLASH}).repartition(5)


@pytest.fixture(scope="session")
def plain(spark, odd_rows):
    """The rows with distinct ids."""
    seen = {r[0]: r for r in odd_rows if r[0] is not None}
    return list(seen.values()), spark.createDataFrame(list(seen.values()), "doc_id long, text string, lang string, source string").repartition(4)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
