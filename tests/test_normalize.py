import pytest

from kinweave.functions import normalize as n


def names(spark, *raw):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, business_name string")
    return [r.asDict() for r in n.normalize_names(df).orderBy("k").collect()]


def addresses(spark, *raw):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, business_address string")
    return [r.asDict() for r in n.normalize_addresses(df).orderBy("k").collect()]


def test_scripts_meet(spark):
    a, b = names(spark, "Royal Builders Private Limited", "रॉयल बिल्डर्स प्राइवेट लिमिटेड")
    assert a["name_skel"] == b["name_skel"] == "ryl bldrs"
    assert b["name_native"] and not a["name_native"]


def test_names(spark):
    rows = names(
        spark, "Rizacira formerly: Lopez, Smith and Campbell LLC", "literacycenter.com", "Literacy Center LLC",
        "regional prime horizon center (ID: 96415)", "LLC Orth0pedic Care", "Contre & Fils Distribution [S.A.R.L.]",
        "Ets Fleurs SARL", "Établissements Fleurs S.A.R.L.", "", None, "The Company",
    )
    assert rows[0]["name_core"] == "lopez smith campbell" and rows[0]["name_has_alias"] and rows[0]["name_alias"] == "rizacira"
    assert rows[1]["name_compact"] == rows[2]["name_compact"] == "literacycenter" and rows[1]["name_is_web"]
    assert rows[3]["name_core"] == "regional prime horizon center"
    assert rows[4]["name_core"] == "orthopedic care"
    assert rows[5]["name_core"] == "contre fils distribution"
    assert rows[6]["name_core"] == rows[7]["name_core"] == "fleurs"
    assert rows[8]["name_core"] == rows[9]["name_core"] == ""
    assert rows[10]["name_core"] == "the company"


def test_addresses(spark):
    rows = addresses(
        spark, "0520 ELEVENTH STREET, BARTESVILLE, OK", "520 11th Saint, Bartlesville, Oklahoma",
        "63 R. DE DIEPPE, LILLE, Hauts-de-France", "", "N° 551 AVENUE DE L’AERODROME, LA TESTE DE BUCH, Gironde",
        "551 Avenue de l'Aerodrome, La Teste-de-Buch, Nouvelle-Aquitaine", "12 N Main St, Austin, TX", None,
    )
    assert rows[0]["addr_nums"] == rows[1]["addr_nums"] == "520 11"
    assert rows[0]["addr_clean"].split()[:3] == ["520", "11", "st"] and rows[1]["addr_clean"].endswith("ok")
    assert rows[2]["addr_clean"].startswith("63 rue dieppe lille")
    assert rows[3]["addr_empty"] and rows[7]["addr_empty"]
    assert rows[4]["addr_clean"] == rows[5]["addr_clean"] and rows[4]["addr_nums"] == "551"
    assert rows[6]["addr_clean"] == "12 n main st austin tx"


@pytest.mark.parametrize("word", ["constructions", "photograph", "quixotic", "jazz", "", "aeiou", "whole"])
def test_skeleton_agrees_with_python(spark, word):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(n.skeleton(df["w"])).first()[0] == n.skeleton_of(word)
