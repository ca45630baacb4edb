import random
import uuid
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from linkforge.functions import identity, similarity, text
from linkforge.operators.model import Model


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("Ramesh Textiles Pvt Ltd", "ramesh textiles"), ("a&b", "a b"), ("pvt. ltd.", "pvt"), ("private  limited", "private"), ("company", "company"), ("Co & Co", ""), ("ಕನ್ನಡ", ""), (None, ""), ("M/s Kumar", "kumar")])
def test_normal_name(spark, given, want):
    assert one(spark, text.normal_name(F.lit(given).cast("string"))) == want


def test_trim_and_tokens(spark):
    assert one(spark, text.trim(F.lit("\t a b \x01"))) == "a b"
    assert sorted(one(spark, text.tokens(F.lit(" Plot 4, Main-Road, plot ")))) == ["4", "main", "plot", "road"]
    assert one(spark, text.tokens(F.lit("--"))) == []
    assert one(spark, text.blank(F.lit(" \t")))


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "x", 0.0), ("kumar elec", "kumar electronics", 0.917647), ("city bakery confectionery", "city bakery", 0.888), ("bangalore steel works", "b s works", 0.518095), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6)


def test_jaro_winkler_batches(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc dé") for _ in range(r.choice((0, 1, 3, 8, 20, 70))))
    pairs = [(word(), word()) for _ in range(1500)] + [("abcdef", "bcadef"), ("a\0b", "a\0c"), (None, None), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.jaro_winkler(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(x["x"] == similarity.jaro_winkler_of(x["a"] or "", x["b"] or "") for x in got)


def test_half_transpositions_count():
    jaro = similarity.jaro_winkler_of("abcdef", "bcadef")
    assert jaro == pytest.approx(0.91667, abs=1e-5)


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "--", 0.0), ("--", ".", 1.0), ("--", "a", 0.0), ("a b", "b c", 1 / 3)])
def test_jaccard(spark, a, b, want):
    x, y = F.lit(a), F.lit(b)
    assert one(spark, similarity.jaccard(x, text.tokens(x), y, text.tokens(y))) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [("123", "123", 1.0), ("123", "124", 1.0), ("123", "145", 0.0), ("", "", 0.0), ("1", "", 0.0)])
def test_phones(spark, a, b, want):
    assert one(spark, similarity.phones(F.lit(a), F.lit(b))) == want


def test_ids(spark):
    for key in ("INFPL0001A", " abc ", "29ABCC00001A1Z3"):
        want = str(uuid.UUID(bytes=md5(f"UBID:{key.strip().upper()}".encode()).digest(), version=3))
        assert one(spark, identity.key_id(F.lit(key))) == want
    assert one(spark, identity.key_id(F.lit(" "))) is None


def test_feedback():
    f = {"identifier": 0.0, "name": 1.0, "address": 0.4, "pinCode": 1.0, "sector": 1.0, "phone": 1.0}
    yes, no = Model().learned(f, True), Model().learned(f, False)
    assert [round(v, 6) for v in yes.weights.values()] == [0.337187, 0.298651, 0.142582, 0.105973, 0.057803, 0.057803]
    assert [round(v, 6) for v in no.weights.values()] == [0.363825, 0.301455, 0.158004, 0.093555, 0.041580, 0.041580]
    assert sum(yes.weights.values()) == pytest.approx(1)
    assert Model.parse(yes.properties()) == yes
