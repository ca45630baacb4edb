import random

import pytest
from pyspark.sql import functions as F
from test_linkage import random_records

from linkforge.functions.similarity import jaro_winkler_of
from linkforge.operators import tiles
from linkforge.operators.candidates import address_pairs, prepared, theta
from linkforge.operators.model import Model
from linkforge.operators.scoring import cheap_features, joined, weighted
from linkforge.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("equal", [True, False])
def test_tiles_against_theta(spark, monkeypatch, equal):
    """Blocks of a few records, so that every key has many tiles; empty and odd addresses, near phones, hot pin codes."""
    monkeypatch.setattr(tiles, "BLOCK", 7)
    monkeypatch.setattr(tiles, "STRIP", 2)
    recs = prepared(random_records(spark, 31, 90)).persist()
    plain = cheap_features(joined(recs, theta(recs))).select("ord1", "ord2", "z1", "z2", F.round("address", 9).alias("address"), F.round(weighted(Model(), ("name",)), 9).alias("score")).collect()
    rows = tiles.feature_rows(recs.where("z <> ''") if equal else recs, F.col("z").alias("k"))
    made = tiles.equal_tiles(rows, "k") if equal else tiles.every_tile(rows)
    want = [r for r in plain if not equal or r["z1"] == r["z2"] != ""]
    assert sorted(map(tuple, tiles.compared(made, "v").collect())) == sorted((r["ord1"], r["ord2"], r["address"]) for r in want)
    assert sorted(map(tuple, tiles.compared(made, "v", Model()).collect())) == sorted((r["ord1"], r["ord2"], r["score"]) for r in want) and len(want) > 100


def test_a_grid_in_parts(spark, monkeypatch):
    recs = prepared(random_records(spark, 32, 90)).persist()
    found = lambda: sorted(map(tuple, tiles.compared(tiles.every_tile(tiles.feature_rows(recs)), "v").collect()))
    whole = found()
    monkeypatch.setattr(tiles, "GRID", 1)
    assert found() == whole


def test_names_against_plain():
    r = random.Random(33)
    names = list(dict.fromkeys("".join(r.choices("abc 1é𝄞", k=r.choice((0, 1, 2, 3, 8, 20, 40, 63, 64, 65, 90)))) for _ in range(150)))
    known = tiles.Names(names)
    for s in names:
        at = r.randrange(20)
        assert known.similarity(s, at).tolist() == [jaro_winkler_of(s, t) for t in names[at:]]


def test_rounding_as_spark(spark):
    values = [0.0, 1.0, 1 / 3, 2 / 3, 0.1234567895, 0.9999999995, 0.0009765625, 1.5e-9, 2.5e-9, 0.15 * 3 / 7, *(k / 1024 for k in range(1024))]
    want = [r["v"] for r in spark.createDataFrame(list(enumerate(values)), "i long, x double").select("i", F.round("x", 9).alias("v")).orderBy("i").collect()]
    assert tiles.rounded(tiles.np.array(values)).tolist() == want


@pytest.mark.parametrize("query", ["scored_pairs_cheap", "scored_pairs_all", "token_jaccard_pairs", "jaro_winkler_names"])
def test_pairs_are_never_shuffled(spark, query):
    """The pairs are made above all exchanges and joins."""
    told = plan(queries.queries()[query](spark, SF))
    assert "MapInArrow" in told and told.rindex("MapInArrow") < min(told.find(x) % len(told) for x in ("Exchange", "Join"))


def test_sets_are_compared_where_they_meet(spark):
    """Copies are compared once; no pair is written before its Jaccard is known, so there is no distinct of pairs."""
    recs = prepared(random_records(spark, 34, 60))
    two = recs.unionByName(recs.withColumn("ord", F.concat("ord", F.lit("'"))))
    rows = two.select("ord", "source", "at").collect()
    want = sorted((a["ord"], b["ord"]) for a in rows for b in rows if a["source"] < b["source"] and a["at"] and b["at"] and 2 * len(set(a["at"]) & set(b["at"])) >= len(set(a["at"]) | set(b["at"])))
    found = address_pairs(two, 0.5)
    assert sorted((x["o1"], x["o2"]) for x in found.collect()) == want and len(want) > 100
    assert "keys=[o1" not in plan(found)


@pytest.mark.parametrize("query", ["scored_pairs_cheap", "scored_pairs_all", "token_jaccard_pairs", "jaro_winkler_names"])
def test_texts_leave_python_once(spark, query):
    """Python gives blocks of pairs, each text once for many; the pairs are spelled out above it."""
    told = plan(queries.queries()[query](spark, SF))
    assert "Generate posexplode" in told and told.index("Generate posexplode") < told.index("MapInArrow")


def test_names_in_uneven_blocks(spark):
    """Both sides in blocks of sizes of their own, with names of every length around the limit of a word of bits."""
    r = random.Random(35)
    names = list(dict.fromkeys("".join(r.choices("ab 1", k=r.choice((0, 1, 3, 8, 20, 62, 63, 64, 65)))) for _ in range(60)))
    rows = [(n, *sorted(r.choices("abcd", k=2))) for n in names]
    known = spark.createDataFrame(rows, "n string, lo string, hi string")
    want = sorted((s, t, tiles.rounded(tiles.np.array([jaro_winkler_of(s, t)]))[0]) for s, lo, _ in rows for t, _, hi in rows if lo < hi)
    found = tiles.similar_names(tiles.every_tile(known, (7, 23))).collect()
    assert sorted(map(tuple, found)) == want and len(want) > 500
