"""Feature vectors, weighted scores, zones and evidence of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.similarity import exact, jaccard, jaro_winkler, phones
from linkforge.operators.candidates import SLACK
from linkforge.operators.model import IDENTIFIER_FLOOR, Model
from linkforge.schemas import FEATURES


def joined(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = (recs.select(*(F.col(c).alias(f"{c}{i}") for c in recs.columns)) for i in (1, 2))
    return pairs.withColumnsRenamed({"o1": "ord1", "o2": "ord2"}).join(a, "ord1").join(b, "ord2")


def cheap_features(pairs: DataFrame) -> DataFrame:
    """All features but the name's."""
    x = lambda c: (F.col(f"{c}1"), F.col(f"{c}2"))
    return pairs.withColumns({
        "pan_match": exact(*x("p")), "gstin_match": exact(*x("g")), "address": jaccard(F.col("a1"), F.col("at1"), F.col("a2"), F.col("at2")), "pinCode": exact(*x("z")), "sector": exact(*x("s")), "phone": phones(*x("t")),
    }).withColumn("identifier", F.greatest("pan_match", "gstin_match"))


def weighted(model: Model, without: tuple[str, ...] = ()) -> Column:
    """The weighted sum, added in the order of FEATURES."""
    terms = [F.lit(model.weight_of(f)) * F.col(f) for f, _ in FEATURES if f not in without]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def evidence() -> Column:
    said = lambda test, text: F.when(test, F.lit(text))
    return F.concat_ws(", ", F.format_string("Name: %.2f", "name"), said(F.col("pan_match") == 1, "PAN: match"), said(F.col("gstin_match") == 1, "GSTIN: match"), F.format_string("Address: %.2f", "address"), said(F.col("pinCode") == 1, "PinCode: match"), said(F.col("sector") == 1, "Sector: match"), said(F.col("phone") == 1, "Phone: match"))


def zone(model: Model) -> Column:
    return F.when(F.col("score") >= model.auto_link, "AUTO_LINK").when(F.col("score") >= model.review, "REVIEW").otherwise("SEPARATE")


def with_names(pairs: DataFrame) -> DataFrame:
    """pairs with name, the similarity of n1 and n2: computed in place, since a join on names would write all pairs anew."""
    return pairs.withColumn("name", jaro_winkler(F.col("n1"), F.col("n2")))


def scores(recs: DataFrame, pairs: DataFrame, model: Model, prune: bool = True) -> DataFrame:
    """Pairs with features, score, zone and evidence, without the records.

    prune drops, before names are compared, pairs that can't reach the review threshold even with equal names.
    """
    out = cheap_features(joined(recs.drop("rec").withColumn("a", F.substring("a", 1, 1)), pairs))  # of a only whether it is empty
    if prune:
        out = out.where((F.col("identifier") == 1) | (weighted(model, ("name",)) + model.weight_of("name") >= model.review - SLACK))
    out = with_names(out).withColumn("weighted", weighted(model))
    out = out.withColumn("score", F.when(F.col("identifier") == 1, F.greatest(F.lit(IDENTIFIER_FLOOR), "weighted")).otherwise(F.col("weighted")))
    features = F.struct(*(F.col(f) for f, _ in FEATURES)).alias("features")
    return out.withColumn("zone", zone(model)).withColumn("evidence", evidence()).select("ord1", "ord2", features, "pan_match", "gstin_match", "weighted", "score", "zone", "evidence")


def with_records(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with rec1 and rec2: for the few pairs that a zone has kept."""
    a, b = (recs.select(F.col("ord").alias(f"ord{i}"), F.col("rec").alias(f"rec{i}")) for i in (1, 2))
    return pairs.join(a, "ord1").join(b, "ord2")


def scored(recs: DataFrame, pairs: DataFrame, model: Model, prune: bool = True) -> DataFrame:
    """scores with the records."""
    return with_records(recs, scores(recs, pairs, model, prune))
