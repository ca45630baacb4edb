"""Clusters of automatic links, registry rows and review items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.identity import fallback_id, key_id, name_uuid
from linkforge.functions.text import blank
from linkforge.operators.components import components
from linkforge.operators.model import IDENTIFIER_FLOOR, Model
from linkforge.schemas import FEATURES
from linkforge.scratch import Scratch

#: Evidence of rows without a link.
ALONE, NOT_SAME = "No matching records found", "Human reviewer: not same business"


def identifier_edges(recs: DataFrame) -> DataFrame:
    """(a, b): each record with the first one of its PAN or GSTIN, if two sources or more hold that key.

    Such a key connects all its holders, so these stars have the components of all pairs in linear size.
    """
    parts = []
    for kind in ("p", "g"):
        keyed = recs.where(F.col(kind) != "").select("ord", "source", F.col(kind).alias("k"))
        hubs = keyed.groupBy("k").agg(F.min("ord").alias("b"), F.min("source").alias("s1"), F.max("source").alias("s2")).where("s1 <> s2").select("k", "b")
        parts.append(keyed.join(hubs, "k").select(F.col("ord").alias("a"), "b"))
    return parts[0].unionByName(parts[1])


def clustered(recs: DataFrame, pairs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(ord, comp) of all records; a record without a link is its own component."""
    links = pairs.where("zone = 'AUTO_LINK'")
    if model.auto_link <= IDENTIFIER_FLOOR:
        links = links.where("features.identifier < 1")
    edges = links.select(F.col("ord1").alias("a"), F.col("ord2").alias("b"))
    if model.auto_link <= IDENTIFIER_FLOOR:
        edges = edges.unionByName(identifier_edges(recs))
    found = components(edges, scratch)
    return recs.select("ord").join(found.select(F.col("v").alias("ord"), "c"), "ord", "left").select("ord", F.coalesce("c", "ord").alias("comp"))


def registry_rows(recs: DataFrame, comps: DataFrame, pairs: DataFrame, batch_id: str, linked_at: str) -> DataFrame:
    """A row for each cluster and for each record without a link, members in the order of their sources and rows.

    key is the row's place within its batch; the number of the batch's commit comes before it.
    """
    one = F.struct("ord", "rec")
    members = recs.join(comps, "ord").groupBy("comp").agg(F.sort_array(F.collect_list(one)).alias("ms"))
    links = pairs.where("zone = 'AUTO_LINK'").select(F.col("ord1").alias("ord"), "ord2", "score", "evidence").join(comps, "ord")
    best = links.groupBy("comp").agg(F.max(F.struct("score", F.lit(0).alias("zero"))).alias("top"), F.min_by("evidence", F.struct(-F.col("score"), "ord", "ord2")).alias("evidence")).drop("top")
    first = lambda test, value: F.get(F.transform(F.filter("ms", test), value), F.lit(0))
    has = lambda c: (lambda m: ~blank(m["rec"][c]))
    get = lambda c: (lambda m: m["rec"][c])
    ubid = F.coalesce(key_id(first(has("pan"), get("pan"))), key_id(first(has("gstin"), get("gstin"))), fallback_id(batch_id, F.col("comp")))
    many = F.size("ms") > 1
    return members.join(best, "comp", "left").select(
        ubid.alias("ubid"), F.coalesce(first(has("businessName"), get("businessName")), F.lit("Unknown")).alias("businessName"), F.array_distinct(F.transform("ms", get("source"))).alias("sources"), F.transform("ms", lambda m: m["rec"]).alias("records"),
        F.when(many, F.coalesce("evidence", F.lit(""))).otherwise(ALONE).alias("evidence"), F.lit(linked_at).alias("linkedAt"), many.alias("autoLinked"), F.lit(None).cast("boolean").alias("humanVerified"), F.lit(None).cast("double").alias("score"), F.col("comp").alias("key"),
    )


def review_items(pairs: DataFrame, batch_id: str, created_at: str) -> DataFrame:
    """The queue's items; ids are the same on every retry of a batch."""
    id_ = name_uuid(F.concat_ws("\x1f", F.lit(f"review:{batch_id}"), "ord1", "ord2"))
    rounded = F.struct(*(F.round(F.col(f"features.{f}"), 4).alias(f) for f, _ in FEATURES))
    return pairs.where("zone = 'REVIEW'").select(id_.alias("id"), F.col("rec1").alias("record1"), F.col("rec2").alias("record2"), F.round("score", 4).alias("score"), rounded.alias("features"), "evidence", F.lit(created_at).alias("createdAt"))


def reviewed_rows(decided: DataFrame, linked_at: str) -> DataFrame:
    """Registry rows of decided items (with a column match): one for a match (PAN of either record), else one for each
    record. A record's GSTIN gives no id here."""
    pan = lambda r: key_id(F.col(f"{r}.pan"))
    made = lambda *part: name_uuid(F.concat(F.lit("review:"), F.col("id"), *part))
    row = lambda ubid, name, records, why, score, key: F.struct(ubid.alias("ubid"), name.alias("businessName"), records.alias("records"), why.alias("evidence"), score.alias("score"), key.alias("key"))
    none = F.lit(None).cast("double")
    one = row(F.coalesce(pan("record1"), pan("record2"), made()), F.col("record1.businessName"), F.array("record1", "record2"), F.col("evidence"), F.col("score"), F.col("id"))
    each = [row(F.coalesce(pan(r), made(F.lit(f":{r}"))), F.col(f"{r}.businessName"), F.array(r), F.lit(NOT_SAME), none, F.concat("id", F.lit(f"/{r}"))) for r in ("record1", "record2")]
    rows = decided.select(F.explode(F.when(F.col("match"), F.array(one)).otherwise(F.array(*each))).alias("x")).select("x.*")
    return rows.select("ubid", "businessName", F.transform("records", lambda r: r["source"]).alias("sources"), "records", "evidence", F.lit(linked_at).alias("linkedAt"), F.lit(False).alias("autoLinked"), F.lit(True).alias("humanVerified"), "score", "key")
