"""Read views."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.operators.model import MOST, Model
from linkforge.plans.batch import STATES, Status
from linkforge.schemas import FEATURES
from linkforge.sources.store import json_lines

#: The fields that reviewers see side by side.
COMPARED = ("businessName", "pan", "gstin", "address", "pinCode", "sector", "phone", "registrationDate")


def status_json(status: Status) -> str:
    """Double quotes in the step become single ones."""
    counts = {k: status.stats.get(k, 0) for k in ("totalRecords", "autoLinked", "pendingReview", "registrySize")}
    return json.dumps({"state": status.state, "step": status.step.replace('"', "'"), "batchId": status.batch_id, "lastUpdated": status.updated, "stats": counts}, separators=(",", ":"), ensure_ascii=False)


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n entries (at, message), newest first."""
    return log.orderBy(F.col("at").desc(), F.col("message").desc()).limit(n)


def progress(state: str) -> int:
    """Step of the progress bar: the first two states share one."""
    return max(0, STATES.index(state) - 1)


def registry_tail(registry: DataFrame, n: int = 50) -> DataFrame:
    """The last n rows in the order of their commits, and of their keys within one."""
    return registry.orderBy(F.col("commit").desc(), F.col("key").desc()).limit(n).orderBy("commit", "key")


def registry_lines(registry: DataFrame) -> DataFrame:
    """One JSON text a row: null fields, which only reviewed rows fill, are left out."""
    return json_lines(registry.drop("key", "commit", "batch_id"))


def queue_lines(queue: DataFrame) -> DataFrame:
    """One JSON text a row: numbers with four decimals, and nulls for what isn't decided."""
    four = lambda c: F.col(c).cast("decimal(6,4)")
    features = F.struct(*(four(f"features.{f}").alias(f) for f, _ in FEATURES)).alias("features")
    return json_lines(queue.select("id", "record1", "record2", four("score").alias("score"), features, "evidence", "status", "decision", "reviewNote", "createdAt"), keep_nulls=True)


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'PENDING'")


def comparison(items: DataFrame) -> DataFrame:
    """A row for each item and field: both values, match and differ."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"record1.{f}"), F.lit("")).alias("v1"), F.coalesce(F.col(f"record2.{f}"), F.lit("")).alias("v2")) for f in COMPARED)))
    both = (F.col("v1") != "") & (F.col("v2") != "")
    out = items.select("id", cells.alias("c")).select("id", "c.*")
    return out.withColumn("match", both & (F.lower("v1") == F.lower("v2"))).withColumn("differ", both & (F.lower("v1") != F.lower("v2")))


def score_band(score: Column) -> Column:
    return F.when(F.round(score * 100) >= 75, "high").otherwise("medium")


def feature_bands(items: DataFrame) -> DataFrame:
    """A row for each item and feature, with its colour."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"features.{f}").alias("value")) for f, _ in FEATURES)))
    return items.select("id", cells.alias("c")).select("id", "c.*").withColumn("band", F.when(F.col("value") >= 0.7, "green").when(F.col("value") >= 0.5, "yellow").otherwise("red"))


def weight_bars(weights: DataFrame) -> DataFrame:
    """Percent and width of each (name, weight)."""
    return weights.select("name", F.round(F.col("weight") * 100).cast("long").alias("percent"), F.least(F.round(F.col("weight") / MOST * 100), F.lit(100.0)).cast("long").alias("width"))


def most_weight(weights: DataFrame) -> DataFrame:
    """The largest weight, one hundredth at least, that bars can be scaled by."""
    return weights.agg(F.greatest(F.max("weight"), F.lit(0.01)).alias("weight"))


def model_json(model: Model) -> str:
    return model.to_json()


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
