"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a domain - language - source tree. A child that has fewer tokens than its share (at max_epochs passes)
takes all it has, and its siblings share the rest by their weights; only what a whole subtree lacks goes on to the
relatives of its ancestors. Each leaf then reads the budget as a prefix of its epochs: whole passes, and in one further
pass the documents in a seeded order, up to the last that still fits. That prefix is one number per leaf, the highest
sort key, so documents are chosen by a filter and their texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import SPACE, Scratch

LEVELS = ("domain", "lang", "source")
#: Fixed share of languages in the queries; every other child weighs 1.
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def shared(kids: DataFrame, parent: list[str], name: str, weight: Mapping[str, int]) -> DataFrame:
    """kids (parent path, name, cap, b: the parent's budget) with b, their own: the share by weight, or the capacity if
    that is less, the rest to the siblings.

    In the order of capacity by weight the children that take all they have come first: each of them has no more than
    its share of what those before have left over. Whole tokens; what rounding leaves goes to the others in the order
    of their names. A task holds the children of a parent (names and numbers).
    """
    whole = "decimal(38,0)"
    scale = lcm(*(w for w in weight.values() if w > 0), 1)
    known = F.create_map(*(F.lit(x) for pair in weight.items() for x in pair)) if weight else None
    w = F.coalesce(F.try_element_at(known, F.col(name)), F.lit(1)) if weight else F.lit(1)
    kids = kids.withColumn("w", w.cast(whole)).withColumn("cap", F.col("cap").cast(whole)).withColumn("open", (F.col("cap") > 0) & (F.col("w") > 0))
    kids = kids.withColumn("ratio", F.when(F.col("open"), (F.col("cap") * F.expr(f"cast({scale} as {whole}) div w")).cast(whole)))
    group = Window.partitionBy(*parent, "open")
    before = group.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast(whole)
    kids = kids.withColumn("cb", upto("cap")).withColumn("wb", upto("w")).withColumn("ws", F.sum("w").over(group).cast(whole))
    full = F.col("open") & (F.col("cap") * (F.col("ws") - F.col("wb")) <= (F.col("b") - F.col("cb")) * F.col("w"))
    kids = kids.withColumn("full", full)
    rest = Window.partitionBy(*parent, "open", "full")
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group)
    kids = kids.withColumn("left", (F.col("b") - taken).cast(whole)).withColumn("wr", F.sum("w").over(rest).cast(whole))
    kids = kids.withColumn("part", F.expr("case when open and not full and left > 0 then left * w div wr else 0 end").cast(whole))
    over = F.col("left") - F.sum("part").over(rest)
    extra = F.when((F.col("part") >= 0) & F.col("open") & ~F.col("full") & (F.row_number().over(rest.orderBy(name)) <= over), 1).otherwise(0)
    return kids.withColumn("own", F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + extra).cast("long")).select(*parent, name, F.col("own").alias("b"))


def budgets(totals: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """(leaf, t, b): the budget in tokens of each leaf (path of LEVELS) of totals (leaf, t); weights by level and child,
    1 if not given."""
    part = F.split("leaf", "\x1f")
    leaves = totals.select("leaf", "t", *(part[i].alias(x) for i, x in enumerate(LEVELS)))
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        kids = leaves.groupBy(*parent, level).agg((F.sum("t") * max_epochs).alias("cap"))
        kids = kids.withColumn("b", F.lit(budget).cast("long")) if given is None else kids.join(given, parent)
        given = shared(kids, parent, level, weights.get(level, {}))
    return leaves.join(given, list(LEVELS)).select("leaf", "t", "b")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")).cast("long")


def source_domain(source: Column) -> Column:
    """Domain of the test tables' sources: four groups by the number in the name, else "other"."""
    return F.coalesce(F.concat(F.lit("d"), (F.regexp_extract(source, r"(\d+)\z", 1).try_cast("int") % 4).cast("string")), F.lit("other"))


def plan(df: DataFrame, ratio: float, max_epochs: int, seed: int, weights: Mapping, domain: Column, id_col: str, text_col: str):
    """(rows, leaves): rows holds leaf, key parts and tokens, written; leaves holds leaf, epochs, rest, top, below.

    Tables by leaf are written, so that their joins are broadcast only where their size is known to allow it.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    rows = scratch.keep(df.select(F.col(id_col).alias("id"), leaf_of(domain).alias("leaf"), F.xxhash64(F.col(text_col)).alias("h"), word_count(F.col(text_col)).alias("tokens")), "rows")
    totals = scratch.keep(rows.groupBy("leaf").agg(F.sum("tokens").alias("t")), "totals")
    every = totals.agg(F.sum("t")).first()[0] or 0
    whole = F.when(F.col("t") > 0, F.expr("b div t")).otherwise(F.lit(1))
    known = budgets(totals, int(ratio * every), weights, max_epochs).select("leaf", whole.cast("long").alias("epochs"), F.when(F.col("t") > 0, F.col("b") % F.col("t")).otherwise(F.lit(0)).cast("long").alias("rest"))
    known = scratch.keep(known, "budgets")
    keyed = rows.join(known, "leaf").withColumn("key", order_key(seed))
    keyed = keyed.where("rest > 0 and tokens > 0").withColumn("bucket", F.shiftright("key", 52))
    sums = keyed.groupBy("leaf", "rest", "bucket").agg(F.sum("tokens").alias("s")).withColumn("upto", F.sum("s").over(Window.partitionBy("leaf").orderBy("bucket")))
    edge = sums.where("upto > rest").groupBy("leaf").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before")), "bucket").alias("e")).select("leaf", "e.*")
    edge = scratch.keep(edge, "edge")
    inner = keyed.join(edge, ["leaf", "bucket"]).groupBy("leaf", "rest", "before", "key").agg(F.sum("tokens").alias("s"))
    fits = inner.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("leaf").orderBy("key"))).where("upto <= rest").groupBy("leaf").agg(F.max("key").alias("top"))
    low = F.shiftleft(F.col("bucket").cast("long"), 52)  # no key of the edge bucket fits: all before that bucket
    tops = edge.join(fits, "leaf", "left").select("leaf", "top", low.alias("below"))
    return rows, scratch.keep(known.join(tops, "leaf", "left"), "leaves")


def leaf_of(domain: Column) -> Column:
    clean = lambda c: F.translate(F.coalesce(c.cast("string"), F.lit("\x00")), "\x1f", " ")
    return F.concat_ws("\x1f", clean(domain), clean(F.col("lang")), clean(F.col("source")))


def order_key(seed: int) -> Column:
    """Sort key of a row in the pass after its leaf's whole epochs: each epoch has its own order."""
    return F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id"), F.col("h"))


def copies() -> Column:
    inside = (F.col("rest") > 0) & (F.col("tokens") > 0) & F.coalesce(F.col("key") <= F.col("top"), F.col("key") < F.col("below"), F.lit(False))
    return F.col("epochs") + inside.cast("long")


def mix(df: DataFrame, ratio: float = 1.0, max_epochs: int = 4, seed: int = 42, weights: Mapping | None = None, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies): one row for each row of df that the mix takes once or more.

    The mix has ratio times the tokens of df at most. Tokens are words; texts without any (null ones too) take part in
    the whole epochs of their leaf only, and where a leaf has no tokens at all its rows are taken once. Null domain,
    language or source is a name of its own ("\\x00"). Equal rows of an id are taken together. Other columns aren't read; an
    empty table gives an empty result.
    """
    domain = source_domain(F.col("source")) if domain is None else domain
    rows, leaves = plan(df, ratio, max_epochs, seed, weights or {"lang": LANG_WEIGHTS}, domain, id_col, text_col)
    part = F.split("leaf", "\x1f")
    out = rows.join(leaves, "leaf").withColumn("key", order_key(seed)).withColumn("copies", copies()).where("copies > 0")
    return out.select(F.col("id").alias(id_col), *(part[i].alias(x) for i, x in enumerate(LEVELS)), "tokens", "copies")


def mixed(df: DataFrame, ratio: float, seed: int = 42, weights: Mapping | None = None, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with its columns, that a mix of one epoch takes: a filter with the row of each leaf.

    Null texts and those without words stay where their leaf is taken whole, and go otherwise; null domain, language and
    source are names of their own; rows that share id and text are taken together, ties of the sort key likewise.
    Other columns may have any names. An empty table gives an empty one.
    """
    domain = source_domain(F.col("source")) if domain is None else domain
    _, leaves = plan(df, ratio, 1, seed, weights or {"lang": LANG_WEIGHTS}, domain, id_col, text_col)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    given = df.select(F.col(id_col).alias("id"), leaf_of(domain).alias("leaf"), F.xxhash64(F.col(text_col)).alias("h"), word_count(F.col(text_col)).alias("tokens"), row)
    out = given.join(leaves, "leaf").withColumn("key", order_key(seed)).where(copies() > 0)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
