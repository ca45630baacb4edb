"""Pairs of records from different sources that can reach the review threshold."""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.similarity import jaro_winkler
from linkforge.functions.text import normal_name, tokens, trim
from linkforge.operators.model import Model
from linkforge.scratch import shuffled

SLACK = 1e-9


def prepared(records: DataFrame) -> DataFrame:
    """Records with what every pair needs, computed once per record: (ord, source, rec, and keys)."""
    low = {"pan": "p", "gstin": "g"}
    out = records.select(
        "ord", "source", F.struct(*(F.col(c) for c in records.columns if c not in ("ord", "source", "batch_id")), "source").alias("rec"), normal_name(F.col("businessName")).alias("n"), trim(F.col("address")).alias("a"),
        *(F.lower(trim(F.col(c))).alias(x) for c, x in low.items()), trim(F.col("pinCode")).alias("z"), trim(F.col("sector")).alias("s"), trim(F.col("phone")).alias("t"),
    )
    return out.withColumn("at", tokens(F.col("a")))


def theta(recs: DataFrame) -> DataFrame:
    """Every cross-source pair (o1, o2), the earlier source first: the plain form that blocking is held against."""
    a, b = (recs.select(F.col("ord").alias(f"o{i}"), F.col("source").alias(f"s{i}")) for i in (1, 2))
    return a.join(b, F.col("s1") < F.col("s2")).select("o1", "o2")


def same_key(recs: DataFrame, key: Column) -> DataFrame:
    """Cross-source pairs with an equal key that isn't null: an equi-join."""
    keyed = recs.select("ord", "source", key.alias("k")).where("k is not null")
    a = keyed.select("k", F.col("ord").alias("o1"), F.col("source").alias("s1"))
    b = keyed.select("k", F.col("ord").alias("o2"), F.col("source").alias("s2"))
    return a.join(b, "k").where("s1 < s2").select("o1", "o2")


def identifier_pairs(recs: DataFrame) -> DataFrame:
    """Pairs with an equal PAN or an equal GSTIN: two equi-joins, never an OR condition."""
    return same_key(recs, F.nullif("p", F.lit(""))).unionByName(same_key(recs, F.nullif("g", F.lit("")))).distinct()


def phone_keys(t: Column) -> Column:
    """Keys of a phone, of which two phones at one edit share one: phones that are equal or differ by a substitution agree
    in all but one place, and one that lacks a character equals the other without it."""
    places = F.sequence(F.lit(1), F.length(t))
    without = lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    key = lambda at, rest: F.struct(at.alias("at"), rest.alias("rest"))
    return F.array_distinct(F.concat(F.array(key(F.lit(0), t)), F.transform(places, lambda i: key(i, without(i))), F.transform(places, lambda i: key(F.lit(0), without(i)))))


def near_phones(phones: DataFrame, *by: str) -> DataFrame:
    """(by, t1, t2) of phones t, given and with equal by, that are at most one edit apart: an equi-join on their keys."""
    keyed = phones.where("t <> ''").distinct().select(*by, "t", F.explode(phone_keys(F.col("t"))).alias("x"))
    a, b = (keyed.select(*by, "x", F.col("t").alias(f"t{i}")) for i in (1, 2))
    return a.join(b, [*by, "x"]).where(F.levenshtein("t1", "t2", 1) >= 0).select(*by, "t1", "t2").distinct()


def phone_pairs(recs: DataFrame) -> DataFrame:
    """Cross-source pairs (o1, o2) whose phones are given and at most one edit apart.

    Found among distinct phones; records join the phones that are left.
    """
    near = near_phones(recs.select("t"))
    x, y = (recs.select(F.col("t").alias(f"t{i}"), F.col("ord").alias(f"o{i}"), F.col("source").alias(f"s{i}")) for i in (1, 2))
    return near.join(x, "t1").join(y, "t2").where("s1 < s2").select("o1", "o2")


def ranked_tokens(recs: DataFrame) -> DataFrame:
    """recs with ws, the address tokens in one global order, rare ones first."""
    words = recs.select("ord", F.explode("at").alias("w"))
    rank = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(rank, "w").groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws"))
    return recs.join(ranked, "ord", "left")


def prefix(least: float) -> Column:
    """Prefix filter: two token sets with a Jaccard of least (> 0) or more share one of the first n - ceil(least n) + 1
    tokens of each, in any one order."""
    n = F.size("at")
    cut = (n - F.ceil(n * F.lit(least) - SLACK) + 1).cast("int")
    return F.transform(F.slice("ws", 1, F.greatest(cut, F.lit(1))), lambda x: x["w"])


#: Words of the bit set that stands for a record's tokens, 64 bits each.
WORDS = 4
BITS = tuple(f"b{i}" for i in range(WORDS))


def with_bits(recs: DataFrame) -> DataFrame:
    """recs with b0, b1, ...: a bit set of the tokens at; e: their number; extra: those that share a bit with another."""
    bits = {b: F.expr(f"aggregate(filter(at, w -> pmod(xxhash64(w), {WORDS}) = {i}), 0L, (x, w) -> x | shiftleft(1L, cast(pmod(xxhash64(w) div {WORDS}, 64) AS int)))") for i, b in enumerate(BITS)}
    out = recs.withColumns(bits | {"e": F.size("at")})
    return out.withColumn("extra", F.col("e") - sum((F.bit_count(b).cast("int") for b in BITS[1:]), F.bit_count("b0").cast("int")))


def most_common() -> Column:
    """How many tokens two sides can share at most: as many as they share bits, and as the one with fewer tokens on a common
    bit has besides. One short expression with each part once: the JVM interprets the code of a join that gets too long."""
    shared = [F.bit_count(F.col(f"{b}1").bitwiseAND(F.col(f"{b}2"))).cast("int") for b in BITS]
    return F.least("e1", "e2", sum(shared[1:], shared[0]) + F.least("extra1", "extra2"))


def address_pairs(recs: DataFrame, least: float) -> DataFrame:
    """Cross-source pairs (o1, o2, jaccard) with a token Jaccard of least (> 0) or more; addresses without tokens agree
    with none here.

    Distinct token sets are compared, in the join of their prefix filters' tokens that makes a pair: a pair that its bits
    rule out, or that an earlier common token of both prefixes makes too, ends there and is never written. Records then join
    the pairs of sets that are left.
    """
    known = recs.where(F.size("at") > 0).select("ord", "source", F.sort_array("at").alias("at"))
    sets = known.groupBy("at").agg(F.min("ord").alias("ord"))
    keyed = with_bits(ranked_tokens(sets)).withColumn("pre", prefix(least))
    rows = keyed.select("ord", "at", "e", "extra", *BITS, "pre", F.posexplode("pre").alias("place", "k"))
    a, b = (rows.select("k", *(F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "k")) for i in (1, 2))
    # With a set that isn't smaller, n tokens must share 2 least / (1 + least) n, so one of fewer tokens than prefix() gives.
    a = a.where(F.col("place1") <= F.col("e1") - F.ceil(F.col("e1") * F.lit(2 * least / (1 + least)) - SLACK))
    smaller = (F.col("e1") < F.col("e2")) | (F.col("e1") == F.col("e2")) & (F.col("ord1") < F.col("ord2"))
    met = shuffled(a).join(shuffled(b), "k").where(smaller & (most_common() * (1 + least) >= (F.col("e1") + F.col("e2")) * (least - SLACK)))
    both = F.size(F.array_intersect("at1", "at2"))
    jaccard = both.cast("double") / (F.col("e1") + F.col("e2") - both)
    near = met.where((F.array_intersect("pre1", "pre2")[0] == F.col("k")) & (jaccard >= least - SLACK)).select(F.col("ord1").alias("x"), F.col("ord2").alias("y"), jaccard.alias("jaccard"))
    near = near.unionByName(sets.select(F.col("ord").alias("x"), F.col("ord").alias("y"), F.lit(1.0).alias("jaccard")))
    held = known.join(shuffled(sets.withColumnRenamed("ord", "set")), "at").select("set", "ord", "source")
    m1, m2 = (held.select(F.col("set").alias(c), F.col("ord").alias(f"ord{i}"), F.col("source").alias(f"s{i}")) for i, c in ((1, "x"), (2, "y")))
    found = near.join(shuffled(m1), "x").join(shuffled(m2), "y").where((F.col("s1") < F.col("s2")) | (F.col("x") != F.col("y")) & (F.col("s1") > F.col("s2")))
    first = F.col("s1") < F.col("s2")
    return found.select(F.when(first, F.col("ord1")).otherwise(F.col("ord2")).alias("o1"), F.when(first, F.col("ord2")).otherwise(F.col("ord1")).alias("o2"), "jaccard")


class Block(NamedTuple):
    """One equi-join: keys of equal features (of z: pin code, s: sector, n: name), of phones at one edit, and of the
    address: tokens (with the Jaccard it must reach), empty (both without tokens), or nothing of it."""

    same: frozenset
    phones: bool
    address: str = ""
    least: float = 0.0

    def holds(self, other: Block) -> bool:
        """Whether this block finds whatever the other one does."""
        wider = self.same <= other.same and self.phones <= other.phones
        return wider and (self.address == "" or self.address == other.address and self.least <= other.least)


def blocks(model: Model) -> list[Block] | None:
    """Blocks that together hold all pairs without an equal identifier that reach the review threshold; None if no key
    can tell them.

    For each choice of which of pin code, sector and phone agree, the rest of the score must come from name and
    address: so the address must reach a Jaccard, or both are without tokens (which counts as 1) and the name must
    reach a similarity. Where that is 1, the names are equal.
    """
    w = model.weight_of
    found: list[Block] = []
    for pin, sector, phone in product((0, 1), repeat=3):
        rest = model.review - pin * w("pinCode") - sector * w("sector") - phone * w("phone")
        same = frozenset(["z"] * pin + ["s"] * sector)
        if rest > w("name") + w("address") + SLACK:
            continue  # not even with equal names and addresses
        alone = rest <= w("name") - SLACK or rest <= w("name") + SLACK and w("address") <= 0
        if alone or phone and pin:  # a name alone can do it, or phone and pin code are keys that tell more than tokens
            found.append(Block(same, bool(phone)))
            continue
        if rest <= w("name") + SLACK:
            found.append(Block(same | {"n"}, bool(phone)))  # an equal name alone, or any token in common
        found.append(Block(same, False, "tokens", max((rest - w("name") - SLACK) / w("address"), SLACK)))
        name = (rest - w("address") - SLACK) / w("name") if w("name") > 0 else 0.0
        found.append(Block(same | ({"n"} if name > 1 - 1e-6 else set()), bool(phone), "empty"))
    if any(not b.same and not b.phones and b.address == "" for b in found):
        return None
    found = list(dict.fromkeys(found))
    return [b for b in found if not any(x != b and x.holds(b) and not (b.holds(x) and found.index(x) > found.index(b)) for x in found)]


def block_keys(b: Block, tag: Column) -> Column:
    """Hashes of a record's keys in a block, with the block's tag; none if a feature that must agree is missing. The key of
    a block of phones is what must agree besides the phone."""
    parts = [F.col(c) if c == "n" else F.lower(F.nullif(c, F.lit(""))) for c in sorted(b.same)]  # names may be empty and equal
    told = F.lit(True)
    for x in parts:
        told = told & x.isNotNull()
    if b.phones:
        told = told & (F.col("t") != "")
    if b.address == "empty":
        parts.append(F.col("a") == "")
        told = told & (F.size("at") == 0)
    if b.address == "tokens":
        keys = F.transform(prefix(b.least), lambda w: F.xxhash64(tag, *parts, w))
    else:
        keys = F.array(F.xxhash64(tag, *parts))
    return F.coalesce(F.when(told, keys), F.array().cast("array<bigint>"))


LIGHT = ("ord", "source", "n", "t", "zh", "sh", "e", "extra", *BITS)


def light(recs: DataFrame, *more: Column) -> DataFrame:
    """What bounds a pair's score, in a row short enough to travel with every key: hashes of pin code and sector, the name,
    the phone, the number of tokens, and a bit set of the tokens."""
    hashed = lambda c: F.when(F.col(c) != "", F.xxhash64(F.lower(c)))
    return with_bits(recs).select("ord", "source", "n", "t", hashed("z").alias("zh"), hashed("s").alias("sh"), "e", "extra", *BITS, *more)


def sides(rows: DataFrame, *keys: str) -> list[DataFrame]:
    return [rows.select(*keys, *(F.col(c).alias(f"{c}{i}") for c in LIGHT)) for i in (1, 2)]


def worth(pairs: DataFrame, model: Model) -> DataFrame:
    """(o1, o2) of those pairs of light rows that can reach the review threshold without an equal identifier.

    Names are compared here, where the pair is made, and only if the rest leaves them a chance.
    """
    w = lambda f: F.lit(max(model.weight_of(f), 0.0))
    agree = lambda test, f: F.when(test, w(f)).otherwise(F.lit(0.0))
    both = most_common()
    jaccard = F.coalesce(1.0 / (F.try_divide(F.col("e1") + F.col("e2"), both) - 1.0), (F.col("e1") + F.col("e2") == 0).cast("double"))
    near = (F.col("t1") != "") & (F.col("t2") != "") & (F.levenshtein("t1", "t2", 1) >= 0)
    rest = w("address") * jaccard + agree(F.col("zh1") == F.col("zh2"), "pinCode") + agree(F.col("sh1") == F.col("sh2"), "sector")
    least = model.review - 1e-6
    some = pairs.where(rest + agree(near, "phone") + w("name") >= least)
    some = some.select(F.col("ord1").alias("o1"), F.col("ord2").alias("o2"), "n1", "n2", (rest + agree(near, "phone")).alias("rest"))
    if model.weight_of("name") > 0:
        some = some.where(F.col("rest") + w("name") * jaro_winkler(F.col("n1"), F.col("n2")) >= least)
    return some.select("o1", "o2")


def blocked(recs: DataFrame, model: Model) -> DataFrame:
    """Distinct pairs (o1, o2) that hold every pair with a score of the review threshold or more.

    The blocks that follow from the model's weights are keys of one equi-join, those of phones another one, over the phones
    that are near. Keys are hashed: a collision adds a candidate. What bounds the score travels with the keys, so a pair
    that can't reach the threshold is dropped where the join makes it and is never written. If no key can tell such pairs,
    all cross-source pairs are candidates.
    """
    plan = blocks(model)
    ids = identifier_pairs(recs)
    if plan is None:
        a, b = sides(light(recs))
        return worth(a.join(b, F.col("source1") < F.col("source2")), model).unionByName(ids).distinct()
    tagged = list(enumerate(plan))
    keys = lambda phones: F.array_distinct(F.concat(F.array().cast("array<bigint>"), *(block_keys(b, F.lit(i)) for i, b in tagged if b.phones == phones)))
    ranked = ranked_tokens(recs.drop("rec")).withColumn("ks", keys(False))
    rows = light(ranked, F.explode(F.expr("transform(ks, (x, i) -> struct(x AS k, if(i > 0, get(ks, i - 1), null) AS k0))")).alias("x"))
    a, b = (x.select("x.k", F.col("x.k0").alias(f"k0{i}"), *(c for c in x.columns if c != "x")) for i, x in enumerate(sides(rows, "x"), 1))
    # Records whose keys before this one are equal too meet there: copies are found once, not under each of their keys.
    pairs = a.join(b, "k").where("source1 < source2 and (k01 is null or k02 is null or k01 <> k02)").drop("k", "k01", "k02")
    if any(b.phones for b in plan):
        rows = light(recs.drop("rec"), F.explode(keys(True)).alias("k"))
        a, b = sides(rows, "k")
        near = near_phones(rows.select("k", "t"), "k")
        found = near.join(a, ["k", "t1"]).join(b, ["k", "t2"]).where("source1 < source2")
        pairs = pairs.unionByName(found.select(pairs.columns))
    return worth(pairs, model).unionByName(ids).distinct()
