"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, minimal movement when shards are added."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch

#: Fixed value: the multiplier of the paper's linear congruential generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        state[todo] = state[todo] * MULTIPLIER + np.uint64(1)
        nxt = ((at[todo] + 1) * (float(1 << 31) / ((state[todo] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        todo, nxt = todo[nxt < shards], nxt[nxt < shards]
        at[todo] = nxt
    return at


def shard_of(key: Column, shards: int, whole_number: bool = True) -> Column:
    """Shard of a key column. Whole numbers are their own hash key; other types go through XXH64. A null key counts as 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return shard(F.coalesce(key.cast("long") if whole_number else F.xxhash64(key), F.lit(0).cast("long")))


def assign(df: DataFrame, key_col: str, shards: int) -> Column:
    """The shard column for df.withColumn: narrow, no shuffle; only the key goes to Python."""
    kind = df.schema[key_col].dataType.typeName()
    return shard_of(F.col(key_col), shards, kind in ("byte", "short", "integer", "long"))


def slotted(df: DataFrame, group: str = "shard", slot: str = "slot", bucket_rows: int = 50_000) -> DataFrame:
    """df with a slot, gapless from 0 within each shard, in the order of the other columns (nulls first).

    No task holds a whole shard: rows are dealt by ranges of shard and order, ranges are counted, and rows numbered
    within theirs. Equal rows are counted, numbered as one and expanded again, so that a row repeated any number of
    times is no hot key. Null values are ordinary ones; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "shards")
    counted = scratch.keep(df.groupBy(*df.columns).agg(F.count("*").alias("__n")), "counted")
    rows = counted.agg(F.count("*")).first()[0]
    first = [c for c in df.columns if c != group]
    # Written once: a range that is computed anew could get other bounds.
    dealt = scratch.keep(counted.repartitionByRange(max(1, -(-rows // bucket_rows)), group, *first).withColumn("__b", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(group, "__b").agg(F.sum("__n").alias("__s"))
    before = sums.select(group, "__b", (F.sum("__s").over(Window.partitionBy(group).orderBy("__b")) - F.col("__s")).alias("__before"))
    order = Window.partitionBy(group, "__b").orderBy(*first)
    inside = dealt.withColumn("__at", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    joined = inside.join(before, [group, "__b"])
    start = F.col("__before") + F.col("__at")
    return joined.select(*df.columns, F.explode(F.sequence(start, start + F.col("__n") - 1)).alias(slot))


def shard_documents(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the key law.

    doc_id and the number of shards alone decide the shard, equal texts included; grown_shard is the shard with one
    more. Slots follow doc_id, then size and CRC. size is the UTF-8 bytes (null: none) plus 1, text_crc32 unsigned over the same bytes (null as empty). Rows
    with a null doc_id go where key 0 goes. Every row of df gives one row; columns of df besides the two aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = small.select("*", assign(small, "doc_id", shards).alias("shard"), assign(small, "doc_id", shards + 1).alias("grown_shard"))
    out = slotted(placed).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its reflected polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in out]
    return out


def oracle(shards: int) -> str:
    """SQL for shard_documents: the jumps of every key up to one shard more, CRC-32 byte by byte."""
    table = ", ".join(f"CAST({x} AS BIGINT)" for x in crc_table())
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS s, coalesce(doc_id, 0) AS k FROM documents),
t AS (SELECT [{table}] AS crc),
j AS (SELECT DISTINCT k, CAST(CASE WHEN k < 0 THEN CAST(k AS HUGEINT) + 18446744073709551616 ELSE k END AS UHUGEINT) AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM d
      UNION ALL SELECT k, n, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(n // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
      FROM (SELECT k, j, (state * CAST({int(MULTIPLIER)} AS UHUGEINT) + 1) % CAST(18446744073709551616 AS UHUGEINT) AS n FROM j WHERE j <= {shards})),
h AS (SELECT k, CAST(max(b) FILTER (b < {shards}) AS INTEGER) AS shard, CAST(max(b) AS INTEGER) AS grown_shard FROM j GROUP BY k),
c AS (SELECT doc_id, CAST(strlen(s) + 1 AS BIGINT) AS size, shard, grown_shard,
             xor(list_reduce(list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
      FROM d JOIN h USING (k), t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM c
"""
