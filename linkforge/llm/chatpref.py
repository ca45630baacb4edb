"""Preference formatting of conversations, in SQL expressions alone.

The longest common prefix of the turns of a chosen and a rejected conversation is rendered once, as the prompt. What
follows on either side is rendered as a completion, with the spans that the assistant wrote: the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, turn), "")


def head(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))


def body(x: Column) -> Column:
    """The text, in which nothing can pass for a marker, and the end marker."""
    return F.concat(F.replace(x["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def turn(x: Column) -> Column:
    return F.concat(head(x), body(x))


def mask(turns: Column) -> Column:
    """start:end of the assistant's bodies within the rendered turns (code points, end exclusive), comma-joined."""
    def step(s: Column, x: Column) -> Column:
        start, end = s["at"] + F.length(head(x)), s["at"] + F.length(head(x)) + F.length(body(x))
        return F.struct(end.alias("at"), F.when(x["role"] == LEARNED, F.array_append(s["out"], F.concat_ws(":", start, end))).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.array_join(s["out"], ","))


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row for each pair: pair_id, chosen_id, rejected_id, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt,
    chosen, rejected, chosen_mask, rejected_mask.

    turns has conv_id, turn, role, text; pair and chosen are columns of it (a side should hold one conversation; of
    several the ids' smallest is named). Turns are put in the order of turn, role and text (null turns first); equal
    rows count once. Null roles and texts count as empty. Rows with a null pair or side belong to no pair. A pair
    that lacks a side has an empty prompt and null for that side; if both sides are equal, the prompt is all and both
    completions are empty. An empty table gives an empty result; other columns of turns aren't read. One shuffle, on the
    pair; equal rows are merged before it.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    given = turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), F.col("conv_id"), one.alias("one")).where("pair_id is not null and is_chosen is not null")
    side = lambda yes: F.sort_array(F.collect_set(F.when(F.col("is_chosen") == yes, F.col("one"))))
    name = lambda yes: F.min(F.when(F.col("is_chosen") == yes, F.col("conv_id")))
    both = given.groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"), name(True).alias("chosen_id"), name(False).alias("rejected_id"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, least), F.slice("b", 1, least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    both = both.withColumn("same", same).withColumn("k", F.coalesce(F.nullif(F.array_position("same", F.lit(False)), F.lit(0)) - 1, F.size("same")).cast("int"))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.size(c))
    both = both.withColumn("ca", F.when(F.size("a") > 0, rest("a"))).withColumn("cb", F.when(F.size("b") > 0, rest("b")))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("k").cast("long").alias("n_prompt_turns"), F.size("ca").cast("long").alias("n_chosen_turns"), F.size("cb").cast("long").alias("n_rejected_turns"),
        rendered(F.slice("a", 1, F.col("k"))).alias("prompt"), rendered(F.col("ca")).alias("chosen"), rendered(F.col("cb")).alias("rejected"), mask(F.col("ca")).alias("chosen_mask"), mask(F.col("cb")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """The pairs of the query: conversation 2 k is chosen over conversation 2 k + 1, whole numbers of any size and sign."""
    return preference_pairs(turns, F.shiftright(F.col("conv_id").cast("long"), 1), F.col("conv_id").cast("long").bitwiseAND(F.lit(1)) == 0)


ORACLE_SQL = """
WITH d AS (SELECT DISTINCT CAST(conv_id AS BIGINT) >> 1 AS pair_id, conv_id % 2 = 0 AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT pair_id, min(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, min(conv_id) FILTER (conv_id % 2 <> 0) AS rejected_id
      FROM (SELECT conv_id, CAST(conv_id AS BIGINT) >> 1 AS pair_id FROM conversations WHERE conv_id IS NOT NULL) GROUP BY pair_id),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, c ORDER BY turn NULLS FIRST, role, text) AS i,
             '<|' || role || '|>' || chr(10) AS h, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS b FROM d),
m AS (SELECT pair_id, coalesce(a.i, b.i) AS i, coalesce(a.role = b.role AND a.text = b.text, false) AS same
      FROM (SELECT * FROM t WHERE c) a FULL JOIN (SELECT * FROM t WHERE NOT c) b USING (pair_id, i)),
k AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS k FROM m GROUP BY pair_id),
p AS (SELECT t.*, k, coalesce(sum(length(h) + length(b)) FILTER (i > k) OVER (PARTITION BY pair_id, c ORDER BY i), 0) AS upto FROM t JOIN k USING (pair_id)),
s AS (SELECT pair_id, any_value(k) AS k, coalesce(string_agg(h || b, '' ORDER BY i) FILTER (c AND i <= k), '') AS prompt,
             coalesce(string_agg(h || b, '' ORDER BY i) FILTER (c AND i > k), '') AS chosen, coalesce(string_agg(h || b, '' ORDER BY i) FILTER (NOT c AND i > k), '') AS rejected,
             coalesce(string_agg((upto - length(b)) || ':' || upto, ',' ORDER BY i) FILTER (c AND i > k AND role = 'assistant'), '') AS cm,
             coalesce(string_agg((upto - length(b)) || ':' || upto, ',' ORDER BY i) FILTER (NOT c AND i > k AND role = 'assistant'), '') AS rm,
             count(*) FILTER (c AND i > k) AS nc, count(*) FILTER (NOT c AND i > k) AS nr, bool_or(c) AS has_c, bool_or(NOT c) AS has_r FROM p GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, CAST(k AS BIGINT) AS n_prompt_turns, CASE WHEN has_c THEN nc END AS n_chosen_turns, CASE WHEN has_r THEN nr END AS n_rejected_turns,
       prompt, CASE WHEN has_c THEN chosen END AS chosen, CASE WHEN has_r THEN rejected END AS rejected, CASE WHEN has_c THEN cm END AS chosen_mask, CASE WHEN has_r THEN rm END AS rejected_mask
FROM s JOIN i USING (pair_id)
"""
