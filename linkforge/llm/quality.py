"""Line-first quality rules, in SQL expressions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document that
loses too much of its text, or fails the base rules, is rejected. No shuffle and no Python: one projection.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import SPACE

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
#: Phrases of boilerplate lines in English, German, French and Spanish, in lower case, and the length of the
#: longest such line.
BOILERPLATE = (
    "lorem ipsum", "javascript is disabled", "javascript required", "enable javascript", "use of cookies", "accept cookies", "our cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our", "sign up for", "click here", "read more", "skip to content", "skip to main",
    "alle rechte vorbehalten", "verwendung von cookies", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "klicken sie hier", "hier klicken", "weiterlesen", "mehr lesen", "zum inhalt springen", "javascript aktivieren",
    "tous droits réservés", "utilisation de cookies", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "abonnez-vous à", "cliquez ici", "lire la suite", "aller au contenu", "activer javascript",
    "todos los derechos reservados", "uso de cookies", "aceptar cookies", "política de privacidad", "términos de uso", "suscríbete a", "haga clic aquí", "haz clic aquí", "leer más", "ir al contenido", "activar javascript",
)
BOILERPLATE_CHARS = 200
#: What a menu's entries are divided by.
DIVIDERS = r"[|»›•·>/]"
#: A sentence's end: a mark, closing quotes or brackets, then a blank or the line's end.
SENTENCE_END = rf"[.!?…。！？][\"'”’»)\]]*([{SPACE}]|\z)"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def line_fails(line: Column) -> Column:
    """A non-blank line fails by punctuation (no sentence ends in it, or it has no letter or digit), as navigation
    (two dividers or more, at least one for three words), or as boilerplate (short, with such a phrase).

    The cheap test of each rule comes first; AND and OR stop early.
    """
    dividers = F.regexp_count(line, F.lit(rf"(^|[{SPACE}]){DIVIDERS}+([{SPACE}]|\z)"))
    navigation = line.rlike(DIVIDERS) & (dividers >= 2) & (3 * dividers >= F.size(words(line)))
    phrase = F.exists(F.array(F.lower(line)), lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in BOILERPLATE)))
    boilerplate = (F.length(line) <= BOILERPLATE_CHARS) & phrase
    return ~line.rlike(SENTENCE_END) | boilerplate | navigation | ~line.rlike(r"[\p{L}\p{N}]")


def with_repeat_words(df: DataFrame, words_col: str, out: str, size: int = 3) -> DataFrame:
    """df with out: the words in windows of size words that occur twice or more in the row's array of words.

    Windows are compared by a chained XXH64 of their words. Rows whose windows all differ, which a hash set tells, are
    done. In the others the windows are sorted with their places: equal ones are neighbours, and the places that they
    cover are counted as a set. Every step is its own column, so no array is computed twice.
    """
    words = F.col(words_col)
    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, size))))
    df = df.withColumn("__h", F.slice(hashes, 1, F.greatest(F.size(words) - size + 1, F.lit(0))))
    placed = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    twice = F.filter("__s", lambda x, k: (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + size - 1)))))
    return df.withColumn(out, F.when(F.col("__s").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("__h", "__s")


def judge(df: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """df with a struct column quality (in place of one of that name): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, kept_chars, lost_chars, clean_text, kept.

    Words are runs of characters other than the six ASCII blanks. Null counts as empty. The lost share is that of
    the characters of non-blank lines; a document without any is rejected by the base rules. clean_text is what is left
    when blank and failing lines are removed. Only text_col is read; columns of df whose names begin with "__" may be
    replaced. Repeated rows give repeated results, an empty table an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.withColumn("__t", text).withColumn("__w", words(F.col("__t"))).withColumn("__l", F.split("__t", "\n"))
    base = base.withColumn("__l", F.filter("__l", lambda x: x.rlike(f"[^{SPACE}]")))
    base = base.withColumn("__f", F.transform("__l", lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))))
    base = with_repeat_words(base, "__w", "__r")
    total = F.aggregate("__l", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    lost = F.aggregate("__f", F.lit(0).cast("long"), lambda s, x: s + F.when(x["fails"], F.length(x["line"])).otherwise(0))
    base = base.withColumn("__q", F.struct(
        F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.col("__r").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), F.size(F.filter("__f", lambda x: x["fails"])).cast("long").alias("n_failed_lines"), (total - lost).alias("kept_chars"), lost.alias("lost_chars"),
        F.array_join(F.transform(F.filter("__f", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    ))
    failed = (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))
    lossy = 100 * F.col("__q.lost_chars") > max_lost_percent * (F.col("__q.lost_chars") + F.col("__q.kept_chars"))
    return base.withColumn("quality", F.col("__q").withField("base_failed", failed).withField("kept", ~failed & ~lossy)).drop("__t", "__w", "__l", "__f", "__r", "__q")


def quality_report(df: DataFrame) -> DataFrame:
    """One row for each row of df (doc_id, text): the base counts, the verdict, and what the cleaning leaves (characters
    and MD5 of the cleaned text). Columns besides the two aren't read."""
    out = judge(df.select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars", "kept_chars")), F.md5(F.col("quality.clean_text")).alias("clean_md5"))


def keep_good(df: DataFrame, text_col: str = "text", clean: bool = False) -> DataFrame:
    """The rows of df that are kept, with all its columns; texts whole, or (clean) without blank and failing lines.

    Null and empty texts are rejected, repeated rows share their verdict, other columns may have any names.
    """
    judged = judge(df.select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")))
    # A filter isn't pushed below a projection with a partition id; pushed, it would compute the arrays once per use.
    judged = judged.select("row", "quality.kept", *(["quality.clean_text"] if clean else []), F.spark_partition_id().alias("at"))
    return judged.where("kept and at >= 0").select(*(F.col("clean_text" if clean and c == text_col else f"row.`{c}`").alias(c) for c in df.columns))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
a AS (SELECT doc_id, s, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
b AS (SELECT doc_id, s, w, l, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE [] END) AS i FROM a),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM b),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, list_filter(l, lambda x: {fails}) AS bad, list_filter(l, lambda x: NOT ({fails})) AS good FROM a),
q AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(bad) AS BIGINT) AS n_failed_lines,
             CAST(length(array_to_string(bad, '')) AS BIGINT) AS lost_chars, CAST(length(array_to_string(good, '')) AS BIGINT) AS kept_chars, md5(array_to_string(good, chr(10))) AS clean_md5, length(array_to_string(l, '')) AS total
      FROM a JOIN f USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= {max_lost} * total AS kept, n_lines, n_failed_lines, lost_chars, kept_chars, clean_md5 FROM v
"""


def oracle() -> str:
    n = r"len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))"
    d = rf"len(regexp_extract_all(x, '(?:^|[\x20\x09-\x0D]){DIVIDERS}+(?:[\x20\x09-\x0D]|\z)'))"
    end = SENTENCE_END.replace("'", "''")
    phrases = "|".join(BOILERPLATE).replace("'", "''")
    fails = rf"NOT regexp_matches(x, '{end}') OR ({d} >= 2 AND 3 * {d} >= {n}) OR (length(x) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(x), '{phrases}')) OR NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')"
    return ORACLE_SQL.format(fails=fails, min_words=MIN_WORDS, max_repeat=MAX_REPEAT_PERCENT, max_lost=MAX_LOST_PERCENT)
