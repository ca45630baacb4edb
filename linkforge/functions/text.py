"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and fillers that names are compared without.
FILLERS = r"\b(pvt ltd|private limited|m/s|ltd|limited|llp|and|co|&)\b"


def trim(c: Column) -> Column:
    """Drops characters up to U+0020 at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(c: Column) -> Column:
    return F.length(trim(c)) == 0


def normal_name(c: Column) -> Column:
    """Lower case without legal forms; only a-z, 0-9 and single spaces stay."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), FILLERS, " "), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens between blanks and ASCII punctuation."""
    return F.array_remove(F.array_distinct(F.split(F.lower(trim(c)), r"[\s\p{Punct}]+")), "")
