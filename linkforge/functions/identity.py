"""Identifiers made from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.text import blank, trim

#: Fixed value: what stands before a key when it is hashed.
NAMESPACE = "UBID:"


def name_uuid(text: Column) -> Column:
    """Version 3 UUID of the MD5 of a text's bytes, without a namespace."""
    h = F.md5(text)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def key_id(key: Column) -> Column:
    """Identifier of a tax key; null if the key is blank."""
    return F.when(~blank(key), name_uuid(F.concat(F.lit(NAMESPACE), F.upper(trim(key)))))


def fallback_id(batch_id: str, ord_: Column) -> Column:
    """Identifier of a group without keys: the same on every retry of a batch."""
    return name_uuid(F.concat(F.lit(f"{batch_id}:"), ord_))
