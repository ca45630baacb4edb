"""Landing folders: readiness, feeds, archive."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.files import Files, Found
from linkforge.functions.text import trim
from linkforge.schemas import FIELDS

#: Names of feeds and of the marker that completes a batch.
FEED, MARKER = re.compile(r"dept_(.*)\.csv"), "confirmation.txt"
#: A field of a line: plain characters, and quoted runs that end at a quote or with the line; "" stands for a quote there.
QUOTED = r'"((?:[^"]++|"")*+)(?:"|$)'
FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|$))*+)'


def manifest(files: Files, folder: str) -> list[Found]:
    """Feeds in the order of their names; none if the folder is missing."""
    return [f for f in files.ls(folder) if FEED.fullmatch(f.name)]


def ready(files: Files, folder: str) -> bool:
    """Two feeds or more, and the marker; its content doesn't matter."""
    return len(manifest(files, folder)) >= 2 and files.exists(f"{folder}/{MARKER}")


def batch_id(found: list[Found]) -> str:
    """The same for the same files, however often a batch is tried: newest time, and a digest of names, sizes and times."""
    told = "\n".join(f"{f.name}\t{f.size}\t{f.time}" for f in found)
    return f"batch-{max(f.time for f in found)}-{hashlib.sha1(told.encode()).hexdigest()[:8]}"


def fields(line: Column) -> Column:
    """Values of one line: commas outside quotes divide, a quote anywhere toggles, two inside quotes are one.

    Fields are cut out by one pattern that never backtracks. In a field, a quoted run loses its quotes; what quotes are
    left stand in pairs.
    """
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda x: trim(F.replace(F.regexp_replace(x, QUOTED, "$1"), F.lit('""'), F.lit('"'))))


def read_feeds(spark: SparkSession, paths: list[str], date_index: int = 9) -> DataFrame:
    """Records of the feeds: the fields, source, and ord, which sorts by source file, then row.

    The first line of a file is its header; blank lines are skipped, short rows filled up with empty values, further
    columns ignored. A record's date is read at date_index (index 9 is empty in feeds of nine columns).
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    first = lines.groupBy("file").agg(F.min(F.struct("at", "id")).alias("head"))
    lines = lines.join(F.broadcast(first), "file").where("not (at = head.at and id = head.id)")  # a row for each feed
    lines = lines.withColumn("line", trim(F.col("value"))).where("line <> ''")
    cells = lines.select("file", "at", "id", fields(F.col("line")).alias("f"))
    cell = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    index = [*range(8), date_index]
    source = F.regexp_extract("file", FEED.pattern, 1)
    ord_ = F.format_string("%s\x1f%015d\x1f%019d", source, F.col("at"), F.col("id"))
    return cells.select(ord_.alias("ord"), source.alias("source"), *(cell(i).alias(n) for i, n in zip(index, FIELDS, strict=True)))


def archive(files: Files, folder: str, found: list[Found], to: str) -> None:
    """Moves the files of a batch's manifest, then the marker; files that came later stay."""
    for f in found:
        files.move(f.path, to)
    if files.exists(f"{folder}/{MARKER}"):
        files.move(f"{folder}/{MARKER}", to)
