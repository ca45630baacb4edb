"""The scratch folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from linkforge.files import Files

#: Executors need not have the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new local folder, on a local master alone: elsewhere executors would
    each write to their own machine and tables would be read incomplete."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="linkforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the scratches that are in use.
OPEN: set[str] = set()


def close_all(spark: SparkSession) -> None:
    """Deletes the tables of all scratches: for a session's end, or once the results of its queries are written."""
    for root in list(OPEN):
        Files(spark).delete(root)
        OPEN.discard(root)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. A scratch table's size is taken from its compressed files, so a long
    table can pass for a small one, and what is broadcast is gathered and held in the driver's memory."""
    return df.hint("merge")


#: Whether an execution's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in a folder of their own below the shared one; they cut lineage and outlive lost executors.

    Results read them, so they stay until close(), when results are written, or close_all()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.serial = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}
        OPEN.add(self.root)

    def path(self, part: str) -> str:
        self.serial += 1
        return f"{self.root}/{part}-{self.serial}"

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        conf, path = self.spark.conf, self.path(part)
        before = conf.get(CLEANED, None)
        conf.set(CLEANED, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = out, path  # the frame is held, so that its id stays its own
        return out

    def drop(self, df: DataFrame) -> None:
        if found := self.kept.pop(id(df), None):
            Files(self.spark).delete(found[1])

    def close(self) -> None:
        Files(self.spark).delete(self.root)
        self.kept.clear()
        OPEN.discard(self.root)
