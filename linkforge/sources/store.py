"""Stored tables: JSON lines by batch, and a log of commits that makes them visible.

A commit is one numbered file that names its batch, the feeds it read, and the model's next version if it has learned.
Rows, decisions and weights appear together with that file, or not at all; a batch that is tried again rewrites its rows
before, and finds its commit after. Snapshots gather what many commits wrote, so readers open a few folders.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkforge.files import Files, Found
from linkforge.operators.model import Model
from linkforge.schemas import DECISION, REGISTRY, REVIEW_ITEM

TABLES = {"registry": REGISTRY, "review_items": REVIEW_ITEM, "review_decisions": DECISION}
#: What reading adds to every row: its batch and the number of its commit.
ADDED = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("commit", T.LongType())])


class Store:
    """Registry, review queue, decisions and model versions below one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, str(root).rstrip("/"), Files(spark)
        self._known: dict[str, dict] = {}
        for d in ("landing", "archive", "commits", "snapshots", *TABLES):
            self.files.make(f"{self.root}/{d}")

    def put(self, table: str, batch_id: str, df: DataFrame) -> None:
        """Writes, or writes again, a batch's part of a table."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"{batch_id!r} is no batch id")
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{self.root}/{table}/batch_id={batch_id}")

    def snapshot(self) -> tuple[int, dict]:
        """Number of the last commit that the newest snapshot holds, and what its marker says; (0, {}) without any."""
        done = [f for f in self.files.ls(f"{self.root}/snapshots") if f.name.endswith(".done")]
        return (int(done[-1].name[:-5]), self._read(done[-1].path)) if done else (0, {})

    def _read(self, path: str) -> dict:
        if path not in self._known:
            self._known[path] = json.loads(self.files.read(path))
        return self._known[path]

    def log(self) -> dict[int, dict]:
        """Commits after the newest snapshot, by number. Of a batch that two writers committed, the first counts."""
        upto, _ = self.snapshot()
        found = [f for f in self.files.ls(f"{self.root}/commits") if f.name.isdigit() and int(f.name) > upto]
        out, seen = {}, set()
        for f in found:
            said = self._read(f.path)
            if said["batch"] not in seen:
                out[int(f.name)] = said
                seen.add(said["batch"])
        return out

    def head(self) -> int:
        """Number of the last commit."""
        found = [f.name for f in self.files.ls(f"{self.root}/commits") if f.name.isdigit()]
        return max(self.snapshot()[0], int(found[-1]) if found else 0)

    def commit(self, batch_id: str, model: Model | None = None, feeds: list[Found] | None = None, after: int | None = None) -> bool:
        """Makes a batch visible. With after, only as the very next commit; False if another came between."""
        said = json.dumps({"batch": batch_id, "model": model.properties() if model else None, "feeds": [[f.name, f.size, f.time] for f in feeds or ()]})
        while True:
            at = (self.head() if after is None else after) + 1
            if self.files.create(f"{self.root}/commits/{at:012d}", said):
                return True
            if after is not None:
                return False

    def committed(self, batch_id: str) -> bool:
        if any(c["batch"] == batch_id for c in self.log().values()):
            return True
        upto, _ = self.snapshot()
        return bool(upto) and not self.spark.read.parquet(f"{self.root}/snapshots/{upto:012d}/batches").where(F.col("batch_id") == batch_id).isEmpty()

    def table(self, table: str) -> DataFrame:
        """Committed rows, with batch_id and commit."""
        upto, _ = self.snapshot()
        log = [(c["batch"], n) for n, c in self.log().items() if self.files.exists(f"{self.root}/{table}/batch_id={c['batch']}")]
        schema = T.StructType([*TABLES[table], *ADDED])
        out = self.spark.read.schema(schema).parquet(f"{self.root}/snapshots/{upto:012d}/{table}") if upto else None
        if log:
            at = f"{self.root}/{table}"
            rows = self.spark.read.schema(T.StructType([*TABLES[table], ADDED["batch_id"]])).option("basePath", at).json([f"{at}/batch_id={b}" for b, _ in log])
            rows = rows.join(F.broadcast(self.spark.createDataFrame(log, ADDED)), "batch_id").select(*schema.names)  # a row a commit since the snapshot
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def last_feeds(self) -> tuple[str, set[tuple]]:
        """The last batch that has read feeds, and their (name, size, time)."""
        told = [(c["batch"], c["feeds"]) for c in self.log().values() if c["feeds"]] or [self.snapshot()[1].get("feeds") or ("", [])]
        return told[-1][0], {tuple(f) for f in told[-1][1]}

    def model(self) -> Model:
        """The latest committed version; the initial one if there is none."""
        told = [c["model"] for c in self.log().values() if c["model"]] or [self.snapshot()[1].get("model")]
        return Model.parse(told[-1]) if told[-1] else Model()

    def compact(self) -> None:
        """Gathers all commits in a snapshot. Readers see it once its marker is written; a crash before leaves no trace
        that is read. Commits that come meanwhile stay outside."""
        (before, said), upto = self.snapshot(), self.head()
        log = {n: c for n, c in self.log().items() if n <= upto}
        if not log:
            return
        model = next((c["model"] for _, c in sorted(log.items(), reverse=True) if c["model"]), said.get("model"))
        feeds = next(((c["batch"], c["feeds"]) for _, c in sorted(log.items(), reverse=True) if c["feeds"]), said.get("feeds"))
        at = f"{self.root}/snapshots/{upto:012d}"
        for t in TABLES:
            self.table(t).where(F.col("commit") <= upto).write.mode("overwrite").parquet(f"{at}/{t}")
        batches = self.spark.createDataFrame([(c["batch"], n) for n, c in log.items()], ADDED)
        if before:
            batches = batches.unionByName(self.spark.read.parquet(f"{self.root}/snapshots/{before:012d}/batches"))
        batches.write.mode("overwrite").parquet(f"{at}/batches")
        self.files.create(f"{at}.done", json.dumps({"model": model, "feeds": feeds}))

    def vacuum(self) -> None:
        """Deletes what the newest snapshot has replaced; for a time without readers."""
        upto, _ = self.snapshot()
        for f in self.files.ls(f"{self.root}/commits"):
            if f.name.isdigit() and int(f.name) <= upto:
                batch = self._read(f.path)["batch"]
                for t in TABLES:
                    self.files.delete(f"{self.root}/{t}/batch_id={batch}")
                self.files.delete(f.path)
        for f in self.files.ls(f"{self.root}/snapshots"):
            if int(f.name.removesuffix(".done")) < upto:
                self.files.delete(f.path)

    def queue(self) -> DataFrame:
        """Items with status, decision and note: the latest decision of each id counts."""
        return latest(self.table("review_items"), self.table("review_decisions"))

    def reset(self) -> None:
        self.files.delete(self.root)
        self.__init__(self.spark, self.root)


def latest(items: DataFrame, decisions: DataFrame) -> DataFrame:
    last = decisions.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))).where("rn = 1").select("id", "decision", F.col("note").alias("reviewNote"))
    return items.join(last, "id", "left").withColumn("status", F.when(F.col("decision").isNull(), "PENDING").otherwise("REVIEWED"))


def json_lines(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """One JSON text a row, in the column value."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))


def json_array(lines: DataFrame) -> DataFrame:
    """The texts of the column value, by key, as one JSON array; for views, whose rows are few."""
    return lines.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda x: x["value"]), ","), F.lit("]")).alias("value"))


def json_string(text: Column, key: str) -> Column:
    """Field of a JSON object as text, with its escapes undone; null if it is missing."""
    return F.get_json_object(text, f"$.{key}")


def json_number(text: Column, key: str) -> Column:
    """Field of a JSON object as a number; 0 if it is missing or none."""
    return F.coalesce(F.get_json_object(text, f"$.{key}").try_cast("double"), F.lit(0.0))


def json_numbers(text: Column, key: str) -> Column:
    """A flat object of numbers below key, as a map; values that aren't numbers are left out."""
    given = F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>")
    return F.map_filter(F.transform_values(given, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def json_object(text: Column, key: str) -> Column:
    """The nested object below key, as text."""
    return F.get_json_object(text, f"$.{key}")
