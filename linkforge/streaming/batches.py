"""Batches as a stream: each has its own folder, and its marker file starts it."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkforge.plans.batch import run_batch
from linkforge.sources import landing
from linkforge.sources.store import Store


def start(store: Store, checkpoint: str, once: bool = True, every: str = "3 seconds") -> StreamingQuery:
    """Runs a batch for every new landing/batch=<id>/ with a marker.

    The file source remembers markers by path, so a batch starts once; its id is its folder's, so a retry after a failure
    rewrites the same rows. Spark's file sources pass over empty files, so a marker needs a byte here. The marker comes
    last: one that is found before two feeds are there fails the query, whose next start tries that batch again, so
    no batch is lost. A folder whose batch is committed is passed over.
    """

    def process(markers, epoch: int) -> None:
        early = []
        for row in markers.select("path").distinct().orderBy("path").collect():  # a path a batch
            folder = unquote(row["path"]).rpartition("/")[0]
            batch = folder.rpartition("/")[2].removeprefix("batch=")
            if landing.ready(store.files, folder):
                run_batch(store, batch_id=batch, folder=folder)
            elif not store.committed(batch):
                early.append(batch)
        if early:
            raise FileNotFoundError(f"batches with a marker, but without two feeds: {', '.join(early)}")

    found = store.spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", landing.MARKER).option("recursiveFileLookup", True).load(f"{store.root}/landing")
    writer = found.select(F.col("_metadata.file_path").alias("path")).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
