"""One batch from the landing folder to the registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property
from time import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.candidates import blocked, identifier_pairs, prepared
from linkforge.operators.model import Model
from linkforge.operators.registry import clustered, registry_rows, review_items
from linkforge.operators.scoring import scores, with_records
from linkforge.scratch import Scratch
from linkforge.sources import landing
from linkforge.sources.store import Store

#: States of a batch in their order.
STATES = ("IDLE", "DETECTING", "INGESTING", "MATCHING", "WRITING", "COMPLETE")
WAITING = "Waiting for a batch"
#: Commits after the newest snapshot from which on a batch gathers them in a new one.
COMPACT_FROM = 500


@dataclass
class Status:
    """What the status view shows, and (time in ms, state, step) of every change."""

    state: str = "IDLE"
    step: str = WAITING
    batch_id: str = ""
    updated: int = 0
    stats: dict[str, int] = field(default_factory=dict)
    log: list[tuple[int, str, str]] = field(default_factory=list)

    def to(self, state: str, step: str) -> None:
        self.state, self.step, self.updated = state, step, int(time() * 1000)
        self.log.append((self.updated, state, step))


@dataclass
class Linked:
    """Results of linking, as tables; pairs are without their records."""

    recs: DataFrame
    pairs: DataFrame
    model: Model
    scratch: Scratch

    @cached_property
    def comps(self) -> DataFrame:
        return self.scratch.keep(clustered(self.recs, self.pairs, self.model, self.scratch), "components")

    def reviews(self) -> DataFrame:
        """The pairs in REVIEW, with their records."""
        return with_records(self.recs, self.pairs.where("zone = 'REVIEW'"))


def only_identifiers_link(model: Model) -> bool:
    """Whether no pair without an equal identifier can reach the automatic threshold."""
    return sum(v for k, v in model.weights.items() if k != "pan") < model.auto_link - 1e-9


def link(records: DataFrame, model: Model, scratch: Scratch, reviews: bool = True) -> Linked:
    """Scores candidates and clusters automatic links; pairs are kept in AUTO_LINK and REVIEW alone.

    Without reviews, for whoever needs clusters alone, only pairs in AUTO_LINK are looked for: mostly those with an
    equal identifier, which need no blocking.
    """
    recs = scratch.keep(prepared(records), "records")
    pairs = scratch.keep(blocked(recs, model) if reviews or not only_identifiers_link(model) else identifier_pairs(recs), "candidates")
    found = scores(recs, pairs, model).where("zone <> 'SEPARATE'" if reviews else "zone = 'AUTO_LINK'")
    return Linked(recs, scratch.keep(found, "pairs"), model, scratch)


def cross_pairs(records: DataFrame) -> int:
    """How many pairs all sources make: half of the square of the sum less the sum of squares."""
    row = records.groupBy("source").agg(F.count("*").alias("n")).agg(F.sum("n").alias("a"), F.sum(F.col("n") * F.col("n")).alias("b")).first()
    return ((row["a"] or 0) ** 2 - (row["b"] or 0)) // 2


def run_batch(store: Store, status: Status | None = None, batch_id: str | None = None, folder: str | None = None) -> Status:
    """Links the batch in the landing folder, if it is ready.

    A batch's id follows from its files, so a try after a crash writes the same rows in their place. What a crash left
    behind after the commit, before or amid the archive, is put away first: the commit names the files it has read.
    """
    status = status or Status()
    folder, files = folder or f"{store.root}/landing", store.files
    last, read = store.last_feeds()
    for f in files.ls(folder):
        if f[1:] in read:
            files.move(f.path, f"{store.root}/archive/{last}")
    if not landing.ready(files, folder):
        return status
    found = landing.manifest(files, folder)
    marker = [f for f in files.ls(folder) if f.name == landing.MARKER]
    status.batch_id = batch_id or landing.batch_id(found)
    status.to("DETECTING", "Batch found")
    status.to("INGESTING", f"Reading {len(found)} feeds")
    scratch = Scratch(store.spark, "batch")
    try:
        records = scratch.keep(landing.read_feeds(store.spark, [f.path for f in found]), "feeds")
        status.to("MATCHING", "Comparing records across sources")
        out = link(records, store.model(), scratch)
        now = datetime.now(UTC).isoformat()
        status.to("WRITING", "Writing registry and review queue")
        if not store.committed(status.batch_id):
            store.put("registry", status.batch_id, registry_rows(out.recs, out.comps, out.pairs, status.batch_id, now))
            store.put("review_items", status.batch_id, review_items(out.reviews(), status.batch_id, now))
            store.commit(status.batch_id, feeds=found + marker)
        linked = out.comps.groupBy("comp").count().where("count > 1").agg(F.sum("count")).first()[0] or 0
        status.stats = {"totalRecords": records.count(), "pairsChecked": cross_pairs(records), "autoLinked": linked, "pendingReview": store.queue().where("status = 'PENDING'").count(), "registrySize": store.table("registry").count()}
        landing.archive(files, folder, found, f"{store.root}/archive/{status.batch_id}")
        if len(store.log()) >= COMPACT_FROM:
            store.compact()
        status.to("COMPLETE", f"Batch {status.batch_id} complete")
        status.to("IDLE", WAITING)
    except Exception:
        status.to("IDLE", "Failed; the batch stays in the landing folder")
        raise
    finally:
        scratch.close()
    return status
