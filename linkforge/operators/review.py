"""Reviewer decisions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from linkforge.operators.registry import reviewed_rows
from linkforge.schemas import DECISION
from linkforge.sources.store import Store

DECISIONS = ("MATCH", "NO_MATCH")


def submit(store: Store, id_: str, decision: str, note: str | None = None) -> bool:
    """Applies a decision once: registry rows, the model's next version, and the decision, in one commit.

    False if the item was decided before (nothing changes then). Unknown ids and decisions raise ValueError. A note is
    data, whatever it holds. A crash at any place leaves nothing that is read, and the decision can be sent again.
    Weights follow the commits: if another came between, the decision is learned anew on top of it.
    """
    verdict = (decision or "").strip().upper()
    if not id_ or verdict not in DECISIONS:
        raise ValueError("an id and a decision, MATCH or NO_MATCH, are needed")
    item = store.table("review_items").where(F.col("id") == id_).limit(1)
    if (row := item.first()) is None:
        raise ValueError(f"no review item {id_}")
    batch, match = f"review-{id_}", verdict == "MATCH"
    while True:
        after = store.head()
        if store.committed(batch):
            return False
        model, now = store.model().learned(row["features"].asDict(), match), datetime.now(UTC)
        store.put("registry", batch, reviewed_rows(item.withColumn("match", F.lit(match)), now.isoformat()))
        store.put("review_decisions", batch, store.spark.createDataFrame([(id_, verdict, note, int(now.timestamp() * 1e6))], DECISION))
        if store.commit(batch, model, after=after):
            return True
