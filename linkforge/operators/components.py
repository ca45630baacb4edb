"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.scratch import Scratch, shuffled


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): the smallest vertex c reachable from each vertex v of the undirected edges (a, b).

    Every round sends each vertex to its smallest neighbour and contracts; a star takes one round, a path about
    log(n). All state is in written tables; the driver sees only whether edges are left. No edges: an empty table.
    """
    live = scratch.keep(edges.where("a <> b").distinct(), "edges")
    levels = []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "level")
        levels.append(to)
        ta, tb = (to.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        nxt = live.join(shuffled(ta), "a").join(shuffled(tb), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).where("a <> b").distinct()
        nxt = scratch.keep(nxt, "edges")
        scratch.drop(live)
        live = nxt
    if not levels:
        return live.select(F.col("a").alias("v"), F.col("b").alias("c"))
    out = levels[-1]
    for level in reversed(levels[:-1]):  # a vertex's label in a level is a vertex of the next one, or final
        up = out.select(F.col("v").alias("c"), F.col("c").alias("up"))
        out = scratch.keep(level.join(shuffled(up), "c", "left").select("v", F.coalesce("up", "c").alias("c")), "labels")
    return out
