"""Connected components of an edge table, by contracting every node to the end of its chain of least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stored, stored


def _ends(up: DataFrame) -> DataFrame:
    """node, root: where the chains of up (node, root) end; they only fall, so the sum of roots tells when all have."""
    total = lambda x: x.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    before = total(up)
    while True:
        further = stored(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "chain-ends")
        drop_stored(up)
        if (now := total(further)) == before:
            return further
        up, before = further, now


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node in edges (a long, b long).

    A round points each node to the least of itself and its neighbours (hubs are summed map-side), follows the pointers
    to their ends, and replaces nodes by these ends; edges inside an end are dropped, copies merged. Every node that has
    an edge left meets another, so the nodes at least halve each round, and a group that hangs on one hub is done after
    the first. Tables are stored between steps, which cuts the lineage; only counts and sums reach the driver.
    """
    names = None
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while names is None or e.limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "least-neighbours")
        ends = _ends(up)
        if names is None:
            names = ends
        else:
            older = names
            names = stored(older.join(ends.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("node", F.coalesce("end", "root").alias("root")), "component-names")
            drop_stored(older)
        left = ends.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = ends.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        older = e
        e = stored(e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_stored(older)
    drop_stored(e)
    return names
