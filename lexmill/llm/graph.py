"""Connected components of a graph of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Most bytes of roots that are sent to every executor in a round; the driver holds each round's for a while.
SENT_BYTES = 4 << 20


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b): a written table.

    Each round a node takes the least root of its neighbours and its own, then its root's root; every round is written to the
    shared folder and the one before removed. A node's own row and its neighbours' are combined in the tasks before the one
    shuffle by node, so a node of very many links is no hot group. Roots only ever fall, and the rounds end when none does,
    whatever the length of a chain.
    """
    both = common.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    roots = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        known = common.sent_if_small(roots, SENT_BYTES)
        near = both.join(known.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), F.lit(None).cast(roots.schema["root"].dataType).alias("old"), "root")
        new = roots.select("node", F.col("root").alias("old"), "root").union(near).groupBy("node").agg(F.max("old").alias("old"), F.min("root").alias("root"))
        up = known.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = common.written(new.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        common.discard(roots)
        roots = new
        if not new.where("root <> old").limit(1).count():
            common.discard(both)
            return roots


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """roots (node, root; None before the first links) with more links (a, b), a written table: only the components that the
    links meet are worked through, each as one node, and roots is replaced."""
    if not links.limit(1).count():
        return roots
    if roots is None:
        return components(links)
    known = common.sent_if_small(roots.select("node", "root"), SENT_BYTES)
    ends = links
    for c in ("a", "b"):
        ends = ends.join(known.toDF(c, "_root"), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    merged = components(ends.where("a <> b"))
    to = common.sent_if_small(merged.select(F.col("node").alias("root"), F.col("root").alias("_root")), SENT_BYTES)
    moved = roots.select("node", "root").join(to, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    out = common.written(moved.union(merged.select("node", "root").join(known.select("node"), "node", "left_anti")), "roots")
    common.discard(roots, merged)
    return out
