"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import staged


def _roots(parent: DataFrame) -> DataFrame:
    """Follow parents to the top by pointer doubling: (node, root)."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = staged(
            parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            "roots",
        )
        parent = new.select("node", "root")
        if new.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node.

    ``links`` holds ``a`` and ``b``; returns ``node`` and ``root`` for every
    node that is not the smallest of its component. Each round lets every node
    hook to its smallest neighbour below and contracts the trees, so rounds
    grow with the logarithm of the size of a component; all state is in tables.
    """
    pair = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    links = staged(links.select(*pair).where("hi != lo").distinct(), "links")
    found = None
    while not links.isEmpty():
        tops = _roots(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        if found is None:
            found = tops
        else:
            moved = tops.select(F.col("node").alias("root"), F.col("root").alias("above"))
            old = found.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = staged(old.unionByName(tops), "found")
        hi = tops.select(F.col("node").alias("hi"), F.col("root").alias("a"))
        lo = tops.select(F.col("node").alias("lo"), F.col("root").alias("b"))
        links = links.join(hi, "hi").join(lo, "lo", "left").select("a", F.coalesce("b", "lo").alias("b"))
        links = staged(links.select(*pair).where("hi != lo").distinct(), "links")
    if found is None:
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found
