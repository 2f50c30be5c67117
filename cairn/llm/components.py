"""Connected components of a link table, by hooking and contraction.

Every round, each node points at its smallest neighbour if that is smaller than itself; pointers are
followed to their ends; links are rewritten between the ends, and those inside one group go. Rounds
are few (each at least halves the nodes of what is left that aren't local minima), every step is a
join or an aggregate with partial sums, and each round ends in a table in the shared folder. Rounds' pointers
are put together at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.frames import materialise


def _ends(pointers: DataFrame) -> DataFrame:
    """Follow ``(node, to)`` pointers, which go downwards, until they end."""
    while True:
        far = pointers.select(F.col("node").alias("__n"), F.col("to").alias("__far"))
        step = pointers.join(far, pointers["to"] == far["__n"], "left").select("node", F.coalesce("__far", "to").alias("to"), F.col("__far").isNotNull().alias("moved"))
        step = materialise(step, "pointers")
        pointers = step.select("node", "to")
        if step.filter("moved").isEmpty():
            return pointers


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns ``a`` and ``b``): root is the smallest
    node of its component. Links may repeat and may join a node to itself; null ends are ignored.
    A node that only links to itself is its own root. No links give no rows.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    nodes, rounds = None, []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "nearest")
        nodes = nearest if nodes is None else nodes
        hooks = nearest.filter("to < node")
        if hooks.isEmpty():
            break
        ends = _ends(hooks)
        rounds.append(at := ends.select(F.col("node").alias("__n"), F.col("to").alias("__to")))
        for end in ("a", "b"):
            links = links.join(at, F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("__to", end)).select("a", "b")
        links = materialise(links.filter("a != b"), "links")
        if links.isEmpty():
            break
    found = nodes.select("node", F.col("node").alias("root"))
    for at in rounds:
        found = found.join(at, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__to", "root").alias("root"))
    return found
