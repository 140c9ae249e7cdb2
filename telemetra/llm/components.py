"""Connected components of a link table by alternating star contraction.

Each step is an aggregation and a join on node ids; the links are rewritten until
each node hangs on the least of its component.  Links are staged after each
step, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or, with the node, the smaller) neighbours of a node on the least one."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    moved = both.filter("v > u") if large else both
    out = moved.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    if not large:  # the node itself hangs on the least neighbour too
        out = out.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.filter("hi <> lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with links (x, y): component is the least node reached."""
    at = stage(
        links.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
        .filter("hi <> lo")
        .distinct(),
        "links",
    )
    sign = None
    while True:
        at = stage(_star(_star(at, True), False), "links")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % (1 << 40))).first()
        if now == sign:
            break
        sign = now
    nodes = at.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    tops = nodes.select(F.col("component").alias("node"), "component").distinct()
    return stage(nodes.unionByName(tops), "components")
