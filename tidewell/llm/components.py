"""Connected components of a link table, by hooking and shortcutting of parent pointers.

Every node points to a parent with a smaller or equal label. In each round a node's parent, and the node itself, hook
onto the smallest grandparent among the node's neighbours, and every node moves on to its grandparent. Rounds grow
with the logarithm of a component's longest path. Each round is a few equi-joins and map-side combined minima over
the links; its pointers are written once to the shared folder, so no plan grows and a lost executor costs one round at
most, and the pointers of the round before are deleted. A hub's links meet it in a sort-merge join whose skewed
partitions Spark splits. Nothing but whether a round moved a pointer goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (``a, b``): the smallest node that can be reached."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.filter("a != b").distinct(), "edges")
    parents = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "parents")
    while True:
        up = parents.select(F.col("node").alias("p"), F.col("root").alias("grand"))
        grand = parents.select("node", "root").join(up, F.col("root") == F.col("p")).select("node", "root", "grand")
        near = edges.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("least"))
        seen = grand.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("grand", "least").alias("least"))
        hooks = seen.select("node", "least", F.col("root").alias("old")).union(seen.select(F.col("root").alias("node"), "least", F.lit(None).cast(seen.schema["root"].dataType)))
        after = materialise(hooks.groupBy("node").agg(F.min("least").alias("root"), F.max("old").alias("old")), "parents")
        still = after.filter("root != old").isEmpty()
        discard(parents)
        parents = after
        if still:
            discard(edges)
            return parents.select("node", "root")
