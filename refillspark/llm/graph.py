"""Connected components by hooking and pointer jumping, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Shares into which the nodes under one root are dealt when they look up its own root.
_SHARES = 16


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (src, dst)``; root is the component's smallest node.

    Each round takes, for every node and for its root, the smallest root beyond an edge (combined
    before the shuffle) and then each root's root. Lookups of roots are dealt over shares, since a
    component may hold a large part of all nodes. Rounds grow with the logarithm of a path's
    length; each ends in a table in the shared folder. Edges with a null end, loops and repeats
    add nothing. No edges: no rows.
    """
    edges = edges.where("src <> dst")
    both = stored(edges.union(edges.select("dst", "src")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("root")), "labels")
    for _ in range(most_rounds):
        ends = both.join(labels.select(F.col("node").alias("src"), F.col("root").alias("of_src")), "src").join(
            labels.select(F.col("node").alias("dst"), F.col("root").alias("of_dst")), "dst"
        )
        hooks = ends.select(F.explode(F.array("src", "of_src")).alias("node"), F.col("of_dst").alias("root"))
        hooked = labels.union(hooks).groupBy("node").agg(F.min("root").alias("root"))
        hooked = stored(hooked, "hooked")
        roots = hooked.groupBy(F.col("root").alias("node")).agg(F.lit(1).alias("used")).join(hooked, "node")
        roots = roots.select(F.col("node").alias("root"), F.col("root").alias("next"), F.explode(F.lit(list(range(_SHARES)))).alias("share"))
        jumped = (
            hooked.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(_SHARES)).cast("int"))
            .join(roots, ["root", "share"])
            .select("node", F.col("next").alias("root"))
        )
        after = stored(jumped, "labels")
        moved = after.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
