"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import shared_dir


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """node, root (least node of its component) for all ends of ``edges`` (u, v).

    Every round maps a node to its least neighbour, shortens those pointers by
    joining them with themselves, and contracts the edges; a star or a clique
    goes in one round. Each round is cut by a checkpoint in the shared folder.
    Defined cases: self-loops and repeated edges change nothing, edges with a
    null end are ignored, no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    left = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.col("u").cast("long"), F.col("v").cast("long")).distinct().checkpoint()
    labels = None
    while True:
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")).checkpoint()
        for _ in range(jumps):
            # only roots that point further move their nodes; a star has none, so its nodes need not meet in one task
            roots = least.select("root").distinct()
            further = roots.join(least.select("node", F.col("root").alias("root2")), F.col("root") == F.col("node")).filter("root2 != root").select("root", "root2").checkpoint()
            if further.isEmpty():
                break
            least = least.join(further, "root", "left").select("node", F.coalesce("root2", "root").alias("root")).checkpoint()
        if labels is None:
            labels = least
        else:
            step = least.filter("node != root").select(F.col("node").alias("root"), F.col("root").alias("root2"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("root2", "root").alias("root")).checkpoint()
        a = least.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = least.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = left.join(a, "u").join(b, "v").filter("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct().checkpoint()
        if left.isEmpty():
            return labels
