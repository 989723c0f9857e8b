"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import dropped, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links``.

    Each round gives every node the smallest label among its own, its
    neighbours' and that of the node its label names (which halves the paths);
    rounds end when no label changes. Labels are summed with map-side
    combining and written to the shared folder, so no node's neighbours are ever
    gathered in one task, and the driver sees one count a round.
    """
    both = saved(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).filter("x <> y").distinct(), "links")
    labels = saved(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        step = saved(step.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("further", "new")).alias("component")), "labels")
        dropped(labels)
        done = not step.filter("old <> component").limit(1).count()
        labels = step.drop("old")
        labels._saved_at = step._saved_at
        if done:
            dropped(both)
            return labels
