"""Connected components of an edge table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``: the smallest id reachable, for every id in an edge.

    Each round takes the smallest label among neighbours and then the label's own label, so paths halve;
    it ends when no label changes. Labels are stored tables, nothing is gathered on the driver but a count.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        .select("id", F.least("id", "m").alias("component"), F.lit(True).alias("changed")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        labels = stored(
            step.join(jump, "c").select("id", F.least("c", "up").alias("component"), (F.least("c", "up") < F.col("old")).alias("changed")),
            "labels",
        )
        if labels.filter("changed").isEmpty():
            return labels.select("id", "component")
