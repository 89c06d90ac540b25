"""Connected components of edge tables by rounds of least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import checkpoints


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the least id that each reaches.

    Each round takes the least label of all neighbours and then the label of that label, so paths halve. A hub's neighbours
    are combined before the shuffle. Lineage is cut by checkpoint(), whose folder the session names.
    """
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    before = None
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, "a").select("a", F.least("label", "near").alias("label"))
        jump = lower.select(F.col("a").alias("label"), F.col("label").alias("beyond"))
        labels = lower.join(jump, "label", "left").select("a", F.coalesce("beyond", "label").alias("label")).checkpoint()
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError("components did not settle")
    return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
