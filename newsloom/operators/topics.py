"""Topics: similarity of their vectors, storage from assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text


def similar(topics: DataFrame, probes: DataFrame, threshold: float = 0.75, limit: int = 10) -> DataFrame:
    """(probe, id, similarity) of the topics nearest to each probe. Both have id and vector.

    The probes are a stated query set held against all topics: a nested-loop join, for which Spark sends the smaller side to
    every task if it is small by its own measure.
    """
    left = probes.select(F.col("id").alias("probe"), F.col("vector").alias("__p"))
    rows = left.join(topics.select("id", "vector"), F.col("probe") != F.col("id")).withColumn("similarity", F.round(text.cosine(F.col("__p"), F.col("vector")), 6)).where(F.col("similarity") >= threshold)
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("similarity").desc(), "id"))
    return rows.select("probe", "id", "similarity").withColumn("rank", rank).where(F.col("rank") <= limit)


def store(assignments: DataFrame, posts: DataFrame) -> DataFrame:
    """(topic, title, is_outlier, post_ids, post_count) from assignments (post_id, topic, title); -1 is the outlier topic, unknown posts go."""
    known = assignments.join(posts.select("post_id"), "post_id", "left_semi")
    outlier = F.col("topic") == -1
    named = known.withColumn("title", F.when(outlier, "Outliers").otherwise(F.col("title")))
    return named.groupBy("topic").agg(F.max("title").alias("title"), F.array_sort(F.collect_set("post_id")).alias("post_ids")).select("topic", "title", (F.col("topic") == -1).alias("is_outlier"), "post_ids", F.size("post_ids").alias("post_count"))
