"""Exports of posts and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text


def posts_csv(posts: DataFrame, path: str) -> None:
    """CSV with title and content joined as text; lists joined by commas."""
    flat = [F.array_join(F.col(f.name), ", ").alias(f.name) if f.dataType.simpleString().startswith("array") else F.col(f.name) for f in posts.schema if f.name not in ("title", "content")]
    posts.select(*flat, F.concat_ws(" ", "title", "content").alias("text")).write.mode("overwrite").csv(path, header=True)


def posts_json(posts: DataFrame, path: str) -> DataFrame:
    """JSON lines with content hints; returns the validation report, one row."""
    posts.withColumn("hints", text.hints(F.col("content"))).write.mode("overwrite").json(path)
    missing = F.col("title").isNull() | F.col("content").isNull()
    return posts.agg(F.count("*").alias("posts"), F.count(F.when(missing, 1)).alias("invalid"), F.count_distinct("source_id").alias("sources"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))


#: Columns of the export of sources, in order.
SOURCE_COLUMNS = ("id", "platform", "handle_or_url", "enabled", "post_count", "created_at", "updated_at")


def sources_csv(sources: DataFrame, path: str) -> DataFrame:
    """CSV of sources with their post counts; returns platform, sources, enabled, posts, and a row of all with platform null."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SOURCE_COLUMNS if c in sources.columns}
    rows = sources.select(*[blank.get(c, F.lit("")).alias(c) for c in SOURCE_COLUMNS])
    rows.write.mode("overwrite").csv(path, header=True)
    return platform_totals(sources)


def platform_totals(sources: DataFrame) -> DataFrame:
    """platform, sources, enabled, posts of each platform, and of all in a row without platform."""
    counts = sources.select(F.coalesce("platform", F.lit("unknown")).alias("platform"), F.coalesce("enabled", F.lit(False)).alias("on"), F.coalesce("post_count", F.lit(0)).alias("n"))
    return counts.rollup("platform").agg(F.count("*").alias("sources"), F.count(F.when(F.col("on"), 1)).alias("enabled"), F.sum("n").alias("posts"))
