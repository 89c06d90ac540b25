"""Rule-based briefings as columns of Markdown: daily, by source, weekly, and the profile and tracks of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from . import ranking


def daily(posts: DataFrame, day: str = "day") -> DataFrame:
    """day, content: a Markdown briefing of each day. posts: post_id, source_id, title, content, published_at, day."""
    keys = posts.select(day, "source_id", "published_at", "post_id")
    first = ranking.top(keys, [day], [F.col("published_at").desc(), F.col("post_id").desc()], 5, "rn").select("post_id", "rn")
    ranked = posts.join(first, "post_id").select(day, "source_id", "rn", text.brief(F.col("title"), F.col("content")).alias("brief"), text.topic(F.col("title"), F.col("content")).alias("topic"))
    by_source = keys.groupBy(day, "source_id").agg(F.max(F.struct("published_at", "post_id")).alias("newest"), F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy(day).orderBy(F.col("newest").desc()))
    names = by_source.withColumn("place", order).groupBy(day).agg(F.sum("n").alias("n"), F.count("*").alias("sources"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "source_id")))).alias("top"))
    lines = ranked.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("rn", "source_id", "brief", "topic"))).alias("top_posts"))
    both = names.join(lines, day)
    executive = F.concat(
        F.format_string("- %d posts collected across %d sources: ", "n", "sources"),
        F.array_join(F.transform("top", lambda t: t["source_id"]), ", "),
        F.lit(". Most recent activity came from "),
        F.get("top_posts", F.lit(0))["source_id"],
        F.lit("."),
    )
    developments = F.array_join(F.transform("top_posts", lambda p: F.concat(F.lit("- "), p["source_id"], F.lit(": "), p["brief"])), "\n")
    signals = F.array_join(F.transform(F.slice("top_posts", 1, 3), lambda p: F.concat(F.lit("- Watch for follow-up from "), p["source_id"], F.lit(" on "), p["topic"], F.lit("."))), "\n")
    content = F.concat(F.lit("## Executive Summary\n"), executive, F.lit("\n\n## Main Developments\n"), developments, F.lit("\n\n## Signals To Watch\n"), signals)
    return both.select(day, content.alias("content"))


def by_source(posts: DataFrame, day: str = "day") -> DataFrame:
    """day, source_id, title, summary, post_count: a topic per source and day, summarised by its first three posts."""
    place = F.row_number().over(Window.partitionBy(day, "source_id").orderBy("post_id"))
    ranked = posts.select(day, "source_id", "post_id", place.alias("rn"), text.brief(F.col("title"), F.col("content")).alias("brief"))
    out = ranked.groupBy(day, "source_id").agg(F.count("*").alias("post_count"), F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "brief")))).alias("top"))
    return out.select(day, "source_id", F.concat(F.lit("Updates from "), "source_id").alias("title"), F.array_join(F.transform("top", lambda t: t["brief"]), " ").alias("summary"), "post_count")


def weekly(topics: DataFrame) -> DataFrame:
    """week, title, days, posts of topics (day, title, post_count), merged by title within Monday to Sunday."""
    week = F.to_date(F.date_trunc("week", F.col("day")))
    return topics.groupBy(week.alias("week"), "title").agg(F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ", ").alias("days"), F.sum("post_count").alias("posts"))


def profile(posts: DataFrame, columns: tuple[str, ...] = ("lang",), most: int = 6) -> DataFrame:
    """source_id, field, value, n, rank: the most common values of each source, ties by first post."""
    each = posts.select("source_id", "post_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("source_id", "post_id", "e.*")
    counted = each.where("value IS NOT NULL").groupBy("source_id", "field", "value").agg(F.count("*").alias("n"), F.min("post_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("source_id", "field").orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).drop("first")


def tracks(posts: DataFrame, most: int = 5) -> DataFrame:
    """source_id, track, posts, distinct_posts: a source's posts by topic key, the largest `most` by name and the rest together.

    posts: source_id, post_id, title, cluster (copies share it).
    """
    keyed = posts.withColumn("key", F.lower(text.topic_key(F.col("title"))))
    counted = keyed.groupBy("source_id", "key").agg(F.count_distinct("cluster").alias("distinct_posts"), F.count("*").alias("posts"), F.min("post_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("distinct_posts").desc(), F.col("posts").desc(), "first"))
    named = counted.withColumn("track", F.when((rank > most) | (F.col("key") == ""), "Other Updates").otherwise(F.col("key")))
    return named.groupBy("source_id", "track").agg(F.sum("posts").alias("posts"), F.sum("distinct_posts").alias("distinct_posts"))
