"""Detail views: settings, posts with their topics, artifact references, video groups, watch progress, briefing coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text

#: Settings of a source by platform, which its own settings override.
DEFAULTS = {
    "rss": {"fetch_delay_seconds": "1", "priority": "999", "max_posts_per_fetch": "20"},
    "reddit": {"fetch_delay_seconds": "2", "priority": "999", "max_posts_per_fetch": "25"},
    "youtube": {"fetch_delay_seconds": "2", "priority": "999", "max_posts_per_fetch": "5"},
    "telegram": {"fetch_delay_seconds": "2", "priority": "999", "max_posts_per_fetch": "20"},
}


def overlay(base: Column, own: Column) -> Column:
    """Two maps as one; a key of `own` that isn't null wins."""
    given = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(kept, given)


def source_settings(sources: DataFrame) -> DataFrame:
    """source_id, settings: the platform's defaults under the source's own settings (a map)."""
    base = F.create_map(*[F.lit(x) for kv in DEFAULTS["rss"].items() for x in kv])
    for platform, values in DEFAULTS.items():
        base = F.when(F.col("platform") == platform, F.create_map(*[F.lit(x) for kv in values.items() for x in kv])).otherwise(base)
    return sources.select("source_id", overlay(base, F.col("settings")).alias("settings"))


def post_detail(posts: DataFrame, topic_posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts with topics_json: their topics in the order of titles, an empty list for none."""
    one = F.struct("title", "topic_id", "is_outlier")
    held = topic_posts.join(topics, "topic_id").groupBy("post_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("topics_json"))
    return posts.join(held, "post_id", "left").withColumn("topics_json", F.coalesce("topics_json", F.lit("[]")))


def artifact_references(members: DataFrame, highlights: DataFrame) -> DataFrame:
    """members (artifact_id, post_id, position), each post once, the first as primary, with its most important highlight."""
    first = members.groupBy("artifact_id", "post_id").agg(F.min("position").alias("position"))
    best = highlights.groupBy("post_id").agg(F.max_by("text", F.struct(F.col("importance"), -F.col("position"))).alias("highlight"))
    place = F.row_number().over(Window.partitionBy("artifact_id").orderBy("position", "post_id"))
    ranked = first.withColumn("place", place).join(best, "post_id", "left")
    return ranked.select("artifact_id", "post_id", "place", F.when(F.col("place") == 1, "primary").otherwise("supporting").alias("role"), "highlight")


def video_groups(videos: DataFrame, collapse_singletons: bool = True) -> DataFrame:
    """channel, title, kind, videos, first_published: videos (channel, video_id, title, published_at) by topic key, by first date."""
    keyed = videos.withColumn("key", text.topic_key(F.col("title")))
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("channel", "key")))
    name = F.when((F.col("n") > 1) | (not collapse_singletons), F.col("key")).otherwise(F.col("title"))
    grouped = sized.groupBy("channel", name.alias("title")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("published_at", "video_id"))), lambda v: v["video_id"]).alias("videos"), F.min("published_at").alias("first_published")
    )
    kind = F.when(F.size("videos") > 1, "topic_cluster").otherwise("single")
    return grouped.select("channel", "title", kind.alias("kind"), "videos", "first_published").orderBy("channel", "first_published", "title")


def watch_progress(progress: Column, duration: Column) -> Column:
    """struct<percent, completed>."""
    share = F.when(duration > 0, F.least(100 * progress / duration, F.lit(100.0))).otherwise(0.0)
    return F.struct(F.round(share, 2).cast("decimal(5,2)").alias("percent"), ((duration > 0) & (progress >= duration)).alias("completed"))


def backfill(posts: DataFrame, tracked: DataFrame, other: str = "Other Updates") -> DataFrame:
    """tracked (track, post_id) of known posts, and all posts that no track has, in `other`: every post is covered once or more."""
    known = tracked.join(posts.select("post_id"), "post_id", "left_semi").select("track", "post_id").distinct()
    return known.unionByName(posts.join(known, "post_id", "left_anti").select(F.lit(other).alias("track"), "post_id"))


def briefing_range(stats: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """source_id, start_day, end_day: the asked range, or else that of the source's posts (first_day, last_day)."""
    ask = lambda v, c: F.to_date(F.lit(v)) if v else F.col(c)
    low, high = ask(start, "first_day"), ask(end, "last_day")
    return stats.select("source_id", F.least(low, high).alias("start_day"), F.greatest(low, high).alias("end_day"))
