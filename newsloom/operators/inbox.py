"""Ranking of stories and posts for an analyst, with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STORY_HOURS, POST_HOURS, STORY_LEAST, POST_LEAST = 72, 168, 30.0, 25.0


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def novelty(hours: Column, window: int) -> Column:
    return F.coalesce(clamp(1 - hours / window), F.lit(0.5))


def source_score(priority: Column) -> Column:
    return clamp(1 - (F.greatest(priority, F.lit(1)) - 1) / 999)


def score_stories(stories: DataFrame) -> DataFrame:
    """stories (hours, posts, updates, importance, anchor, priority, signals) with their scores; those of 30 and more."""
    capped = lambda c, n: F.least(F.col(c) / n, F.lit(1.0))
    fresh, source = novelty(F.col("hours"), STORY_HOURS), source_score(F.col("priority"))
    material = 0.40 * capped("posts", 4) + 0.35 * capped("updates", 3) + 0.25 * F.greatest("importance", "anchor")
    evidence = 0.45 * capped("posts", 5) + 0.25 * capped("updates", 4) + 0.30 * F.col("anchor")
    bonus = F.least(0.25 * (F.col("signals") - 1), F.lit(0.35))
    total = F.round(F.least(F.greatest(100 * (0.32 * fresh + 0.38 * material + 0.20 * evidence + 0.10 * source + bonus), F.lit(0.0)), F.lit(100.0)), 2)
    return stories.where("signals > 0").withColumns({"novelty": F.round(fresh, 4), "score": total}).where(F.col("score") >= STORY_LEAST)


def score_posts(posts: DataFrame) -> DataFrame:
    """posts (hours, artifacts, relations, duplicates, linked, language_confidence, priority) with their scores; those of 25 and more."""
    sure = F.when(F.coalesce("language_confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("language_confidence"))
    evidence = 0.30 + 0.30 * F.least(F.col("artifacts") / 3, F.lit(1.0)) + 0.20 * F.least(F.col("relations") / 5, F.lit(1.0)) + 0.20 * sure
    fresh = novelty(F.col("hours"), POST_HOURS)
    total = 100 * (0.50 * fresh + 0.28 * evidence + 0.22 * source_score(F.col("priority")) - 0.55 * F.col("duplicates").cast("int") - 0.20 * F.col("linked").cast("int"))
    return posts.withColumns({"novelty": F.round(fresh, 4), "score": F.round(F.greatest(total, F.lit(0.0)), 2)}).where(F.col("score") >= POST_LEAST)


def rebuild(stories: DataFrame, posts: DataFrame, limit: int = 100) -> DataFrame:
    """position, target_type, target_id, score, novelty of the best `limit` items: a report of fixed length."""
    one = score_stories(stories).select(F.lit("story").alias("target_type"), F.col("id").alias("target_id"), "score", "novelty")
    two = score_posts(posts).select(F.lit("post").alias("target_type"), F.col("id").alias("target_id"), "score", "novelty")
    keys = (F.col("score").desc(), F.col("novelty").desc(), F.when(F.col("target_type") == "story", 0).otherwise(1), "target_id")
    top = one.unionByName(two).orderBy(*keys).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*keys)))
