"""Vertical briefings of a source: shared context of its posts, tracks by signature, coverage of every post.

Posts are grouped by `scope` (a source and range); all lists are of bounded length, and no group is gathered whole: ranks come
from counts, and a track's posts are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words that a signature leaves out in front, and words that end one.
LEADS = (
    "a an analysis another briefing daily day follow followup follow-up latest log memo more new note notes post progress recap report roundup summary thread "
    "today update updates weekly yesterday"
).split()
SUFFIXES = "analysis commentary day draft entry followup follow-up log memo note notes post progress project recap report roundup summary thread today update updates version".split()
SMALL = "and or the a an to of for in on with from".split()
#: Words of a title that make a project of a track.
PROJECT = "agent agents autoresearch build coding experiment framework launch model pipeline project research system tool workflow".split()
OTHER = "Other Updates"


def signature(text: Column) -> Column:
    """What a text without further context is about: one or two of its first words, or 'general'."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9'-]+)"), 1), lambda w: ~w.isin(*SMALL))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    out = (
        F.when(first.isin(*LEADS) & second.isNotNull(), F.array_join(F.slice(words, 2, 2), " "))
        .when(second.isin(*SUFFIXES) | second.rlike(r"^v?\d+(\.\d+)?$"), first)
        .otherwise(F.array_join(F.slice(words, 1, 2), " "))
    )
    return F.when(F.size(words) == 0, "general").otherwise(out)


def shared(links: DataFrame, most: int = 5, shared_most: int = 4) -> DataFrame:
    """links (scope, post_id, field, key, display) as scope, post_id, field, names, shared_names.

    A key counts once a post. names: those on most posts first, then by name; shared_names: those that another post has too,
    by the display that the first post has.
    """
    once = links.where("key <> ''").groupBy("scope", "post_id", "field", "key").agg(F.min("display").alias("display"))
    counts = once.groupBy("scope", "field", "key").agg(F.count("*").alias("df"), F.min_by("display", F.struct("post_id", "display")).alias("first_display"))
    ranked = once.join(counts, ["scope", "field", "key"]).withColumn("rank", F.row_number().over(Window.partitionBy("scope", "post_id", "field").orderBy(F.col("df").desc(), F.lower("display"), "key")))
    again = F.when(F.col("df") > 1, F.struct("rank", "first_display"))
    out = ranked.groupBy("scope", "post_id", "field").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "display")))).alias("n"), F.array_sort(F.collect_list(again)).alias("s"))
    return out.select("scope", "post_id", "field", F.transform("n", lambda x: x["display"]).alias("names"), F.slice(F.transform("s", lambda x: x["first_display"]), 1, shared_most).alias("shared_names"))


def context(posts: DataFrame, links: DataFrame, stories: DataFrame) -> DataFrame:
    """posts (scope, post_id, title, content) with track_hint, story_title, entity_names.

    links: (scope, post_id, field, key, display) of the fields event, entity and category; stories: (post_id, story_title), the best
    one a post. The hint is the story, or else two shared events, entities or categories, or two of the post's own, or its title.
    """
    empty = F.array().cast("array<string>")
    found = shared(links).groupBy("scope", "post_id").pivot("field", ["event", "entity", "category"]).agg(F.first("names").alias("names"), F.first("shared_names").alias("shared"))
    rows = posts.join(found, ["scope", "post_id"], "left").join(stories.groupBy("post_id").agg(F.min("story_title").alias("story_title")), "post_id", "left")
    two = lambda c: F.nullif(F.array_join(F.slice(F.coalesce(c, empty), 1, 2), " / "), F.lit(""))
    parts = [two(F.col(f"{f}_{kind}")) for kind in ("shared", "names") for f in ("event", "entity", "category")]
    words = F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda w: w != "")
    fallback = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.array_join(F.slice(words, 1, 8), " "), F.lit("")), F.lit("recent update"))
    hint = F.coalesce(F.nullif("story_title", F.lit("")), *parts, fallback)
    return rows.select(*posts.columns, "story_title", F.coalesce("entity_names", empty).alias("entity_names"), hint.alias("track_hint"))


def tracks(posts: DataFrame, most: int = 5) -> DataFrame:
    """scope, track, title, kind, posts, clusters, first_post, last_at of posts (scope, post_id, at, cluster, signature, story_title).

    Copies of one cluster stand together under the signature of the first. The tracks of most clusters, then of most posts, then
    the earliest, have a name; the rest are other updates.
    """
    head = posts.groupBy("scope", "cluster").agg(F.min_by(F.struct("signature", "story_title"), F.struct("at", "post_id")).alias("h"), F.count("*").alias("posts"), F.min(F.struct("at", "post_id")).alias("first"), F.max("at").alias("last_at"))
    heads = head.select("scope", "cluster", F.coalesce(F.nullif("h.story_title", F.lit("")), "h.signature").alias("signature"), (F.col("h.story_title") != "").alias("story"), "posts", "first", "last_at")
    found = heads.groupBy("scope", "signature").agg(F.count("*").alias("clusters"), F.sum("posts").alias("posts"), F.min("first").alias("first"), F.max("last_at").alias("last_at"), F.coalesce(F.bool_or("story"), F.lit(False)).alias("story"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("clusters").desc(), F.col("posts").desc(), "first", "signature"))
    named = found.withColumn("rank", F.least(rank, F.lit(most + 1))).withColumn("signature", F.when(F.col("rank") > most, OTHER).otherwise(F.col("signature")))
    out = named.groupBy("scope", "rank", "signature").agg(F.sum("clusters").alias("clusters"), F.sum("posts").alias("posts"), F.min("first").alias("first"), F.max("last_at").alias("last_at"), F.bool_or("story").alias("story"))
    title = F.when(F.col("rank") > most, OTHER).when(F.col("signature") != F.lower("signature"), F.substring("signature", 1, 80)).otherwise(F.substring(F.initcap(F.replace("signature", F.lit("-"), F.lit(" "))), 1, 80))
    project = F.col("story")
    for word in PROJECT:
        project = project | F.lower(title).contains(word)
    kind = F.when((F.col("rank") > most) | (F.col("clusters") < 2), "one_off_update").when(project, "project_thread").otherwise("recurring_theme")
    return out.select("scope", F.concat(F.lit("track-"), "rank").alias("track"), title.alias("title"), kind.alias("kind"), "posts", "clusters", F.col("first.post_id").alias("first_post"), "last_at")


def timeline(posts: DataFrame, per_cluster: DataFrame) -> DataFrame:
    """scope, cluster, day, post_ids: when each cluster of a track was told; per_cluster: (scope, cluster, day)."""
    return posts.join(per_cluster, ["scope", "cluster"]).groupBy("scope", "cluster", "day").agg(F.array_sort(F.collect_set("post_id")).alias("post_ids"))


def covered(posts: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, track, post_id, origin) of every post, and (scope, total, uncovered, coverage, backfilled).

    told: (scope, track, post_id) as a briefing gave it. Rows of posts that aren't there are dropped, repeated ones count once;
    posts that no track has get one of their own.
    """
    real = told.join(posts.select("scope", "post_id"), ["scope", "post_id"], "left_semi").select("scope", "track", "post_id").distinct()
    missing = posts.select("scope", "post_id").distinct().join(real, ["scope", "post_id"], "left_anti")
    alone = missing.select("scope", F.concat(F.lit("post-"), F.col("post_id").cast("string")).alias("track"), "post_id", F.lit("backfill").alias("origin"))
    out = real.select("scope", "track", "post_id", F.lit("briefing").alias("origin")).unionByName(alone)
    total = posts.groupBy("scope").agg(F.count_distinct("post_id").alias("total"))
    left = missing.groupBy("scope").agg(F.count("*").alias("uncovered"))
    report = total.join(left, "scope", "left").select("scope", "total", F.coalesce("uncovered", F.lit(0)).alias("uncovered"))
    return out, report.withColumns({"coverage": F.round(1 - F.col("uncovered") / F.col("total"), 4), "backfilled": F.col("uncovered") > 0})
