"""Queries of routing, dates, merges, state transitions, stories and vertical briefings, with DuckDB twins written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import posts as unified, sources as routing
from ..operators import merge, stories, vertical
from ..sources import sinks, tables

_ADDRESSES = (
    "https://www.youtube.com/feeds/videos.xml?channel_id=UC1", "https://www.youtube.com/watch?v=1", "http://telegram.local:9504/rss/name", "http://telegram.local/rss", "https://tg.i-c-a.su/rss/x/2",
    "https://nitter.net/user/rss", "https://nitter.net/rss/user", "https://old.reddit.com/r/python/new", "https://reddit.com/user/x", "https://user@GWERN.net:443/doc", "https://site.example/blog/feed", "@handle", "",
)
_ADAPTERS = {"gwern_site": (("gwern.net", "www.gwern.net"), "")}
_LIMITS = ("10", "-25", "0", "-all", "all", "+7", "", "1.5")
_CHANNELS = ("https://www.youtube.com/feeds/videos.xml?channel_id=UCabc", "https://www.youtube.com/feeds/videos.xml?x=1", "UC0123456789012345678", "@name", "https://www.youtube.com/c/Name//", "plain")
_DEFAULTS = {"page_delay_seconds": 9, "batch_size": 10, "batch_cooldown_seconds": 30}


def _values(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def source_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, "address", _ADDRESSES).unionByName(tables.table(spark, sf_dir, "pages").select(F.col("url").alias("address"))).distinct()
    platforms = spark.createDataFrame([("rss",), ("reddit",)], "platform string")
    return rows.crossJoin(F.broadcast(platforms)).select("address", "platform", routing.strategy(F.col("platform"), F.col("address"), _ADAPTERS).alias("strategy"))


def fetch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, "limit", _LIMITS).withColumn("m", routing.limit_mode(F.col("limit"))).select("limit", "m.mode", "m.value")


def channel_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, "reference", _CHANNELS).withColumn("c", routing.channel(F.col("reference"))).select("reference", "c.*")


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.sources(spark, sf_dir)
    stored = F.create_map(F.lit("page_delay_seconds"), F.when(F.col("priority") % 3 != 0, F.col("priority") - 5), F.lit("unknown"), F.lit(1))
    override = F.create_map(F.lit("batch_size"), F.when(F.col("priority") % 2 == 0, F.col("priority") - 8))
    return rows.select("source_id", routing.rate_limit(_DEFAULTS, stored, override).alias("r")).select("source_id", "r.*")


def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.posts(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    requested = F.when(F.col("n") % 2 == 0, F.lit(70))
    return counts.select("source_id", routing.archive_plan(requested, F.col("n"), F.lit(20), F.lit(9), F.lit(3), F.lit(30)).alias("p")).select("source_id", "p.*")


def resolved_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several forms and fields, and the wall clock half a day east."""
    rows = tables.interactions(spark, sf_dir).where("event_id % 5 < 5")
    at, k = F.date_trunc("second", "happened"), F.col("event_id") % 5
    rows = rows.select(
        "event_id",
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k == 4, "no date").alias("date"),
        F.when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 0, "2001-01-01").alias("created_at"),
        F.when(k == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("published"),
        F.when(k == 3, F.unix_seconds(at).cast("string")).alias("timestamp"),
    )
    found = unified.resolve_date(rows)
    return rows.select("event_id", F.unix_seconds(found).alias("second"), unified.in_zone(found, F.lit("+05:30")).alias("local"))


def unified_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lists = F.col("post_id") % 5, F.array("lang")
    post = F.struct(
        F.lit("rss").alias("platform"), F.col("source_id").alias("source"), F.lit("u").alias("url"), F.when(k != 1, F.col("lang")).alias("content"), F.lit("2024-01-01").alias("date"),
        lists.alias("media_urls"), F.when(k != 2, lists).alias("categories"), F.when(k != 3, F.struct("lang")).alias("metadata"),
    )
    json = F.when(k == 4, F.replace(F.to_json(post), F.lit('"media_urls":['), F.lit('"media_urls":"x","rest":['))).otherwise(F.to_json(post))
    return tables.posts(spark, sf_dir).select("post_id", unified.is_unified(json).alias("valid"))


# --- merges -------------------------------------------------------------------------------------


def _batches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")


def _entries(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.col(column))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def upsert_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select(F.concat(F.lit("u"), i % 40).alias("url"), "source_id", F.when(i % 3 != 0, F.col("title")).alias("title"), F.when(i % 4 != 0, F.col("lang")).alias("language_code"), F.when(i % 5 == 0, i.cast("string")).alias("content_hash"), i.alias("seq"))
    return merge.upsert("posts", *_batches(rows)).drop("seq")


def upsert_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select(F.concat(F.lit("a"), i % 30).alias("normalized_url"), F.element_at(F.array(F.lit("other"), F.lit("article"), F.lit("video")), (F.floor(i / 30) % 3 + 1).cast("int")).alias("artifact_type"), F.when(i % 4 == 1, F.col("lang")).alias("display_title"), F.create_map(F.concat(F.lit("k"), F.floor(i / 30) % 4), i.cast("string")).alias("metadata"), i.alias("seq"))
    return merge.upsert("artifacts", *_batches(rows)).select("normalized_url", "artifact_type", "display_title", _entries("metadata").alias("metadata"))


def upsert_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select((i % 12).alias("from_id"), (i % 9).alias("to_id"), F.lit("near_duplicate").alias("relation_type"), F.col("lang").alias("method"), (i % 17 / 16).alias("confidence"), i.alias("seq"))
    return merge.upsert("post_relations", *_batches(rows)).drop("seq", "relation_type")


def upsert_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of posts with entities and the profiles of sources, in one table."""
    i = F.col("post_id")
    posts = tables.posts(spark, sf_dir)
    links = posts.select((i % 25).alias("post_id"), (i % 4).alias("entity_id"), F.lit(0).alias("mention_id"), F.col("lang").alias("resolution_status"), (i % 13 / 12).alias("confidence"), F.when(i % 3 == 0, F.col("source_id")).alias("role"), i.alias("seq"))
    profiles = posts.select("source_id", F.when(i % 6 == 0, F.col("lang")).alias("language_code"), (i % 2 == 1).alias("is_primary_reporter"), i.alias("seq"))
    one = merge.upsert("post_entities", *_batches(links)).select(F.concat_ws("/", "post_id", "entity_id").alias("key"), F.col("resolution_status").alias("state"), "confidence", "role", "first_write")
    two = merge.upsert("source_profiles", *_batches(profiles)).select(F.col("source_id").alias("key"), F.col("language_code").alias("state"), F.col("is_primary_reporter").cast("double").alias("confidence"), F.lit(None).cast("string").alias("role"), "first_write")
    return one.unionByName(two)


def upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select(F.concat(F.lit("e"), i % 20).alias("event_key"), "title", F.when(i % 3 != 0, F.col("minute")).alias("occurred_at"), F.col("minute").alias("last_seen_at"), (i % 7 / 6).alias("confidence"), i.alias("seq"))
    return merge.upsert("events", *_batches(rows)).drop("seq")


def upsert_event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of events, merged, and their entities, of which a second one changes nothing."""
    i = F.col("post_id")
    posts = tables.posts(spark, sf_dir)
    proof = posts.select((i % 10).alias("event_id"), (i % 15).alias("post_id"), F.col("lang").alias("stance"), F.when(i % 2 == 0, F.col("source_id")).alias("evidence_snippet"), (i % 11 / 10).alias("confidence"), i.alias("seq"))
    parts = posts.select((i % 10).alias("event_id"), (i % 6).alias("entity_id"), F.col("lang").alias("role"), i.alias("seq"))
    one = merge.upsert("event_evidence", *_batches(proof)).select(F.concat_ws("/", "event_id", "post_id").alias("key"), "stance", "evidence_snippet", "confidence", "first_write")
    two = merge.upsert("event_entities", *_batches(parts)).select(F.concat_ws("/", "event_id", "entity_id", "role").alias("key"), F.lit(None).cast("string").alias("stance"), F.lit(None).cast("string").alias("evidence_snippet"), F.lit(None).cast("double").alias("confidence"), "first_write")
    return one.unionByName(two)


def upsert_story_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select((i % 8).alias("story_id"), (i % 50).alias("post_id"), F.col("lang").alias("role"), (i % 19 / 18).alias("relevance_score"), (i % 23 == 0).alias("is_anchor_candidate"), i.alias("seq"))
    return merge.upsert("story_posts", *_batches(rows)).drop("seq")


def upsert_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select(F.lit(1).alias("batch_id"), F.lit("post").alias("target_type"), (i % 60).alias("target_id"), (i % 29).alias("priority_score"), F.col("lang").alias("reason_summary"), F.col("minute").alias("surfaced_at"), i.alias("seq"))
    return merge.upsert("inbox_items", *_batches(rows)).drop("seq", "batch_id", "target_type")


def upsert_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select((i % 7).alias("source_topic_id"), (i % 11).alias("target_topic_id"), (i % 31 / 30).alias("similarity_score"), i.alias("seq"))
    return merge.upsert("topic_connections", *_batches(rows)).drop("seq")


def watch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = tables.interactions(spark, sf_dir)
    rows = acts.select(F.col("user_id").alias("video_id"), F.col("minute").alias("progress"), F.lit(1).cast("long").alias("sessions"), F.when(F.col("event_id") % 4 == 0, F.col("kind")).alias("notes"), F.col("event_id").alias("seq"))
    return merge.upsert("watch", *_batches(rows)).drop("seq", "first_write")


def replaced_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.posts(spark, sf_dir).select((F.col("post_id") % 45).alias("post_id"), "lang", F.col("post_id").alias("position"))
    return merge.replace_group(rows.where("position % 3 <> 0"), rows.where("position % 3 = 0 AND position % 45 < 20"), ["post_id"])


def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.interactions(spark, sf_dir).select("user_id", "kind", F.col("event_id").alias("seq"))
    return merge.appended(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["user_id"], most=3)


def superseded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    rows = tables.posts(spark, sf_dir).select(i.alias("batch_id"), F.col("lang").alias("scope_type"), F.when(i % 2 == 0, F.col("source_id")).alias("scope_value"), "day", F.col("minute").alias("created"), F.when(i % 5 == 0, "failed").otherwise("ready").alias("status"))
    return merge.supersede(rows).select("batch_id", "status")


def acted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox items after actions, with whether their source is still enabled."""
    items = tables.posts(spark, sf_dir).select(F.col("post_id").alias("item_id"), "source_id", F.lit("pending").alias("status"))
    names = F.array(*map(F.lit, ("accept", "reject_noise", "save", "snooze", "unknown")))
    acts = tables.interactions(spark, sf_dir).select((F.col("event_id") % 97).alias("item_id"), F.when(F.col("event_id") % 50 == 7, "block_source").otherwise(F.element_at(names, (F.col("user_id") % 5 + 1).cast("int"))).alias("action"), F.col("minute").alias("at"), F.col("event_id").alias("seq"))
    after, blocked = merge.act(items, acts)
    enabled = merge.patched(tables.sources(spark, sf_dir).select("source_id", "enabled"), blocked, ["source_id"], "enabled")
    return after.join(enabled, "source_id").select("item_id", "status", "enabled")


def moved_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    posts = tables.posts(spark, sf_dir)
    assigned = posts.select((i % 6).alias("topic_id"), "post_id")
    moves = posts.where("post_id % 4 = 0").select("post_id", (i % 3).alias("from_topic"), F.lit(99).cast("long").alias("to_topic"))
    return merge.move(assigned, moves)


def outlier_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.posts(spark, sf_dir)
    topics = posts.where("dayofyear(day) % 2 = 0").groupBy("day").agg(F.min("post_id").alias("p")).select(F.concat(F.lit("t"), "p").alias("topic_id"), "day", F.lit("Old").alias("title"), (F.col("p") % 2 == 0).alias("is_outlier"))
    renamed = merge.patched(topics, topics.where("NOT is_outlier").select("topic_id", F.upper("title").alias("title")), ["topic_id"], "title")
    return merge.outliers(renamed, posts.select("day")).select("topic_id", F.col("day").cast("string").alias("day"), "title", "is_outlier")


def cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and labels that are left when the disabled sources go."""
    sources = tables.sources(spark, sf_dir).where("enabled")
    left = merge.cascade(sources, {"posts": (tables.posts(spark, sf_dir).select("post_id", "source_id"), "source_id", "source_id")})["posts"]
    labels = merge.cascade(left, {"labels": (tables.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "post_id")})["labels"]
    return left.select(F.lit("post").alias("kind"), F.col("post_id").alias("id")).unionByName(labels.select(F.lit("label").alias("kind"), F.col("doc_id").alias("id")))


# --- stories and vertical briefings ---------------------------------------------------------------


def _story_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A story for each source, made of its posts in English; those in German are candidates."""
    i, posts = F.col("post_id"), tables.posts(spark, sf_dir).withColumn("story_id", F.col("source_id"))
    own, other = posts.where("lang = 'en'"), posts.where("lang = 'de'")
    heads = own.groupBy("story_id").agg(F.min_by("title", "post_id").alias("title"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    members = own.select("story_id", "post_id", F.lit("context").alias("role"), (i % 7 / 8).alias("relevance"), (i % 10 == 0).alias("is_anchor"))
    updates = own.groupBy("story_id", "day").agg(F.min_by("title", "post_id").alias("title"), F.lit(0.5).alias("importance"))
    role = stories.role_of(F.when(i % 5 == 0, "same_content_hash").otherwise("title_similarity"), F.when(i % 3 == 0, "later").when(i % 3 == 1, "earlier"), F.col("title"), F.col("source_id"))
    accepted = other.select("story_id", "post_id", "title", role.alias("role"), (i % 9 / 10).alias("score"), "published_at")
    return heads, members, updates, accepted


def story_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, members, updates, accepted = _story_rows(spark, sf_dir)
    grown, held, told = stories.attach(heads, members, updates, accepted)
    out = grown.join(held.groupBy("story_id").agg(F.count("*").alias("posts"), F.round(F.sum("relevance"), 6).alias("relevance"), F.count_if(F.col("role") == "corroboration").alias("corroborations"), F.count_if(F.col("role") == "follow_up").alias("follow_ups"), F.count_if(F.col("role") == "commentary").alias("comments")), "story_id")
    out = out.join(told.groupBy("story_id").agg(F.count("*").alias("updates"), F.round(F.sum("importance"), 6).alias("importance")), "story_id")
    return out.select("story_id", F.unix_seconds("first_seen").alias("first_second"), F.unix_seconds("last_seen").alias("last_second"), "posts", "relevance", "corroborations", "follow_ups", "comments", "updates", "importance")


def story_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, members, updates, _ = _story_rows(spark, sf_dir)
    members = members.withColumn("role", F.when(F.col("post_id") % 4 != 0, F.when(F.col("post_id") % 3 == 0, "anchor").otherwise("update")))
    out = stories.detail(heads, members, updates, most=5)
    roles = F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit(":"), r["n"], F.lit(":"), F.array_join(F.transform(r["post_ids"], lambda p: p.cast("string")), ","))), ";")
    return out.select("story_id", "posts", "anchor", "updates", F.col("last_update").cast("string").alias("last_update"), roles.alias("roles"), F.size("timeline").cast("long").alias("told"))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("post_id")
    names = F.array(*map(F.lit, (*stories.DECISIONS, "expired")))
    rows = tables.posts(spark, sf_dir).select("post_id", F.element_at(names, (i % 5 + 1).cast("int")).alias("decision"), (i % 6 / 5).alias("score"), "published_at", i.alias("created_at"))
    return stories.candidate_order(rows).limit(40).select("post_id", "decision")


def track_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.posts(spark, sf_dir).select("post_id", vertical.signature(F.col("title")).alias("signature"))


def _vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each source with a category for their language and one of every tenth post, and a story for some."""
    posts = tables.posts(spark, sf_dir).withColumn("scope", F.col("source_id"))
    i = F.col("post_id")
    links = posts.select("scope", "post_id", F.lit("category").alias("field"), F.col("lang").alias("key"), F.upper("lang").alias("display"))
    links = links.unionByName(posts.where(i % 10 == 0).select("scope", "post_id", F.lit("entity").alias("field"), F.concat(F.lit("e"), i % 40).alias("key"), F.concat(F.lit("Entity "), i % 40).alias("display")))
    told = posts.where(i % 25 == 0).select("post_id", F.concat(F.lit("Story "), i % 3).alias("story_title"))
    return vertical.context(posts, links, told)


def vertical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertical(spark, sf_dir).select("post_id", "story_title", F.array_join("entity_names", ",").alias("entities"), "track_hint")


def vertical_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vertical(spark, sf_dir).select("scope", "post_id", F.col("minute").alias("at"), (F.col("post_id") - F.col("post_id") % 2).alias("cluster"), F.col("track_hint").alias("signature"), F.coalesce("story_title", F.lit("")).alias("story_title"))
    return vertical.tracks(rows)


def vertical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.posts(spark, sf_dir).select(F.col("source_id").alias("scope"), "post_id")
    told = posts.where("post_id % 3 = 0").select("scope", F.lit("track-1").alias("track"), F.col("post_id") + F.when(F.col("post_id") % 9 == 0, 1_000_000).otherwise(0))
    rows, report = vertical.covered(posts, told.toDF("scope", "track", "post_id"))
    return report.join(rows.groupBy("scope").agg(F.count_distinct("track").alias("tracks")), "scope")


# --- exports and nested lists ---------------------------------------------------------------------


def _counted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.posts(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("post_count"))
    return tables.sources(spark, sf_dir).join(counts, "source_id", "left")


def platform_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.platform_totals(_counted_sources(spark, sf_dir))


def platform_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources nested by platform in the order of priority; a platform is enabled if one of them is."""
    rows = _counted_sources(spark, sf_dir).groupBy("platform").agg(F.array_sort(F.collect_list(F.struct("priority", "source_id", "post_count"))).alias("s"), F.bool_or("enabled").alias("enabled"), F.sum("post_count").alias("posts"))
    return rows.select("platform", "enabled", "posts", F.array_join(F.transform("s", lambda x: x["source_id"]), ",").alias("sources"))


def topics_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each day with their newest posts nested (ten at most), outliers last."""
    posts = tables.posts(spark, sf_dir).withColumn("topic", F.col("lang")).withColumn("rank", F.row_number().over(Window.partitionBy("day", "lang").orderBy(F.col("minute").desc())))
    rows = posts.groupBy("day", "topic").agg(F.count("*").alias("post_count"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "post_id")))).alias("p"), F.min("post_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.col("topic") == "fr", "first"))
    return rows.select(F.col("day").cast("string").alias("day"), "topic", "post_count", place.alias("place"), F.array_join(F.transform("p", lambda x: x["post_id"].cast("string")), ",").alias("posts"))


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all exported posts: platforms, dates, words, and the kinds of content."""
    posts = tables.posts(spark, sf_dir).join(tables.sources(spark, sf_dir).select("source_id", "platform"), "source_id")
    kind = F.when(F.char_length("content") < 200, "short").when(F.char_length("content") < 2000, "medium").otherwise("long")
    out = posts.agg(F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("posts"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        source_route, fetch_limits, channel_references, rate_limits, archive_plan, resolved_dates, unified_posts, upsert_posts, upsert_artifacts, upsert_relations, upsert_memory, upsert_events, upsert_event_links,
        upsert_story_posts, upsert_inbox, upsert_topics, watch_progress, replaced_highlights, recent_log, superseded_batches, acted_items, moved_posts, outlier_topics, cascaded, story_attach, story_detail,
        review_order, track_signatures, vertical_context, vertical_tracks, vertical_coverage, platform_totals, platform_sources, topics_of_day, export_summary,
    )
}


def _list(values: tuple[str, ...], name: str) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + f") v({name})"


_FIRST_WRITE = "bool_and({0} % 2 = 1) AS first_write"
_HOST = r"lower(coalesce(regexp_extract(address, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#:@]*)', 2), ''))"
_PATH = r"coalesce(regexp_extract(address, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')"
_WORDS = "list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''-]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in vertical.SMALL) + "))"
_LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
_VERTICAL = """v AS (SELECT post_id, source_id AS scope, minute, CASE WHEN post_id % 25 = 0 THEN 'Story ' || (post_id % 3) END AS story_title, CASE WHEN post_id % 10 = 0 THEN 'Entity ' || (post_id % 40) ELSE '' END AS entities,
  CASE WHEN post_id % 10 = 0 AND count(*) FILTER (WHERE post_id % 10 = 0) OVER (PARTITION BY source_id, post_id % 40) > 1 THEN 'Entity ' || (post_id % 40) END AS shared_entity,
  CASE WHEN lang IS NOT NULL AND count(*) OVER (PARTITION BY source_id, lang) > 1 THEN upper(lang) END AS shared_category, upper(lang) AS category, title FROM posts),
hinted AS (SELECT *, coalesce(story_title, shared_entity, shared_category, nullif(entities, ''), category, trim(title)) AS track_hint FROM v)"""

ORACLE: dict[str, str] = {
    "source_route": f"""SELECT address, platform, CASE WHEN {_HOST} IN ('gwern.net', 'www.gwern.net') THEN 'gwern_site' WHEN platform = 'reddit' THEN 'reddit_subreddit'
  WHEN {_HOST} IN ({_LISTED(routing.TELEGRAM)}) AND regexp_matches({_PATH}, '^/+rss/+[^/]') THEN 'telegram_rss' WHEN {_HOST} IN ({_LISTED(routing.NITTER)}) AND regexp_matches({_PATH}, '^/+[^/]+/+rss(/|$)') THEN 'nitter_rss'
  WHEN {_HOST} IN ({_LISTED(routing.YOUTUBE)}) AND {_PATH} = '/feeds/videos.xml' THEN 'youtube_channel' WHEN {_HOST} IN ({_LISTED(routing.REDDIT)}) AND contains({_PATH}, '/r/') THEN 'reddit_subreddit' ELSE 'generic_rss' END AS strategy
  FROM (SELECT address FROM {_list(_ADDRESSES, "address")} UNION SELECT url FROM pages) a CROSS JOIN (VALUES ('rss'), ('reddit')) p(platform)""",
    "fetch_limits": f"""SELECT "limit", CASE WHEN "limit" = '-all' THEN 'all' WHEN n > 0 THEN 'recent' WHEN n < 0 THEN 'from_id' END AS mode, CASE WHEN "limit" = '-all' THEN 0 WHEN n <> 0 THEN abs(n) END AS value
  FROM (SELECT "limit", CASE WHEN regexp_matches("limit", '^[+-]?[0-9]+$') THEN TRY_CAST("limit" AS BIGINT) END AS n FROM {_list(_LIMITS, '"limit"')}) x""",
    "channel_references": """SELECT * FROM (VALUES ('https://www.youtube.com/feeds/videos.xml?channel_id=UCabc', 'UCabc', 'https://www.youtube.com/channel/UCabc', 'https://www.youtube.com/feeds/videos.xml?channel_id=UCabc'),
  ('https://www.youtube.com/feeds/videos.xml?x=1', NULL, NULL, 'https://www.youtube.com/feeds/videos.xml?x=1'), ('UC0123456789012345678', 'UC0123456789012345678', 'https://www.youtube.com/channel/UC0123456789012345678', 'https://www.youtube.com/feeds/videos.xml?channel_id=UC0123456789012345678'),
  ('@name', NULL, 'https://www.youtube.com/@name', NULL), ('https://www.youtube.com/c/Name//', NULL, 'https://www.youtube.com/c/Name', NULL), ('plain', NULL, 'https://www.youtube.com/@plain', NULL)) v(reference, channel_id, channel_url, rss_url)""",
    "rate_limits": """SELECT source_id, CAST(CASE WHEN priority % 3 = 0 THEN 9 WHEN priority < 5 THEN 0 ELSE priority - 5 END AS INT) AS page_delay_seconds,
  CAST(CASE WHEN priority % 2 = 1 THEN 10 WHEN priority < 9 THEN 1 ELSE priority - 8 END AS INT) AS batch_size, 30 AS batch_cooldown_seconds FROM sources""",
    "archive_plan": """SELECT source_id, posts, pages, pages + CASE WHEN pages < 2 THEN 0 ELSE (pages - 1 - (pages - 1) // 3) * 9 + (pages - 1) // 3 * 30 END AS seconds
  FROM (SELECT source_id, posts, (posts + 19) // 20 AS pages FROM (SELECT source_id, CASE WHEN count(*) % 2 = 0 AND count(*) > 70 THEN 70 ELSE count(*) END AS posts FROM posts GROUP BY source_id) a) b""",
    "resolved_dates": """SELECT event_id, second, strftime(TIMESTAMP '1970-01-01' + to_seconds(second) + INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M:%S') AS local
  FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(floor(epoch(happened)) AS BIGINT) - CASE WHEN event_id % 5 = 2 THEN 7200 ELSE 0 END END AS second FROM interactions) x""",
    "unified_posts": "SELECT post_id, post_id % 5 = 0 AS valid FROM posts",
    "upsert_posts": f"""SELECT 'u' || post_id % 40 AS url, arg_min(source_id, post_id) AS source_id, arg_max(title, post_id) FILTER (WHERE post_id % 3 <> 0) AS title, arg_max_null(CASE WHEN post_id % 4 <> 0 THEN lang END, post_id) AS language_code,
  max(post_id) FILTER (WHERE post_id % 5 = 0)::VARCHAR AS content_hash, {_FIRST_WRITE.format("post_id")} FROM posts GROUP BY post_id % 40""",
    "upsert_artifacts": """WITH r AS (SELECT post_id, 'a' || post_id % 30 AS u, post_id // 30 % 3 AS t, post_id // 30 % 4 AS k, lang FROM posts),
m AS (SELECT u, string_agg('k' || k || '=' || last, ',' ORDER BY k) AS metadata FROM (SELECT u, k, max(post_id) AS last FROM r GROUP BY u, k) x GROUP BY u)
SELECT r.u AS normalized_url, coalesce(arg_min(CASE t WHEN 1 THEN 'article' ELSE 'video' END, post_id) FILTER (WHERE t <> 0), 'other') AS artifact_type, arg_max(lang, post_id) FILTER (WHERE post_id % 4 = 1) AS display_title, any_value(metadata) AS metadata
FROM r JOIN m ON m.u = r.u GROUP BY r.u""",
    "upsert_relations": f"""SELECT post_id % 12 AS from_id, post_id % 9 AS to_id, arg_max(lang, post_id) AS method, max(post_id % 17) / 16.0::DOUBLE AS confidence, {_FIRST_WRITE.format("post_id")} FROM posts
  WHERE post_id % 12 <> post_id % 9 GROUP BY post_id % 12, post_id % 9""",
    "upsert_memory": f"""SELECT (post_id % 25) || '/' || (post_id % 4) AS key, arg_max(lang, post_id) AS state, max(post_id % 13) / 12.0::DOUBLE AS confidence, arg_max(source_id, post_id) FILTER (WHERE post_id % 3 = 0) AS role, {_FIRST_WRITE.format("post_id")}
  FROM posts GROUP BY post_id % 25, post_id % 4
  UNION ALL SELECT source_id, arg_max(lang, post_id) FILTER (WHERE post_id % 6 = 0), CAST(max(post_id) % 2 AS DOUBLE), NULL, {_FIRST_WRITE.format("post_id")} FROM posts GROUP BY source_id""",
    "upsert_events": f"""SELECT 'e' || post_id % 20 AS event_key, arg_max(title, post_id) AS title, arg_min(minute, post_id) FILTER (WHERE post_id % 3 <> 0) AS occurred_at, max(minute) AS last_seen_at, max(post_id % 7) / 6.0::DOUBLE AS confidence,
  {_FIRST_WRITE.format("post_id")} FROM posts GROUP BY post_id % 20""",
    "upsert_event_links": f"""SELECT (post_id % 10) || '/' || (post_id % 15) AS key, arg_max(lang, post_id) AS stance, arg_max(source_id, post_id) FILTER (WHERE post_id % 2 = 0) AS evidence_snippet, max(post_id % 11) / 10.0::DOUBLE AS confidence, {_FIRST_WRITE.format("post_id")}
  FROM posts GROUP BY post_id % 10, post_id % 15
  UNION ALL SELECT (post_id % 10) || '/' || (post_id % 6) || '/' || lang, NULL, NULL, NULL, {_FIRST_WRITE.format("post_id")} FROM posts GROUP BY post_id % 10, post_id % 6, lang""",
    "upsert_story_posts": f"""SELECT post_id % 8 AS story_id, post_id % 50 AS post_id, arg_max(lang, p.post_id) AS role, max(p.post_id % 19) / 18.0::DOUBLE AS relevance_score, bool_or(p.post_id % 23 = 0) AS is_anchor_candidate, {_FIRST_WRITE.format("p.post_id")}
  FROM posts p GROUP BY p.post_id % 8, p.post_id % 50""",
    "upsert_inbox": f"""WITH f AS (SELECT post_id % 60 AS t, lang, min(post_id) AS first FROM posts GROUP BY post_id % 60, lang)
SELECT a.t AS target_id, priority_score, reason_summary, surfaced_at, first_write FROM (SELECT post_id % 60 AS t, max(post_id % 29) AS priority_score, min(minute) AS surfaced_at, {_FIRST_WRITE.format("post_id")} FROM posts GROUP BY post_id % 60) a
JOIN (SELECT t, string_agg(lang, '; ' ORDER BY first) AS reason_summary FROM f GROUP BY t) b ON b.t = a.t""",
    "upsert_topics": f"SELECT post_id % 7 AS source_topic_id, post_id % 11 AS target_topic_id, arg_min(post_id % 31, (post_id % 2, post_id)) / 30.0::DOUBLE AS similarity_score, {_FIRST_WRITE.format('post_id')} FROM posts GROUP BY post_id % 7, post_id % 11",
    "watch_progress": "SELECT user_id AS video_id, arg_max(minute, (event_id % 2, event_id)) AS progress, count(*) AS sessions, arg_max(kind, event_id) FILTER (WHERE event_id % 4 = 0) AS notes FROM interactions GROUP BY user_id",
    "replaced_highlights": """SELECT post_id % 45 AS post_id, lang, post_id AS position FROM posts p WHERE p.post_id % 3 = 0 AND p.post_id % 45 < 20
  OR p.post_id % 3 <> 0 AND p.post_id % 45 NOT IN (SELECT q.post_id % 45 FROM posts q WHERE q.post_id % 3 = 0 AND q.post_id % 45 < 20)""",
    "recent_log": "SELECT user_id, kind, event_id AS seq FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3",
    "superseded_batches": """SELECT post_id AS batch_id, CASE WHEN post_id % 5 = 0 THEN 'failed' WHEN post_id = max(CASE WHEN post_id % 5 <> 0 THEN post_id END) OVER (PARTITION BY lang, CASE WHEN post_id % 2 = 0 THEN source_id END, day) THEN 'ready' ELSE 'superseded' END AS status FROM posts""",
    "acted_items": """WITH a AS (SELECT event_id % 97 AS item_id, CASE WHEN event_id % 50 = 7 THEN 'blocked_source' ELSE list_extract(['accepted', 'rejected_noise', 'saved', 'snoozed', NULL], CAST(user_id % 5 + 1 AS INT)) END AS state, minute, event_id FROM interactions),
l AS (SELECT item_id, arg_max(state, (minute, event_id)) AS state FROM a WHERE state IS NOT NULL GROUP BY item_id),
b AS (SELECT DISTINCT p.source_id FROM a JOIN posts p ON p.post_id = a.item_id WHERE state = 'blocked_source')
SELECT p.post_id AS item_id, coalesce(l.state, 'pending') AS status, s.enabled AND b.source_id IS NULL AS enabled FROM posts p JOIN sources s ON s.source_id = p.source_id LEFT JOIN l ON l.item_id = p.post_id LEFT JOIN b ON b.source_id = p.source_id""",
    "moved_posts": "SELECT CASE WHEN post_id % 4 = 0 AND post_id % 6 = post_id % 3 THEN 99 ELSE post_id % 6 END AS topic_id, post_id FROM posts",
    "outlier_topics": """WITH t AS (SELECT day, min(post_id) AS p, dayofyear(day) % 2 = 0 AS has FROM posts GROUP BY day)
SELECT 't' || p AS topic_id, CAST(day AS VARCHAR) AS day, CASE WHEN p % 2 = 0 THEN 'Old' ELSE 'OLD' END AS title, p % 2 = 0 AS is_outlier FROM t WHERE has
UNION ALL SELECT 'outlier-' || day, CAST(day AS VARCHAR), 'Uncategorized Posts', true FROM t WHERE NOT has OR p % 2 = 1""",
    "cascaded": """SELECT 'post' AS kind, post_id AS id FROM posts WHERE source_id IS NULL OR source_id IN (SELECT source_id FROM sources WHERE enabled)
  UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id IN (SELECT post_id FROM posts WHERE source_id IS NULL OR source_id IN (SELECT source_id FROM sources WHERE enabled))""",
    "story_attach": """WITH c AS (SELECT source_id AS story_id, post_id, day, minute, CASE WHEN lang = 'de' THEN post_id % 9 / 10.0 ELSE post_id % 7 / 8.0 END AS s, lang,
  CASE WHEN lang = 'en' THEN 'context' WHEN post_id % 5 = 0 THEN 'corroboration' WHEN post_id % 3 = 0 THEN 'follow_up' WHEN post_id % 3 = 1 THEN 'context' WHEN trim(lower(title)) NOT IN ('', lower(source_id)) THEN 'commentary' ELSE 'context' END AS role
  FROM posts WHERE lang IN ('en', 'de') AND source_id IN (SELECT source_id FROM posts WHERE lang = 'en')),
u AS (SELECT story_id, day, bool_or(lang = 'en') AS own, max(s) FILTER (WHERE lang = 'de') AS best FROM c GROUP BY story_id, day)
SELECT a.*, updates, importance FROM (SELECT story_id, 1704067200 + min(minute) * 60 AS first_second, 1704067200 + max(minute) * 60 AS last_second, count(*) AS posts, round(CAST(sum(s) AS DOUBLE), 6) AS relevance,
  count(*) FILTER (WHERE role = 'corroboration') AS corroborations, count(*) FILTER (WHERE role = 'follow_up') AS follow_ups, count(*) FILTER (WHERE role = 'commentary') AS comments FROM c GROUP BY story_id) a
JOIN (SELECT story_id, count(*) AS updates, round(CAST(sum(CASE WHEN own THEN 0.5 ELSE best END) AS DOUBLE), 6) AS importance FROM u GROUP BY story_id) b ON b.story_id = a.story_id""",
    "story_detail": """WITH m AS (SELECT source_id AS story_id, post_id, day, post_id % 7 AS rel, CASE WHEN post_id % 4 = 0 THEN 'context' WHEN post_id % 3 = 0 THEN 'anchor' ELSE 'update' END AS role FROM posts WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY story_id, role ORDER BY rel DESC, post_id) AS rn FROM m),
g AS (SELECT story_id, role, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN post_id END, ',' ORDER BY rn) AS ids FROM r GROUP BY story_id, role)
SELECT a.story_id, posts, anchor, updates, last_update, roles, updates AS told FROM (SELECT story_id, count(*) AS posts, arg_max(post_id, (rel, -post_id)) FILTER (WHERE post_id % 10 = 0) AS anchor, count(DISTINCT day) AS updates, CAST(max(day) AS VARCHAR) AS last_update FROM m GROUP BY story_id) a
JOIN (SELECT story_id, string_agg(role || ':' || n || ':' || ids, ';' ORDER BY role) AS roles FROM g GROUP BY story_id) b ON b.story_id = a.story_id""",
    "review_order": "SELECT post_id, list_extract(['accepted', 'proposed', 'needs_review', 'rejected', 'expired'], CAST(post_id % 5 + 1 AS INT)) AS decision FROM posts ORDER BY post_id % 5, post_id % 6 DESC, minute, post_id LIMIT 40",
    "track_signatures": f"""SELECT post_id, CASE WHEN len(w) = 0 THEN 'general' WHEN len(w) > 1 AND w[1] IN ({_LISTED(vertical.LEADS)}) THEN array_to_string(w[2:3], ' ')
  WHEN len(w) > 1 AND (w[2] IN ({_LISTED(vertical.SUFFIXES)}) OR regexp_full_match(w[2], 'v?[0-9]+([.][0-9]+)?')) THEN w[1] ELSE array_to_string(w[1:2], ' ') END AS signature FROM (SELECT post_id, {_WORDS} AS w FROM posts) x""",
    "vertical_context": f"WITH {_VERTICAL} SELECT post_id, story_title, entities, track_hint FROM hinted",
    "vertical_tracks": f"""WITH {_VERTICAL}, c AS (SELECT scope, post_id - post_id % 2 AS cluster, arg_min(coalesce(story_title, track_hint), post_id) AS sig, arg_min(coalesce(story_title, ''), post_id) <> '' AS story, count(*) AS posts, min(post_id) AS first, max(minute) AS last_at FROM hinted GROUP BY scope, post_id - post_id % 2),
t AS (SELECT scope, sig, count(*) AS clusters, sum(posts) AS posts, min(first) AS first, max(last_at) AS last_at, bool_or(story) AS story, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, sum(posts) DESC, min(first), sig) AS rn FROM c GROUP BY scope, sig),
n AS (SELECT scope, least(rn, 6) AS rn, CASE WHEN rn > 5 THEN 'Other Updates' ELSE sig END AS sig, sum(clusters) AS clusters, sum(posts) AS posts, min(first) AS first, max(last_at) AS last_at, bool_or(story) AS story FROM t GROUP BY ALL)
SELECT scope, 'track-' || rn AS track, substr(sig, 1, 80) AS title, CASE WHEN rn = 6 OR clusters < 2 THEN 'one_off_update' WHEN story OR regexp_matches(lower(substr(sig, 1, 80)), '{"|".join(vertical.PROJECT)}') THEN 'project_thread' ELSE 'recurring_theme' END AS kind,
  CAST(posts AS BIGINT) AS posts, CAST(clusters AS BIGINT) AS clusters, first AS first_post, last_at FROM n""",
    "vertical_coverage": """SELECT source_id AS scope, count(*) AS total, count(*) FILTER (WHERE NOT told) AS uncovered, round(CAST(count(*) FILTER (WHERE told) AS DOUBLE) / count(*), 4) AS coverage, bool_or(NOT told) AS backfilled,
  count(*) FILTER (WHERE NOT told) + CASE WHEN bool_or(told) THEN 1 ELSE 0 END AS tracks FROM (SELECT source_id, post_id % 3 = 0 AND post_id % 9 <> 0 AS told FROM posts) x GROUP BY source_id""",
    "platform_totals": "SELECT platform, count(*) AS sources, count(*) FILTER (WHERE enabled) AS enabled, CAST(sum(n) AS BIGINT) AS posts FROM sources s JOIN (SELECT source_id, count(*) AS n FROM posts GROUP BY source_id) c ON c.source_id = s.source_id GROUP BY ROLLUP (platform)",
    "platform_sources": "SELECT platform, bool_or(enabled) AS enabled, CAST(sum(n) AS BIGINT) AS posts, string_agg(s.source_id, ',' ORDER BY priority, s.source_id) AS sources FROM sources s JOIN (SELECT source_id, count(*) AS n FROM posts GROUP BY source_id) c ON c.source_id = s.source_id GROUP BY platform",
    "topics_of_day": """WITH r AS (SELECT day, lang, post_id, row_number() OVER (PARTITION BY day, lang ORDER BY minute DESC) AS rn FROM posts)
SELECT CAST(day AS VARCHAR) AS day, lang AS topic, count(*) AS post_count, CAST(row_number() OVER (PARTITION BY day ORDER BY lang = 'fr', min(post_id)) AS INT) AS place, string_agg(CASE WHEN rn <= 10 THEN post_id END, ',' ORDER BY rn) AS posts FROM r GROUP BY day, lang""",
    "export_summary": """SELECT string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS posts,
  string_agg(DISTINCT CASE WHEN length(content) < 200 THEN 'short' WHEN length(content) < 2000 THEN 'medium' ELSE 'long' END, ',' ORDER BY CASE WHEN length(content) < 200 THEN 'short' WHEN length(content) < 2000 THEN 'medium' ELSE 'long' END) AS kinds
  FROM posts p JOIN sources s ON s.source_id = p.source_id""",
}
