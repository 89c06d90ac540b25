"""Queries of the composite operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import language, text, urls
from ..operators import briefings, evidence, inbox, memory, merge, ranking, stories, topics
from ..sources import feeds, tables


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.posts(spark, sf_dir)


def full_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the page of equal id, and the evidence columns."""
    pages = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), "url", "html")
    platforms = tables.sources(spark, sf_dir).select("source_id", "platform", "priority")
    return evidence.enrich(_posts(spark, sf_dir).join(pages, "post_id", "left").join(platforms, "source_id", "left")).withColumn("tags", text.keyword_tags(F.col("platform"), F.col("title"), F.col("content")))


def post_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", text.hash_text(F.col("title")).alias("title_hash"), text.hash_content(F.col("title"), F.col("content"), F.lit(None).cast("string")).alias("content_hash"))


def post_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", text.brief(F.col("title"), F.col("content")).alias("brief"), text.topic(F.col("title"), F.col("content")).alias("topic"), text.token_estimate(F.col("content")).alias("tokens"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized_url"), urls.artifact_type(F.col("url"), F.lit("rss")).alias("artifact_type"))


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.page_post(tables.table(spark, sf_dir, "pages").select("url", "html"))


def post_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.detect(F.col("content"))
    return _posts(spark, sf_dir).select("post_id", "lang", found["code"].alias("code"), found["confidence"].alias("confidence"), language.script(F.col("content")).alias("script"))


def post_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = text.keyword_tags(F.lit("rss"), F.col("title"), F.col("content"))
    return _posts(spark, sf_dir).select("post_id", F.array_join(tags, ",").alias("tags"))


def post_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", F.explode(text.highlights(F.col("content"))).alias("h")).select("post_id", "h.*")


def post_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.artifacts(full_posts(spark, sf_dir))


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts = full_posts(spark, sf_dir)
    ranking.checkpoints(spark)
    return posts, evidence.artifacts(posts).where("NOT is_primary").select("post_id", "normalized_url").checkpoint()


def post_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, shared = _shared(spark, sf_dir)
    return evidence.relations(posts, shared, evidence.candidates(posts, shared))


def evidence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal addresses and texts are keys of the clusters, artifacts stars; relations are worked out for the pairs of a host."""
    posts, shared = _shared(spark, sf_dir)
    found = evidence.relations(posts, shared.limit(0), evidence.same_host(posts))
    return evidence.clusters(posts, found.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(evidence.stars(shared)))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.mentions(_posts(spark, sf_dir)).drop("published_at")


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.mentions(_posts(spark, sf_dir))
    known = found.where("kind IN ('multiword', 'single') AND post_id < 50").select("name", "entity_type").distinct().select(F.concat(F.lit("known-"), F.md5("name")).alias("entity_id"), "name", "entity_type")
    return memory.resolve(found, known)


def event_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.event_memory(_posts(spark, sf_dir))


def story_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.candidates(full_posts(spark, sf_dir).withColumn("blocking", F.concat_ws("|", "source_id", "lang")))


def similar_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topics.similar(rows, rows.where("id % 100 = 0"), threshold=0.3).select("probe", "id", "similarity")


def topic_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), (F.col("quality") - F.col("toxic")).alias("topic"), F.format_string("Topic %d", F.col("quality") - F.col("toxic")).alias("title"))
    return topics.store(labels, _posts(spark, sf_dir)).select("topic", "title", "is_outlier", "post_count")


def _newest(posts: DataFrame) -> DataFrame:
    return posts.agg(F.max("minute").alias("now"))


def cluster_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first post of the same text, and how many there are: by a hash, so that texts don't meet in one task."""
    marks = _posts(spark, sf_dir).select("post_id", F.sha2("content", 256).alias("mark"))
    heads = marks.groupBy("mark").agg(F.min("post_id").alias("canonical"), F.count("*").alias("size"))
    return marks.alias("m").join(heads.alias("h"), F.col("m.mark").eqNullSafe(F.col("h.mark"))).select("post_id", "canonical", "size")


def nearby_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every post the 120 nearest in time of the same source and language, within 30 days."""
    posts = _posts(spark, sf_dir).select("post_id", "published_at", F.concat_ws("|", "source_id", "lang").alias("blocking"))
    return stories.pool(posts).select("post_id", "other", (F.col("gap") / 60).cast("long").alias("gap"))


def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    recent = posts.crossJoin(F.broadcast(_newest(posts))).where("minute >= now - 10080").select("post_id", F.char_length("title").alias("size"), "minute")
    return ranking.positions(recent, [F.col("size").desc(), F.col("minute").desc(), F.col("post_id").asc()]).select("post_id", F.col("position").cast("int").alias("position"))


def posts_in_caller_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ranking.positions(tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id")), [F.col("post_id").desc()], "ord")
    return wanted.join(_posts(spark, sf_dir).select("post_id", "source_id"), "post_id").select("ord", "post_id", "source_id")


def inbox_post_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the last week with what their scores are made of."""
    posts, acts = _posts(spark, sf_dir), tables.interactions(spark, sf_dir)
    users = acts.agg((F.max("user_id") + 1).alias("users"))
    clicks = acts.where("kind = 'click'").groupBy("user_id").agg(F.count("*").alias("artifacts"))
    posts = posts.withColumn("mark", F.sha2("content", 256)).drop("content", "title")  # texts don't go through shuffles
    copies = posts.groupBy("mark").agg(F.count("*").alias("copies"), F.min("post_id").alias("first"))
    rows = posts.crossJoin(F.broadcast(users)).crossJoin(F.broadcast(_newest(posts)))  # one row each
    rows = rows.where(F.col("minute") >= F.col("now") - inbox.POST_HOURS * 60).withColumn("user_id", F.col("post_id") % F.col("users"))
    rows = rows.join(clicks, "user_id", "left").join(copies, "mark").join(tables.sources(spark, sf_dir).select("source_id", "priority"), "source_id")
    return rows.select(
        F.col("post_id").alias("id"),
        ((F.col("now") - F.col("minute")) / 60).alias("hours"),
        F.coalesce("artifacts", F.lit(0)).alias("artifacts"),
        (F.col("copies") - 1).alias("relations"),
        (F.col("first") < F.col("post_id")).alias("duplicates"),
        F.lit(False).alias("linked"),
        F.lit(0.9).alias("language_confidence"),
        "priority",
    )


def inbox_story_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story for each source and day."""
    posts = _posts(spark, sf_dir)
    grouped = posts.groupBy("source_id", "day").agg(F.count("*").alias("posts"), F.count_distinct("lang").alias("updates"), F.min("post_id").alias("id"), F.min("minute").alias("first"), F.max("minute").alias("last"))
    rows = grouped.crossJoin(F.broadcast(_newest(posts))).join(tables.sources(spark, sf_dir).select("source_id", "priority"), "source_id")
    hours, age = (F.col("now") - F.col("last")) / 60, (F.col("now") - F.col("first")) / 60
    importance = F.least(F.col("posts") / 10, F.lit(1.0))
    fresh, moved = (age <= inbox.STORY_HOURS), (hours <= inbox.STORY_HOURS) & ((importance >= 0.5) | (F.col("updates") >= 2))
    return rows.select("id", hours.alias("hours"), "posts", "updates", importance.alias("importance"), F.lit(0.5).alias("anchor"), "priority", (fresh.cast("int") + moved.cast("int")).alias("signals"))


def inbox_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.score_posts(inbox_post_inputs(spark, sf_dir)).select("id", "score", "novelty")


def inbox_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.score_stories(inbox_story_inputs(spark, sf_dir)).select("id", "score", "novelty")


def inbox_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.rebuild(inbox_story_inputs(spark, sf_dir), inbox_post_inputs(spark, sf_dir))


def daily_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = briefings.daily(_posts(spark, sf_dir))
    return out.select(F.col("day").cast("string").alias("day"), "content")


def source_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = briefings.by_source(_posts(spark, sf_dir))
    return out.select(F.col("day").cast("string").alias("day"), "source_id", "title", "post_count", "summary")


def weekly_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = briefings.weekly(briefings.by_source(_posts(spark, sf_dir)))
    return out.select(F.col("week").cast("string").alias("week"), "title", "days", "posts")


def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefings.profile(_posts(spark, sf_dir))


def source_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir).select("post_id", "source_id", "title").join(cluster_canonical(spark, sf_dir).select("post_id", F.col("canonical").alias("cluster")), "post_id")
    return briefings.tracks(posts)


def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches folded by source and language."""
    rows = _posts(spark, sf_dir).select("source_id", "lang", "minute", "post_id", F.when(F.col("post_id") % 3 != 0, F.col("title")).alias("title"), (F.col("post_id") % 7 == 0).alias("starred"), F.lit(1).cast("long").alias("sessions"), F.col("post_id").alias("seq"))
    rules = {"minute": "greatest", "post_id": "least", "title": "latest", "starred": "any", "sessions": "add"}
    return merge.fold(rows.where("post_id % 2 = 0"), rows.where("post_id % 2 = 1"), ["source_id", "lang"], rules).drop("seq")


def comment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"), F.when(F.col("turn") == 0, F.col("conv_id")).otherwise(0).alias("position"), F.col("text").alias("body"))
    return feeds.flatten_comments(rows).select("id", "depth")


def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.interactions(spark, sf_dir)
    return rows.groupBy(F.window("happened", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start")).alias("start_second"), "kind", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.interactions(spark, sf_dir)
    return rows.groupBy(F.session_window("happened", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).select("user_id", F.unix_seconds(F.col("w.start")).alias("start_second"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        post_fingerprints, post_briefs, page_hosts, page_urls, page_posts, post_languages, post_tags, post_highlights, post_artifacts, post_relations, evidence_clusters,
        entity_mentions, entity_resolution, event_memory, story_candidates, similar_topics, topic_storage, inbox_posts, inbox_stories, inbox_rebuild, daily_briefings,
        cluster_canonical, nearby_posts, queue_position, posts_in_caller_order, source_briefings, weekly_topics, source_profiles, source_tracks, merged_posts, comment_tree, hourly_activity, user_sessions,
    )
}

_NORMAL = "replace(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))), 'ß', 'ss')"
_TITLE, _CONTENT = _NORMAL.format("title"), _NORMAL.format("content")
_SHORT = "rtrim(substr(trim(title), 1, 220))"
_SCORED_POSTS = """scored_posts AS (SELECT id, novelty, round(greatest(100 * (0.50 * novelty_raw + 0.28 * (0.30 + 0.30 * least(artifacts / 3, 1.0) + 0.20 * least(relations / 5, 1.0) + 0.20 * 0.9)
  + 0.22 * least(greatest(1 - (greatest(priority, 1) - 1) / 999, 0.0), 1.0) - 0.55 * duplicates), 0.0), 2) AS score FROM (
  SELECT p.post_id AS id, least(greatest(1 - CAST(now - minute AS DOUBLE) / 60 / 168, 0.0), 1.0) AS novelty_raw, round(least(greatest(1 - CAST(now - minute AS DOUBLE) / 60 / 168, 0.0), 1.0), 4) AS novelty,
    CAST(coalesce(artifacts, 0) AS DOUBLE) AS artifacts, CAST(copies - 1 AS DOUBLE) AS relations, CASE WHEN first < p.post_id THEN 1 ELSE 0 END AS duplicates, CAST(priority AS DOUBLE) AS priority
  FROM posts p CROSS JOIN (SELECT max(minute) AS now FROM posts) n CROSS JOIN (SELECT max(user_id) + 1 AS users FROM interactions) u
  LEFT JOIN (SELECT user_id, count(*) AS artifacts FROM interactions WHERE kind = 'click' GROUP BY user_id) c ON c.user_id = p.post_id % users
  JOIN (SELECT content, count(*) AS copies, min(post_id) AS first FROM posts GROUP BY content) d ON d.content = p.content
  JOIN sources s ON s.source_id = p.source_id WHERE minute >= now - 10080) x)"""
_SCORED_STORIES = """scored_stories AS (SELECT id, novelty, round(least(greatest(100 * (0.32 * novelty_raw + 0.38 * (0.40 * least(posts / 4, 1.0) + 0.35 * least(updates / 3, 1.0) + 0.25 * greatest(importance, 0.5))
  + 0.20 * (0.45 * least(posts / 5, 1.0) + 0.25 * least(updates / 4, 1.0) + 0.30 * 0.5) + 0.10 * least(greatest(1 - (greatest(priority, 1) - 1) / 999, 0.0), 1.0) + least(0.25 * (signals - 1), 0.35)), 0.0), 100.0), 2) AS score FROM (
  SELECT *, (CASE WHEN age <= 72 THEN 1 ELSE 0 END) + (CASE WHEN hours <= 72 AND (importance >= 0.5 OR updates >= 2) THEN 1 ELSE 0 END) AS signals,
    least(greatest(1 - hours / 72, 0.0), 1.0) AS novelty_raw, round(least(greatest(1 - hours / 72, 0.0), 1.0), 4) AS novelty FROM (
  SELECT min(post_id) AS id, CAST(count(*) AS DOUBLE) AS posts, CAST(count(DISTINCT lang) AS DOUBLE) AS updates, least(CAST(count(*) AS DOUBLE) / 10, 1.0) AS importance, CAST(max(priority) AS DOUBLE) AS priority,
    CAST(max(now) - max(minute) AS DOUBLE) / 60 AS hours, CAST(max(now) - min(minute) AS DOUBLE) / 60 AS age
  FROM posts p CROSS JOIN (SELECT max(minute) AS now FROM posts) n JOIN sources s ON s.source_id = p.source_id GROUP BY p.source_id, day) g) h WHERE signals > 0)"""

ORACLE: dict[str, str] = {
    "post_fingerprints": f"SELECT post_id, CASE WHEN {_TITLE} = '' THEN '' ELSE sha256({_TITLE}) END AS title_hash, sha256({_TITLE} || chr(10) || {_CONTENT}) AS content_hash FROM posts",
    "post_briefs": f"""SELECT post_id, CASE WHEN regexp_matches({_SHORT}, '[.!?]$') THEN {_SHORT} ELSE {_SHORT} || '.' END AS brief, substr(trim(title), 1, 120) AS topic,
  CAST(greatest(1, floor(length(content) / 4)) AS INT) AS tokens FROM posts""",
    "page_hosts": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages",
    "similar_topics": """SELECT probe, id, similarity FROM (SELECT a.vec_id AS probe, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.3) x WHERE rn <= 10""",
    "topic_storage": """SELECT topic, CASE WHEN topic = -1 THEN 'Outliers' ELSE 'Topic ' || topic END AS title, topic = -1 AS is_outlier, CAST(count(DISTINCT doc_id) AS INT) AS post_count
  FROM (SELECT doc_id, quality - toxic AS topic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) x GROUP BY topic""",
    "inbox_posts": f"WITH {_SCORED_POSTS} SELECT id, score, novelty FROM scored_posts WHERE score >= 25",
    "inbox_stories": f"WITH {_SCORED_STORIES} SELECT id, score, novelty FROM scored_stories WHERE score >= 30",
    "inbox_rebuild": f"""WITH {_SCORED_POSTS}, {_SCORED_STORIES},
items AS (SELECT 'story' AS target_type, id AS target_id, score, novelty FROM scored_stories WHERE score >= 30 UNION ALL SELECT 'post', id, score, novelty FROM scored_posts WHERE score >= 25)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, novelty DESC, CASE WHEN target_type = 'story' THEN 0 ELSE 1 END, target_id) AS INT) AS position FROM items) x WHERE position <= 100""",
    "cluster_canonical": "SELECT post_id, min(post_id) OVER (PARTITION BY content) AS canonical, count(*) OVER (PARTITION BY content) AS size FROM posts",
    "nearby_posts": """SELECT post_id, other, gap FROM (SELECT a.post_id, b.post_id AS other, abs(a.minute - b.minute) AS gap, row_number() OVER (PARTITION BY a.post_id ORDER BY abs(a.minute - b.minute), b.post_id) AS rn
  FROM posts a JOIN posts b ON b.source_id = a.source_id AND b.lang = a.lang AND b.post_id <> a.post_id AND abs(a.minute - b.minute) <= 43200) x WHERE rn <= 120""",
    "queue_position": "SELECT post_id, CAST(row_number() OVER (ORDER BY length(title) DESC, minute DESC, post_id) AS INT) AS position FROM posts WHERE minute >= (SELECT max(minute) FROM posts) - 10080",
    "posts_in_caller_order": "SELECT o.ord, p.post_id, p.source_id FROM (SELECT doc_id AS post_id, row_number() OVER (ORDER BY doc_id DESC) AS ord FROM labels) o JOIN posts p ON p.post_id = o.post_id",
    "post_tags": """SELECT post_id, array_to_string(list_filter(['rss', CASE WHEN regexp_matches(t, 'ai|llm|model|agent|openai|gemini|claude') THEN 'ai' END, CASE WHEN regexp_matches(t, 'paper|research|study|benchmark') THEN 'research' END,
  CASE WHEN regexp_matches(t, 'video|youtube|watch') THEN 'video' END, CASE WHEN regexp_matches(t, 'policy|law|regulation|government') THEN 'policy' END, CASE WHEN regexp_matches(t, 'code|coding|programming|dev') THEN 'coding' END,
  CASE WHEN regexp_matches(t, 'server|infra|deployment|docker|kubernetes') THEN 'infrastructure' END], lambda x: x IS NOT NULL)[1:5], ',') AS tags FROM (SELECT post_id, lower(title || ' ' || content) AS t FROM posts) x""",
    "daily_briefings": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY minute DESC, post_id DESC) AS rn, CASE WHEN trim(title) = '' THEN '' WHEN regexp_matches({_SHORT}, '[.!?]$') THEN {_SHORT} ELSE {_SHORT} || '.' END AS brief, substr(trim(title), 1, 120) AS topic FROM posts),
s AS (SELECT day, source_id, min(rn) AS first FROM p GROUP BY day, source_id), n AS (SELECT day, string_agg(source_id, ', ' ORDER BY first) AS names FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first) AS place FROM s) x WHERE place <= 3 GROUP BY day)
SELECT CAST(p.day AS VARCHAR) AS day, '## Executive Summary' || chr(10) || '- ' || count(*) || ' posts collected across ' || count(DISTINCT source_id) || ' sources: ' || any_value(names) || '. Most recent activity came from ' || arg_min(source_id, rn) || '.'
  || chr(10) || chr(10) || '## Main Developments' || chr(10) || string_agg(CASE WHEN rn <= 5 THEN '- ' || source_id || ': ' || brief END, chr(10) ORDER BY rn)
  || chr(10) || chr(10) || '## Signals To Watch' || chr(10) || string_agg(CASE WHEN rn <= 3 THEN '- Watch for follow-up from ' || source_id || ' on ' || topic || '.' END, chr(10) ORDER BY rn) AS content FROM p JOIN n ON n.day = p.day GROUP BY p.day""",
    "post_highlights": r"""WITH f AS (SELECT post_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM posts),
s AS (SELECT post_id, list_filter(string_split(regexp_replace(flat, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:5] AS s FROM f),
p AS (SELECT post_id, unnest(range(1, len(s) + 1)) AS i, s FROM s)
SELECT post_id, CAST(i AS INT) AS position, s[i] AS text, CAST(round(greatest(0.1, 1 - (i - 1) * 0.15), 2) AS DOUBLE) AS importance, CASE WHEN i = 1 THEN 'evidence' ELSE 'detail' END AS kind FROM p""",
    "source_tracks": r"""WITH w AS (SELECT post_id, source_id, min(post_id) OVER (PARTITION BY content) AS cluster, trim(regexp_extract(title, '^(.*?)(\s*[|:]\s*|\s+[-–—]\s+)', 1)) AS prefix,
  list_filter(regexp_extract_all(lower(title), '[a-z0-9]{3,}'), lambda x: x NOT IN ('with', 'from', 'that', 'this', 'about', 'into', 'over', 'after', 'before', 'their', 'there', 'have', 'been')) AS t FROM posts),
k AS (SELECT post_id, source_id, cluster, lower(CASE WHEN prefix <> '' AND len(regexp_split_to_array(prefix, '\s+')) BETWEEN 2 AND 8 THEN prefix ELSE array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:3], ' ') END) AS key FROM w),
c AS (SELECT source_id, key, count(DISTINCT cluster) AS d, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY count(DISTINCT cluster) DESC, count(*) DESC, min(post_id)) AS rn FROM k GROUP BY source_id, key)
SELECT source_id, CASE WHEN rn > 5 OR key = '' THEN 'Other Updates' ELSE key END AS track, CAST(sum(n) AS BIGINT) AS posts, CAST(sum(d) AS BIGINT) AS distinct_posts FROM c GROUP BY ALL""",
    "source_briefings": f"""SELECT CAST(day AS STRING) AS day, source_id, 'Updates from ' || source_id AS title, count(*) AS post_count, string_agg(CASE WHEN rn <= 3 THEN brief END, ' ' ORDER BY rn) AS summary FROM (
  SELECT day, source_id, CASE WHEN regexp_matches({_SHORT}, '[.!?]$') THEN {_SHORT} ELSE {_SHORT} || '.' END AS brief, row_number() OVER (PARTITION BY day, source_id ORDER BY post_id) AS rn FROM posts) x GROUP BY day, source_id""",
    "weekly_topics": """SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS STRING) AS week, 'Updates from ' || source_id AS title, string_agg(DISTINCT CAST(day AS STRING), ', ' ORDER BY CAST(day AS STRING)) AS days, count(*) AS posts
  FROM posts GROUP BY date_trunc('week', day), source_id""",
    "source_profiles": """SELECT source_id, 'lang' AS field, lang AS value, n, CAST(rn AS INT) AS rank FROM (SELECT source_id, lang, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, min(post_id)) AS rn
  FROM posts GROUP BY source_id, lang) x WHERE rn <= 6""",
    "merged_posts": """SELECT source_id, lang, max(minute) AS minute, min(post_id) AS post_id, arg_max(title, post_id) FILTER (WHERE post_id % 3 <> 0) AS title, bool_or(post_id % 7 = 0) AS starred, count(*) AS sessions FROM posts GROUP BY source_id, lang""",
    "comment_tree": "SELECT conv_id * 1000 + turn AS id, CAST(turn AS INT) AS depth FROM conversations",
    "hourly_activity": "SELECT CAST(epoch(date_trunc('hour', happened)) AS BIGINT) AS start_second, kind, count(*) AS n FROM interactions GROUP BY date_trunc('hour', happened), kind",
    "user_sessions": """WITH gaps AS (SELECT user_id, happened, event_id, CASE WHEN happened - lag(happened) OVER (PARTITION BY user_id ORDER BY happened, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM interactions),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY happened, event_id) AS run FROM gaps)
SELECT user_id, CAST(floor(epoch(min(happened))) AS BIGINT) AS start_second, count(*) AS n FROM runs GROUP BY user_id, run""",
}
