"""Parsers of fetched documents to unified posts: feeds, listings, comment trees, pages and sitemaps, as column expressions.

Fetching is left to whoever brings the documents; every parser takes a table with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..operators.ranking import checkpoints


def _tag(item: Column, name: str) -> Column:
    """The content of an element's first occurrence, without CDATA marks; null if there is none."""
    inner = F.regexp_extract(item, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))


def date_of(value: Column) -> Column:
    """RFC 2822 or ISO 8601 time; null if it is neither."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000"), r"^(\d)\s", "0$1 ")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare))


def feed(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS 2.0 and Atom: feed_url, url, guid, title, content, content_html, published_at, media_urls, categories; newest first, undated last."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1)
    rows = documents.select("feed_url", F.explode(items).alias("i"))
    i = F.col("i")
    link = F.coalesce(_tag(i, "link"), F.nullif(F.regexp_extract(i, r"""<link[^>]*href=["']([^"']+)""", 1), F.lit("")))
    html = F.coalesce(_tag(i, "content:encoded"), _tag(i, "content"), _tag(i, "description"), _tag(i, "summary"))
    plain = text.unescape(F.coalesce(html, F.lit("")))
    media = F.concat(
        F.regexp_extract_all(i, F.lit(r"""<(?:enclosure|media:content|media:thumbnail)[^>]*url=["']([^"']+)"""), 1),
        F.regexp_extract_all(plain, F.lit(r"""<img[^>]*src=["']([^"']+)"""), 1),
    )
    labels = F.concat(F.regexp_extract_all(i, F.lit(r"""<category[^>]*term=["']([^"']+)"""), 1), F.regexp_extract_all(i, F.lit(r"(?s)<category[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</category>"), 1))
    found = rows.select(
        "feed_url",
        text.unescape(link).alias("url"),
        F.coalesce(_tag(i, "guid"), _tag(i, "id")).alias("guid"),
        text.strip_html(_tag(i, "title")).alias("title"),
        text.strip_html(html).alias("content"),
        html.alias("content_html"),
        date_of(F.coalesce(_tag(i, "pubDate"), _tag(i, "published"), _tag(i, "updated"), _tag(i, "dc:date"))).alias("published_at"),
        F.array_distinct(media).alias("media_urls"),
        F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda c: F.trim(c)), lambda c: c != ""))).alias("categories"),
    )
    return found.orderBy(F.col("published_at").desc_nulls_last(), "url")


def rss_post(items: DataFrame, priority: int | None = None) -> DataFrame:
    """Items of feed() as unified posts: kind of feed, categories with the feed's own, a date (now if there is none), metadata."""
    kind = F.when(F.lower("feed_url").contains("atom"), "atom").otherwise("rss")
    when = F.coalesce("published_at", F.current_timestamp())
    said = F.coalesce(F.nullif("content", F.lit("")), F.nullif("title", F.lit("")), F.lit(""))
    labels = F.array_sort(F.array_distinct(F.transform("categories", lambda c: F.lower(c))))
    meta = F.create_map(F.lit("feed_type"), kind, F.lit("guid"), F.coalesce("guid", "url"), F.lit("undated"), F.col("published_at").isNull().cast("string"))
    return items.select(F.lit("rss").alias("platform"), F.col("feed_url").alias("source"), "url", "title", said.alias("content"), "content_html", when.alias("date"), "media_urls", labels.alias("categories"), meta.alias("metadata"))


def timeframe(items: DataFrame, days: int, most: int = 100, now: Column | None = None) -> DataFrame:
    """Of each feed the `most` newest posts (feed_url, published_at, url) of the last `days` (0: all), oldest first."""
    now = F.current_timestamp() if now is None else now
    rank = F.row_number().over(Window.partitionBy("feed_url").orderBy(F.col("published_at").desc_nulls_last(), "url"))
    rows = items.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
    if days:
        rows = rows.where(F.col("published_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.orderBy(F.col("published_at").asc_nulls_first(), "url")


def telegram(posts: DataFrame) -> DataFrame:
    """Posts with a canonical message address, without sponsored ones, with external_id."""
    number = F.regexp_extract("url", r"^https?://t\.me/\w+/(\d+)$", 1)
    return posts.where(number != "").where(~F.col("title").startswith("[Sponsored]")).withColumn("external_id", number)


def status_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit(""))


def albums(messages: DataFrame) -> DataFrame:
    """Messages (message_id, grouped_id, text, media) as posts: one per album; its last text leads, albums without text go."""
    said = F.nullif(F.trim("text"), F.lit(""))
    out = messages.groupBy(F.coalesce("grouped_id", "message_id").alias("group")).agg(
        F.max_by(F.when(said.isNotNull(), F.col("text")), F.when(said.isNotNull(), F.col("message_id"))).alias("content"),
        F.max(F.when(said.isNotNull(), F.col("message_id"))).alias("message_id"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("media").isNotNull(), F.struct("message_id", "media")))), lambda m: m["media"]).alias("media_urls"),
    )
    return out.where("content IS NOT NULL").select("message_id", "content", "media_urls")


def listing(documents: DataFrame, json: str = "json") -> DataFrame:
    """Reddit listings: url, title, content, categories, external_id, published_at of its submissions."""
    schema = "data struct<children array<struct<kind string, data struct<id string, title string, selftext string, permalink string, subreddit string, link_flair_text string, created_utc double>>>>"
    rows = documents.select(F.explode(F.from_json(json, schema)["data"]["children"]).alias("c")).where("c.kind = 't3'").select("c.data.*")
    return rows.select(
        F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"),
        "title",
        F.coalesce(F.nullif("selftext", F.lit("")), "title").alias("content"),
        F.filter(F.array("subreddit", "link_flair_text"), lambda c: c.isNotNull() & (c != "")).alias("categories"),
        F.col("id").alias("external_id"),
        F.timestamp_seconds("created_utc").alias("published_at"),
    )


def flatten_comments(comments: DataFrame, limit: int | None = None, max_depth: int | None = None, descend_deleted: bool = False, authors: bool = False) -> DataFrame:
    """comments (id, parent_id, position, body) depth first as (id, depth, path): one join per level, as long as there is one.

    Deleted and removed ones go, with their replies unless descend_deleted; with authors, those without one (author) go as well,
    and their replies stay. max_depth: replies below it go.
    """
    checkpoints(comments.sparkSession)
    gone = F.trim(F.coalesce("body", F.lit(""))).isin("[deleted]", "[removed]", "")
    hidden = gone | F.coalesce(F.trim("author"), F.lit("")).isin("", "[deleted]") if authors else gone
    rows = comments.select("id", "parent_id", "body", gone.alias("gone"), hidden.alias("hidden"), F.format_string("%08d", F.col("position")).alias("key"))
    level = rows.where("parent_id IS NULL").select("id", "body", "gone", "hidden", F.lit(0).alias("depth"), F.col("key").alias("path")).checkpoint()
    out, depth = level, 0
    while depth != max_depth and not level.isEmpty():
        depth += 1
        parents = (level if descend_deleted else level.where("NOT gone")).select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = rows.join(parents, "parent_id").select("id", "body", "gone", "hidden", F.lit(depth).alias("depth"), F.concat("above", F.lit("/"), "key").alias("path")).checkpoint()
        out = out.unionByName(level)
    out = out.where("NOT hidden").drop("gone", "hidden").orderBy("path")
    return out if limit is None else out.limit(limit)


def video_key(value: Column) -> Column:
    """The id of a video from an address or the id itself."""
    found = F.regexp_extract(value, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/|/live/)([\w-]{11})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(F.regexp_extract(value, r"^([\w-]{11})$", 1), F.lit("")))


def subtitles(value: Column) -> Column:
    """Plain text of VTT or timed XML subtitles; repeated lines once."""
    lines = F.transform(F.split(F.regexp_replace(text.unescape(value), "<[^>]+>", "\n"), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE|\d+$)|-->"))
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1))), " ")


def sitemap(documents: DataFrame, hosts: tuple[str, ...] = (), skip: str = r"\.(?:pdf|png|jpe?g|gif|svg|mp3|mp4|zip|css|js|xml)$", xml: str = "xml") -> DataFrame:
    """Distinct page addresses of sitemaps, sorted, without files."""
    urls = documents.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url"))
    keep = ~F.col("url").rlike(skip) & ~F.col("url").rlike(r"/[^/]*\.[^/]*$|\?")
    if hosts:
        keep = keep & F.regexp_extract("url", r"://([^/]+)", 1).isin(*hosts)
    return urls.where(keep).distinct().orderBy("url")


def page_post(pages: DataFrame) -> DataFrame:
    """Article pages (url, html): title, content and categories by cascades of meta elements."""
    meta = lambda n: F.nullif(F.regexp_extract("html", rf"""(?i)<meta[^>]*(?:name|property)=["']{n}["'][^>]*content=["']([^"']*)""", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    body = F.nullif(main_text(F.col("html")), F.lit(""))
    return pages.select(
        "url",
        text.unescape(F.coalesce(meta("citation_title"), meta("title"), title, F.col("url"))).alias("title"),
        F.coalesce(body, meta("description"), F.lit("")).alias("content"),
        date_of(F.coalesce(meta("citation_publication_date"), meta("article:published_time"), meta("date"))).alias("published_at"),
        F.filter(F.transform(F.split(F.coalesce(meta("keywords"), F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "").alias("categories"),
    )


def main_text(html: Column) -> Column:
    """Headings, paragraphs, quotes and list items of the article, main or body element, as lines."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe|svg)\b.*?</\1>", " ")
    region = F.coalesce(*[F.nullif(F.regexp_extract(bare, rf"(?is)<{n}\b[^>]*>(.*)</{n}>", 1), F.lit("")) for n in ("article", "main", "body")], bare)
    parts = F.regexp_extract_all(region, F.lit(r"(?is)<(?:h[1-3]|p|blockquote|li)\b[^>]*>(.*?)(?=</?(?:h[1-3]|p|blockquote|li)\b|$)"), 1)
    return F.array_join(F.filter(F.transform(parts, lambda p: text.strip_html(p)), lambda p: p != ""), "\n")


def expand_body(posts: DataFrame, pages: DataFrame, enough: int = 1400, gain: int = 250, least: int = 700) -> DataFrame:
    """posts (url, content) whose short content is replaced by that of their page if it is much longer."""
    full = pages.select("url", main_text(F.col("html")).alias("__full"))
    size = F.char_length(F.coalesce("content", F.lit("")))
    take = (size < enough) & (F.char_length("__full") > F.greatest(size + gain, F.lit(least)))
    return posts.join(full, "url", "left").withColumn("content", F.when(F.coalesce(take, F.lit(False)), F.col("__full")).otherwise(F.col("content"))).drop("__full")


def configured(spark, path: str) -> DataFrame:
    """A source configuration file as rows: platform, handle_or_url, enabled."""
    schema = "platforms map<string, struct<enabled boolean, sources array<struct<id string, state string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("platforms").alias("platform", "p"))
    return rows.select("platform", F.col("p.enabled").alias("on"), F.explode("p.sources").alias("s")).select("platform", F.col("s.id").alias("handle_or_url"), (F.col("on") & (F.col("s.state") == "enabled")).alias("enabled"))
