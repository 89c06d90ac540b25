"""Sources as column expressions: routing of addresses, limits, rate limits, channels, transcripts, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hosts by strategy.
TELEGRAM = ("telegram.local", "tg.i-c-a.su", "127.0.0.1")
NITTER = ("nitter.local", "nitter.net")
YOUTUBE = ("www.youtube.com", "youtube.com", "m.youtube.com")
REDDIT = ("www.reddit.com", "reddit.com", "old.reddit.com")
#: Local origins of messages, in the order in which they are rewritten.
LOCAL = ("http://127.0.0.1:9504", "http://telegram.local:9504", "https://telegram.local:9504", "http://telegram.local")


def _part(address: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(address, pattern, 1), F.lit(""))


def host_name(address: Column) -> Column:
    """The host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(_part(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"))


def path_of(address: Column) -> Column:
    return _part(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def strategy(platform: Column, address: Column, adapters: dict[str, tuple[tuple[str, ...], str]] | None = None) -> Column:
    """How a source is fetched. adapters: a name with hosts and what paths begin with; the first that matches wins."""
    host, path = host_name(address), path_of(address)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    out = (
        F.when(platform == "reddit", "reddit_subreddit")
        .when(platform == "youtube", "youtube_channel")
        .when(host.isin(*TELEGRAM) & (F.size(segments) >= 2) & (F.get(segments, F.lit(0)) == "rss"), "telegram_rss")
        .when(host.isin(*NITTER) & (F.size(segments) >= 2) & (F.get(segments, F.lit(1)) == "rss"), "nitter_rss")
        .when(host.isin(*YOUTUBE) & (path == "/feeds/videos.xml"), "youtube_channel")
        .when(host.isin(*REDDIT) & path.contains("/r/"), "reddit_subreddit")
        .otherwise("generic_rss")
    )
    for name, (hosts, prefix) in reversed(list((adapters or {}).items())):
        out = F.when(host.isin(*hosts) & path.startswith(prefix), name).otherwise(out)
    return out


def limit_mode(limit: Column) -> Column:
    """struct<mode, value> of a limit as text: n newest, from message n (negative), or all ('-all'); null where it is no limit."""
    number = F.when(limit.rlike(r"^[+-]?\d{1,18}$"), limit.try_cast("long"))
    mode = F.when(limit == "-all", "all").when(number > 0, "recent").when(number < 0, "from_id")
    return F.when(mode.isNotNull(), F.struct(mode.alias("mode"), F.when(mode == "all", F.lit(0)).otherwise(F.abs(number)).cast("long").alias("value")))


def rate_limit(defaults: dict[str, int], stored: Column, override: Column) -> Column:
    """The defaults with known, non-null values of stored and then override (maps), none below 0, a batch of 1 at least."""
    values = []
    for name, default in defaults.items():
        value = F.greatest(F.coalesce(F.try_element_at(override, F.lit(name)), F.try_element_at(stored, F.lit(name)), F.lit(default)).cast("int"), F.lit(1 if name == "batch_size" else 0))
        values.append(value.alias(name))
    return F.struct(*values)


def archive_plan(requested: Column, available: Column, per_page: Column, delay: Column, batch: Column, cooldown: Column) -> Column:
    """struct<posts, pages, seconds>: a second a page, a delay between pages, a cooldown in its place after each batch."""
    posts = F.greatest(F.least(F.coalesce(requested, available), F.coalesce(available, requested)), F.lit(0))
    pages = F.ceil(posts / per_page)
    between = F.greatest(pages - 1, F.lit(0))
    pauses = F.floor(between / batch)
    return F.struct(posts.alias("posts"), pages.alias("pages"), (pages + (between - pauses) * delay + pauses * cooldown).alias("seconds"))


def channel(reference: Column) -> Column:
    """struct<channel_id, channel_url, rss_url> of a channel's feed address, id, handle, address or name."""
    root = "https://www.youtube.com/"
    feed = reference.contains("youtube.com/feeds/videos.xml")
    from_feed = F.nullif(_part(reference, r"[?&]channel_id=([^&#]+)"), F.lit(""))
    bare = reference.startswith("UC") & (F.length(reference) >= 20)
    known = F.when(feed, from_feed).when(bare, reference)
    url = (
        F.when(known.isNotNull(), F.concat(F.lit(f"{root}channel/"), known))
        .when(reference.startswith("@"), F.concat(F.lit(root), reference))
        .when(reference.contains("youtube.com"), F.regexp_replace(reference, "/+$", ""))
        .otherwise(F.concat(F.lit(f"{root}@"), reference))
    )
    rss = F.when(feed, reference).when(bare, F.concat(F.lit(f"{root}feeds/videos.xml?channel_id="), reference))
    return F.struct(known.alias("channel_id"), F.when(~feed | from_feed.isNotNull(), url).alias("channel_url"), rss.alias("rss_url"))


def transcript(payload: Column, kind: Column) -> Column:
    """The lines of a subtitle file: json3 events, vtt cues, or the texts of timed XML."""
    events = F.from_json(payload, "events array<struct<segs array<struct<utf8 string>>>>")["events"]
    said = F.transform(events, lambda e: F.btrim(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8 string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), F.lit(" \t\r\n")))
    lines = F.transform(F.split(payload, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    cues = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    texts = F.filter(F.transform(F.regexp_extract_all(payload, F.lit(r"<[A-Za-z][^>]*[^/>]?>([^<]*)"), 1), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    wanted = F.when(F.lower(kind) == "json3", F.filter(said, lambda x: x != "")).when(F.lower(kind).isin("ttml", "srv3"), texts).otherwise(cues)
    return F.array_join(F.coalesce(wanted, F.array().cast("array<string>")), "\n")


def best_transcript(tracks: DataFrame, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """tracks (video_id, automatic, language, position, kind, payload): the first with text of each video.

    Those of preferred languages come first, in their order, before automatic ones; then any other.
    """
    rank = F.lit(len(languages))
    for i, name in reversed(list(enumerate(languages))):
        rank = F.when(F.col("language") == name, i).otherwise(rank)
    rows = tracks.select("video_id", "language", "automatic", transcript(F.col("payload"), F.col("kind")).alias("text"), F.struct(rank == len(languages), "automatic", rank.alias("rank"), "position").alias("order"))
    best = rows.where("text <> ''").groupBy("video_id").agg(F.min_by(F.struct("language", "automatic", "text"), "order").alias("b"))
    source = F.concat(F.when(F.col("b.automatic"), "automatic_captions:").otherwise("subtitles:"), "b.language")
    return best.select("video_id", source.alias("source"), F.col("b.text").alias("text"))


def public_address(value: Column, origin: str, base: str) -> Column:
    """Addresses of a local message proxy, wherever they stand in the text, as those of the public origin."""
    for old in (*LOCAL[:3], base, LOCAL[3]):
        value = F.replace(value, F.lit(old), F.lit(origin))
    return value


def compact_text(value: Column, key: str) -> Column:
    most = 600 if key in ("briefing", "summary_markdown", "content", "content_html") else 1200
    return F.when(F.char_length(value) > most, F.concat(F.substring(value, 1, most), F.lit("... [truncated]"))).otherwise(value)


def compact_list(values: Column, key: str) -> Column:
    """struct<items, dropped>: the last 200 events, the first 12 topics, or the first 10 of a list of more than 20."""
    n = F.size(values)
    if key == "events":
        return F.struct(F.slice(values, F.greatest(n - 199, F.lit(1)), F.lit(200)).alias("items"), F.lit(0).alias("dropped"))
    first, most = (12, 12) if key == "topics" else (10, 20)
    return F.struct(F.when(n > most, F.slice(values, 1, first)).otherwise(values).alias("items"), F.when(n > most, n - first).otherwise(0).alias("dropped"))
