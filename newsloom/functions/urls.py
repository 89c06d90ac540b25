"""URL normalisation and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query keys that only track, and names of hosts that are one.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "ref", "ref_src", "spm", "si", "source", "ved")
ALIASES = {
    "m.youtube.com": "youtube.com",
    "music.youtube.com": "youtube.com",
    "www.youtube.com": "youtube.com",
    "youtu.be": "youtube.com",
    "mobile.twitter.com": "x.com",
    "twitter.com": "x.com",
    "www.twitter.com": "x.com",
    "old.reddit.com": "reddit.com",
    "np.reddit.com": "reddit.com",
    "www.reddit.com": "reddit.com",
    "www.github.com": "github.com",
}


def _with_scheme(url: Column) -> Column:
    text = F.trim(url)
    return F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))


def _raw_host(full: Column) -> Column:
    authority = F.regexp_extract(full, r"^[^:]+://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.*(:\d*)?$", ""))


def host(url: Column) -> Column:
    """Lower-case host without www., aliases resolved; null without one."""
    raw = _raw_host(_with_scheme(url))
    known = raw
    for alias, name in ALIASES.items():
        known = F.when(raw == alias, name).otherwise(known)
    return F.nullif(F.regexp_replace(known, r"^www\.", ""), F.lit(""))


def _path(full: Column) -> Column:
    return F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def video_id(url: Column) -> Column:
    """The id of a YouTube video address of any form, or an empty string."""
    full = _with_scheme(url)
    by_query, by_path = F.regexp_extract(full, r"[?&]v=([\w-]+)", 1), F.regexp_extract(_path(full), r"^/(?:shorts|embed|live|v)/([\w-]+)", 1)
    return F.when(host(url) != "youtube.com", "").otherwise(
        F.when(_raw_host(full) == "youtu.be", F.regexp_extract(_path(full), r"^/([\w-]+)", 1)).when(by_query != "", by_query).otherwise(by_path)
    )


def normalize(url: Column) -> Column:
    """An address for comparison: no tracking keys, sorted query, no fragment, default port or trailing slash; null if it has no host."""
    full = _with_scheme(url)
    scheme = F.lower(F.regexp_extract(full, r"^([^:]+)://", 1))
    port = F.regexp_extract(full, r"^[^:]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_replace(_path(full), "/{2,}", "/"), "/$", "")
    query = F.filter(F.split(F.regexp_extract(full, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    kept = F.filter(query, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    joined = F.array_join(F.array_sort(kept), "&")
    plain = F.concat(scheme, F.lit("://"), host(url), shown, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    video = video_id(url)
    return F.when(video != "", F.concat(scheme, F.lit("://youtube.com/watch?v="), video)).otherwise(plain)


def find(text: Column, markup: bool = False) -> Column:
    """Distinct addresses in a text, sorted, without closing punctuation; in markup those of href and src too."""
    value = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(value, F.lit(r"""(?i)(\bhttps?://[^\s<>")']+|\bwww\.[^\s<>")']+)"""), 1)
    if markup:
        found = F.concat(found, F.regexp_extract_all(value, F.lit(r"""(?i)\b(?:href|src)=["']([^"']+)["']"""), 1))
    cleaned = F.transform(found, lambda u: F.regexp_replace(F.trim(u), r"""[.,);\]}>"']+$""", ""))
    return F.array_sort(F.array_distinct(F.transform(cleaned, lambda u: F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))))


def artifact_type(url: Column, platform: Column) -> Column:
    """What an address points to, by host, path and the platform of the post."""
    site, path = F.coalesce(host(url), F.lit("")), _path(_with_scheme(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return (
        F.when(site.isin("youtube.com", "youtu.be"), "video")
        .when(site.isin("arxiv.org", "doi.org", "openreview.net"), "paper")
        .when((site == "github.com") & F.arrays_overlap(segments, F.array(F.lit("issues"), F.lit("pull"))), "issue")
        .when((site == "github.com") & F.array_contains(segments, "releases"), "release_note")
        .when((site == "github.com") & (F.size(segments) >= 2), "repo")
        .when(site == "github.com", "other")
        .when((site == "t.me") | site.contains("telegram") | site.endswith("reddit.com"), "official_post")
        .when(site.rlike(r"substack\.com|medium\.com|blog|news"), "article")
        .when(platform == "youtube", "video")
        .when(platform.isin("telegram", "reddit"), "official_post")
        .when((platform == "rss") | (path != ""), "article")
        .otherwise("other")
    )
