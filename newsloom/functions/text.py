"""Text functions as column expressions."""

from __future__ import annotations

import json
import re
from html import entities

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Named character references, of the standard library's table, and characters whose folded form isn't their lower-case one.
_NAMED = json.dumps({f"&{name}": value for name, value in entities.html5.items() if name.endswith(";")})
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c.lower() and c != "\u0130"}
_REFERENCE = r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"


def _decoded(reference: Column) -> Column:
    """The character of a reference; itself if there is none."""
    digits = F.regexp_extract(reference, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("long")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), reference)
    return F.when(reference.startswith("&#"), F.when(valid, char).otherwise("\ufffd")).otherwise(F.coalesce(named, reference))


def unescape(text: Column) -> Column:
    """Character references with a semicolon decoded, once: those that give & come last."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), 1)), lambda r: F.struct((_decoded(r) == "&").alias("last"), r.alias("r"), _decoded(r).alias("c")))
    return F.when(text.rlike(_REFERENCE), F.aggregate(F.array_sort(found), text, lambda t, x: F.replace(t, x["r"], x["c"]))).otherwise(text)


def casefold(text: Column) -> Column:
    """Lower case, with the characters folded that lower case leaves: \u00df is ss."""
    low = F.lower(text)
    table = F.map_entries(F.from_json(F.lit(json.dumps(_FOLDED)), "map<string,string>"))
    marks = "".join(_FOLDED)
    return F.when(low.rlike(f"[{marks}]"), F.aggregate(table, low, lambda t, x: F.replace(t, x["key"], x["value"]))).otherwise(low)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(value: Column) -> Column:
    """Plain text of markup; null is empty."""
    return squeeze(F.regexp_replace(unescape(F.coalesce(value, F.lit(""))), "<[^>]+>", " "))


_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_FOUND = re.compile(_REFERENCE)


def _char(reference: str) -> str:
    if not reference.startswith("&#"):
        return entities.html5.get(reference[1:], reference)
    code = int(reference[3:-1], 16) if reference[2] in "xX" else int(reference[2:-1])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _plain(value: str | None) -> str:
    """unescape of a string."""
    value = value or ""
    if "&" in value:
        for _, reference, char in sorted((_char(r) == "&", r, _char(r)) for r in set(_FOUND.findall(value))):
            value = value.replace(reference, char)
    return value


def _normal(value: str | None) -> str:
    return _SPACE.sub(" ", _plain(value)).strip(" ").casefold()


def _normal_markup(value: str | None) -> str:
    return _normal(_SPACE.sub(" ", re.sub("<[^>]+>", " ", _plain(value))).strip(" "))


@F.pandas_udf(T.StringType())
def _normalized(values: pd.Series) -> pd.Series:
    return values.map(_normal)


@F.pandas_udf(T.StringType())
def _normalized_markup(values: pd.Series) -> pd.Series:
    return values.map(_normal_markup)


def normalize(value: Column) -> Column:
    """Decoded, white space collapsed, case folded; null is empty.

    In Arrow batches: as a column expression its text would be worked out anew wherever the optimizer repeats it.
    """
    return _normalized(value)


def hash_text(value: Column) -> Column:
    """SHA-256 of the normalised text; empty for an empty one."""
    text = normalize(value)
    return F.when(text == "", F.lit("")).otherwise(F.sha2(text, 256))


def hash_content(title: Column, content: Column, html: Column) -> Column:
    """SHA-256 of the non-empty normalised parts."""
    parts = F.filter(F.array(normalize(title), normalize(content), _normalized_markup(html)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.sha2(F.array_join(parts, "\n"), 256))


def first_sentence(text: Column, most: int = 280) -> Column:
    """The first sentence, or else the beginning, of at most `most` characters."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(flat, r"^(.+?[.!?])(\s|$)", 1)
    return F.substring(F.trim(F.when(found == "", flat).otherwise(found)), 1, most)


def tokens(text: Column) -> Column:
    """Distinct ASCII words of three characters and more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1)
    stop = F.array(*map(F.lit, STOP))
    return F.array_except(F.array_distinct(found), stop)


#: Words that title comparison leaves out.
STOP = ("with", "from", "that", "this", "about", "into", "over", "after", "before", "their", "there", "have", "been")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def highlights(text: Column, most: int = 5) -> Column:
    """array<struct<position, text, importance, kind>>: the first sentences, the first one as evidence."""
    parts = F.slice(F.filter(F.split(squeeze(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != ""), 1, most)
    return F.transform(
        parts,
        lambda s, i: F.struct(
            (i + 1).alias("position"),
            s.alias("text"),
            F.round(F.greatest(F.lit(0.1), 1 - i * 0.15), 2).alias("importance"),
            F.when(i == 0, "evidence").otherwise("detail").alias("kind"),
        ),
    )


def takeaway(text: Column) -> Column:
    """The first sentence or 220 characters without headings and bullets, ending in a period."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^#+ .*$", ""), r"(?m)^\s*[-*]\s+", "")
    short = first_sentence(body, 220)
    return F.when(short == "", short).when(short.rlike(r"[.!?]$"), short).otherwise(F.concat(short, F.lit(".")))


def tags(values: Column, most: int = 5) -> Column:
    cleaned = F.transform(values, lambda v: F.substring(F.lower(F.trim(v)), 1, 48))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda v: v != "")), 1, most)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def hints(text: Column) -> Column:
    """struct<words, reading_minutes, has_url, has_mention, has_hashtag>."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.struct(
        words.alias("words"),
        F.greatest(F.lit(1.0), words * 0.25 / 60).alias("reading_minutes"),
        F.coalesce(text.rlike("https?://"), F.lit(False)).alias("has_url"),
        F.coalesce(text.rlike(r"@\w+"), F.lit(False)).alias("has_mention"),
        F.coalesce(text.rlike(r"#\w+"), F.lit(False)).alias("has_hashtag"),
    )


def topic_key(title: Column) -> Column:
    """What stands before a bar, colon or dash if it has 2 to 8 words, else the first three key words."""
    prefix = F.trim(F.regexp_extract(title, r"^(.*?)(\s*[|:]\s*|\s+[-–—]\s+)", 1))
    n = F.size(F.split(prefix, r"\s+"))
    return F.when((prefix != "") & n.between(2, 8), prefix).otherwise(F.array_join(F.slice(tokens(title), 1, 3), " "))


def relative_time(hours: Column) -> Column:
    minutes = F.floor(hours * 60)
    return (
        F.when(minutes < 60, F.format_string("%d minutes ago", minutes))
        .when(hours < 48, F.format_string("%d hours ago", F.floor(hours)))
        .otherwise(F.format_string("%d days ago", F.floor(hours / 24)))
    )


def brief(title: Column, content: Column) -> Column:
    """The title, or else the content, in at most 220 characters and closed by a period."""
    head = F.trim(F.coalesce(title, F.lit("")))
    short = F.rtrim(F.substring(F.when(head != "", head).otherwise(squeeze(F.coalesce(content, F.lit("")))), 1, 220))
    return F.when(short == "", "Posted an update.").when(short.rlike(r"[.!?]$"), short).otherwise(F.concat(short, F.lit(".")))


def topic(title: Column, content: Column) -> Column:
    """The title in 120 characters, or else the first ten words."""
    head = F.trim(F.coalesce(title, F.lit("")))
    words = F.filter(F.split(F.coalesce(content, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(head != "", F.substring(head, 1, 120)).when(F.size(words) == 0, "recent posts").otherwise(F.array_join(F.slice(words, 1, 10), " "))


#: Tags with the words that give them.
TAG_WORDS = {
    "ai": ("ai", "llm", "model", "models", "agent", "agents", "openai", "gemini", "claude"),
    "research": ("paper", "research", "study", "benchmark"),
    "video": ("video", "youtube", "watch"),
    "policy": ("policy", "law", "regulation", "government"),
    "coding": ("code", "coding", "programming", "dev", "developer"),
    "infrastructure": ("server", "infra", "deployment", "docker", "kubernetes"),
}


def keyword_tags(platform: Column, title: Column, content: Column) -> Column:
    """The platform and the tags whose words occur, five at most."""
    said = F.lower(F.concat_ws(" ", title, content))
    found = [F.lower(F.trim(F.coalesce(platform, F.lit(""))))]
    for tag, words in TAG_WORDS.items():
        hit = said.contains(words[0])
        for word in words[1:]:
            hit = hit | said.contains(word)
        found.append(F.when(hit, tag).otherwise(""))
    return F.slice(F.array_distinct(F.filter(F.array(*found), lambda t: t != "")), 1, 5)
