"""Unified posts as column expressions: dates, time zones, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields that a date is taken from, in this order, and the fields that every post has.
DATES = ("date", "created_at", "published", "timestamp", "time")
REQUIRED = ("platform", "source", "url", "content", "date", "media_urls", "categories", "metadata")


def moment(value: Column) -> Column:
    """The time that a text gives: ISO 8601 with or without zone (then UTC), or seconds since 1970; null if it gives none."""
    text = F.trim(value)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    seconds = F.when(text.rlike(r"^-?\d{1,12}(\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    return F.coalesce(iso, seconds)


def resolve_date(posts: DataFrame, fields: tuple[str, ...] = DATES) -> Column:
    """The time of the first of `fields` that posts has and that can be read; null if there is none."""
    found = [moment(F.col(c).cast("string")) if dict(posts.dtypes)[c] != "timestamp" else F.col(c) for c in fields if c in posts.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp")


def in_zone(at: Column, zone: Column) -> Column:
    """Wall-clock time of a moment in a zone, as text; of an unknown zone the moment in UTC."""
    known = zone.rlike(r"^(?:[A-Za-z]+(?:/[A-Za-z_+-]+)*|[+-]\d{2}:\d{2})$")
    return F.date_format(F.when(known, F.from_utc_timestamp(at, F.when(known, zone).otherwise("UTC"))).otherwise(at), "yyyy-MM-dd HH:mm:ss")


def is_unified(json: Column) -> Column:
    """Whether a post as JSON has all required fields, lists and an object where they are asked for."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    kinds = {"media_urls": "[", "categories": "[", "metadata": "{"}
    out = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) == 0
    for field, mark in kinds.items():
        out = out & F.coalesce(F.get_json_object(json, f"$.{field}").startswith(mark), F.lit(False))
    return out
