"""Entity resolution and event memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import entities, events, text


def mentions(posts: DataFrame) -> DataFrame:
    """post_id, published_at, role (title or body) and each mention of it."""
    parts = F.explode(F.array(F.struct(F.lit("title").alias("role"), F.col("title").alias("text")), F.struct(F.lit("body").alias("role"), F.col("content").alias("text"))))
    rows = posts.select("post_id", "published_at", parts.alias("p")).select("post_id", "published_at", "p.*").where("text <> ''")
    return rows.select("post_id", "published_at", "role", F.explode(entities.mentions("text", "role")).alias("m")).select("post_id", "published_at", "role", "m.*")


def resolve(found: DataFrame, known: DataFrame) -> DataFrame:
    """post_id, role, start, name, entity_type, state, entity_id, confidence of mentions against known entities (entity_id, name,
    entity_type). Names match within a type.

    One known entity of the name and type: resolved. Several: for review. None: the first mention makes a provisional entity, later
    ones, by time, post and place, resolve to it.
    """
    key = ["name", "entity_type"]
    held = known.groupBy(*key).agg(F.count("*").alias("known"), F.min("entity_id").alias("entity_id"))
    rows = found.join(held, key, "left")
    place = F.struct("published_at", "post_id", F.col("role") == "body", "start")
    heads = rows.groupBy(*key).agg(F.min(place).alias("head"))
    rows = rows.join(heads, key)
    first = place == F.col("head")
    n = F.coalesce("known", F.lit(0))
    state = F.when(n == 1, "resolved").when(n > 1, "needs_review").when(first, "provisional").otherwise("resolved")
    sure = F.when(n > 1, 0.0).when((n == 0) & first, F.greatest(F.lit(0.55), F.col("confidence") - 0.1)).otherwise(F.greatest(F.lit(0.92), F.col("confidence")))
    made = F.substring(F.sha2(F.concat_ws(":", "entity_type", "name"), 256), 1, 16)
    return rows.select("post_id", "role", "start", *key, state.alias("state"), F.when(n == 1, F.col("entity_id")).when(n == 0, made).alias("entity_id"), F.round(sure, 3).alias("confidence"))


def event_memory(posts: DataFrame) -> DataFrame:
    """post_id, event_type, key, confidence, stance: the best event of each post that has one."""
    ready = posts.select("post_id", "title", "content", text.normalize(F.col("title")).alias("head"), text.normalize(F.col("content")).alias("rest"))
    rows = ready.withColumn("e", events.best_event(F.col("head"), F.col("rest"))).where("e IS NOT NULL")
    key = F.sha2(events.event_key(F.col("e.event_type"), F.col("title"), F.col("content")), 256)
    return rows.select("post_id", F.col("e.event_type").alias("event_type"), key.alias("key"), (-F.col("e.less")).alias("confidence"), F.when(-F.col("e.less") >= 0.75, "supports").otherwise("mentions").alias("stance"))


def roles(linked: DataFrame, names: tuple[str, ...] = ("subject", "object", "participant")) -> DataFrame:
    """linked (post_id, entity_id, start) with role, by the order of first mention."""
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("start", "entity_id"))
    first = linked.groupBy("post_id", "entity_id").agg(F.min("start").alias("start"))
    return first.withColumn("role", F.element_at(F.array(*map(F.lit, names)), F.least(place, F.lit(len(names)))))
