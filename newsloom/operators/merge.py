"""Upserts as associative folds: the union of stored and incoming rows, one row per key. A fold applied twice changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: dict[str, str], order: str = "seq") -> DataFrame:
    """One row per key. rules: column to greatest, least, any, first, latest (not null), overwrite, other (the first that isn't
    'other', else the last), union, map (later entries win), concat, append (lists in order) or add."""
    sides = [t.withColumn("__side", F.lit(i)) for i, t in enumerate((stored, incoming))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)

    def rule(column: str, kind: str) -> Column:
        value, at = F.col(column), F.struct("__side", order)  # what is stored comes before what comes in
        return {
            "greatest": lambda: F.max(value),
            "least": lambda: F.min(value),
            "any": lambda: F.bool_or(value),
            "first": lambda: F.min_by(value, F.struct(value.isNull(), at)),
            "latest": lambda: F.max_by(value, F.struct(value.isNotNull(), at)),
            "overwrite": lambda: F.max_by(value, at),
            "union": lambda: F.array_sort(F.array_distinct(F.flatten(F.collect_list(value)))),
            "other": lambda: F.coalesce(F.min_by(value, F.when(value != "other", at)), F.max_by(value, at)),
            "map": lambda: F.aggregate(
                F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(at.alias("at"), F.map_entries(value).alias("m"))))), lambda x: x["m"]),
                F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                lambda held, more: F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.transform(more, lambda e: e["key"]), k)), F.map_from_entries(more)),
            ),
            "append": lambda: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("v"))))), lambda x: x["v"])),
            "concat": lambda: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v")))), lambda x: x["v"])), "; "),
            "add": lambda: F.sum(value),
            "all": lambda: F.bool_and(value),
        }[kind]().alias(column)

    return both.groupBy(*keys).agg(*[rule(c, k) for c, k in rules.items()], F.max(order).alias(order))


def _rules(**kinds: str) -> dict[str, str]:
    return {column: kind for kind, columns in kinds.items() for column in columns.split()}


#: Rules of the store's tables: key columns and how each other column is merged.
TABLES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "posts": (("url",), _rules(
        first="source_id", latest="external_id published_at title content content_html lang title_original body_original content_hash metadata",
        overwrite="title_pivot summary_pivot language_code language_confidence normalized_url canonical_url url_host title_hash normalization_version media_urls categories")),
    "artifacts": (("normalized_url",), _rules(other="artifact_type", latest="url_host display_title", overwrite="canonical_url status", map="metadata")),
    "post_artifacts": (("post_id", "artifact_id", "relation_type"), _rules(greatest="confidence", any="is_primary", map="metadata")),
    "post_relations": (("from_id", "to_id", "relation_type"), _rules(overwrite="method", greatest="confidence", latest="job_run_id", map="metadata")),
    "entity_mentions": (("post_id", "mention_text", "normalized_mention", "entity_type_predicted", "role", "char_start", "char_end"), _rules(latest="language_code", greatest="extractor_confidence", overwrite="extractor_name extractor_version", map="metadata")),
    "source_profiles": (("source_id",), _rules(latest="language_code publisher_type country_code reliability_notes", overwrite="is_primary_reporter")),
    "entity_aliases": (("entity_id", "normalized_alias"), _rules(latest="alias language_code script alias_type transliteration source_hint")),
    "mention_candidates": (("mention_id", "entity_id", "candidate_method"), _rules(greatest="score", any="selected", overwrite="resolver_version")),
    "post_entities": (("post_id", "entity_id", "mention_id"), _rules(overwrite="resolution_status", greatest="confidence", latest="role", map="metadata")),
    "events": (("event_key",), _rules(overwrite="title event_type status", first="occurred_at first_seen_at", greatest="last_seen_at confidence")),
    "event_evidence": (("event_id", "post_id"), _rules(overwrite="stance extractor_version", latest="evidence_snippet", greatest="confidence")),
    "event_entities": (("event_id", "entity_id", "role"), {}),
    "story_posts": (("story_id", "post_id"), _rules(overwrite="role added_by_method", greatest="relevance_score anchor_score evidence_weight", any="is_anchor_candidate", map="metadata")),
    "story_update_posts": (("update_id", "post_id"), _rules(overwrite="role")),
    "inbox_items": (("batch_id", "target_type", "target_id"), _rules(greatest="priority_score novelty_score", concat="reason_summary", append="reasons", least="surfaced_at")),
    "briefings": (("kind", "day"), _rules(overwrite="content payload")),
    "topic_posts": (("topic_id", "post_id"), {}),
    "topic_connections": (("source_topic_id", "target_topic_id"), _rules(first="similarity_score")),
    "watch": (("video_id",), _rules(overwrite="progress", add="sessions", latest="notes")),
    "notes": (("post_id",), _rules(overwrite="notes")),
    "summaries": (("post_id",), _rules(overwrite="summary")),
    "settings": (("name",), _rules(overwrite="value")),
}


def upsert(table: str, stored: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """stored with incoming merged by the rules of a table; columns that neither has are left out.

    A relation of a post with itself is rejected. first_write says whether a key came with incoming rows only.
    """
    keys, rules = TABLES[table]
    both = {*stored.columns, *incoming.columns}
    marked = [t.withColumn("first_write", F.lit(new)) for t, new in ((stored, False), (incoming, True))]
    if table == "post_relations":
        marked = [t.where("from_id <> to_id") for t in marked]
    out = fold(*marked, keys, {c: k for c, k in rules.items() if c in both} | {"first_write": "all"}, order)
    return out


def supersede(batches: DataFrame, scope: Sequence[str] = ("scope_type", "scope_value", "day"), state: str = "status") -> DataFrame:
    """batches (batch_id, created, status, scope) where of each scope only the newest ready one stays ready; null is a scope, too."""
    newest = batches.where(F.col(state) == "ready").groupBy(*[F.col(c).alias(f"__{c}") for c in scope]).agg(F.max(F.struct("created", "batch_id")).alias("__newest"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in scope]
    joined = batches.join(newest, on=[c for c in same], how="left")
    old = (F.col(state) == "ready") & (F.struct("created", "batch_id") != F.col("__newest"))
    return joined.select(*[F.when(old, "superseded").otherwise(F.col(state)).alias(state) if c == state else c for c in batches.columns])


#: The state of an inbox item after an action.
ACTION_STATES = {"accept": "accepted", "reject_noise": "rejected_noise", "save": "saved", "snooze": "snoozed", "block_source": "blocked_source"}


def act(items: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (item_id, source_id, status) after their last known action (item_id, action, at, seq), and (source_id, enabled) of sources
    that actions block."""
    to_state = F.create_map(*[F.lit(x) for kv in ACTION_STATES.items() for x in kv])
    known = actions.where(F.col("action").isin(*ACTION_STATES)).join(items.select("item_id", "source_id"), "item_id")
    last = known.groupBy("item_id").agg(F.max_by("action", F.struct("at", "seq")).alias("last_action"))
    after = items.join(last, "item_id", "left").withColumn("status", F.coalesce(to_state[F.col("last_action")], "status"))
    blocked = known.where("action = 'block_source' AND source_id IS NOT NULL").select("source_id", F.lit(False).alias("enabled")).distinct()
    return after, blocked


def move(assigned: DataFrame, moves: DataFrame) -> DataFrame:
    """assigned (topic_id, post_id) after moves (post_id, from_topic, to_topic), one a post; a post that isn't in from_topic stays where it is."""
    real = moves.join(assigned.select(F.col("topic_id").alias("from_topic"), "post_id"), ["from_topic", "post_id"], "left_semi")
    gone = real.select(F.col("from_topic").alias("topic_id"), "post_id")
    return assigned.join(gone, ["topic_id", "post_id"], "left_anti").unionByName(real.select(F.col("to_topic").alias("topic_id"), "post_id")).distinct()


def outliers(topics: DataFrame, days: DataFrame, title: str = "Uncategorized Posts") -> DataFrame:
    """topics (topic_id, day, title, is_outlier) with an outlier topic for each of days (day); found ones stay, new ones are made."""
    missing = days.select("day").distinct().join(topics.where("is_outlier").select("day"), "day", "left_anti")
    made = missing.select(F.concat(F.lit("outlier-"), F.col("day").cast("string")).alias("topic_id"), "day", F.lit(title).alias("title"), F.lit(True).alias("is_outlier"))
    return topics.unionByName(made)


def patched(table: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """table with column replaced where changes (keys, column) has a row; rows that table hasn't are ignored."""
    new = changes.select(*keys, F.col(column).alias("__new"), F.lit(True).alias("__has"))
    joined = table.join(new, list(keys), "left")
    return joined.select(*[F.when(F.col("__has"), F.col("__new")).otherwise(F.col(c)).alias(c) if c == column else c for c in table.columns])


def appended(log: DataFrame, incoming: DataFrame, keys: Sequence[str] = (), most: int | None = None, order: str = "seq") -> DataFrame:
    """A log with incoming rows after its own; of each key the last `most`."""
    both = log.unionByName(incoming)
    if most is None:
        return both
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return both.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """The children (table, its column, the parents' column) whose parent is there; without a parent (null) they stay."""
    return {
        name: table.join(parents.select(F.col(key).alias("__parent")).distinct(), F.col(column) == F.col("__parent"), "left").where(F.col("__parent").isNotNull() | F.col(column).isNull()).drop("__parent")
        for name, (table, column, key) in children.items()
    }


def replace_group(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete and insert: the incoming rows of a key take the place of all its stored ones."""
    return stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def sync(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], flag: str, mirror: bool = True) -> DataFrame:
    """keys with the action that makes stored like wanted: add, toggle, delete (if mirror) or keep."""
    a, b = stored.select(*keys, F.col(flag).alias("__was")), wanted.select(*keys, F.col(flag).alias("__want"))
    action = F.when(F.col("__was").isNull(), "add").when(F.col("__want").isNull(), "delete" if mirror else "keep").when(F.col("__was") != F.col("__want"), "toggle").otherwise("keep")
    return a.join(b, list(keys), "full_outer").select(*keys, action.alias("action"))
