"""Story candidates, their scores, and timelines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from . import ranking

#: Methods, the surest first.
METHODS = ("same_normalized_url", "same_canonical_url", "same_content_hash", "same_title_hash", "title_similarity", "summary_similarity")


def pool(posts: DataFrame, days: int = 30, cap: int = 120) -> DataFrame:
    """(post_id, other, gap in seconds) of the `cap` posts nearest in time of the same blocking key, within `days`.

    The nearest are among the `cap` before and the `cap` after in the order of time and id, so a busy key costs no more for each
    post. Every post is dealt to its own stretch of time and, as a neighbour, to the two beside it: a key is split by time. Of
    more than `cap` posts of one moment those next in the order of ids are taken.
    """
    span = days * 86400
    at = posts.where("published_at IS NOT NULL").select("post_id", "blocking", F.unix_seconds("published_at").alias("t"))
    dealt = at.withColumn("k", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("stretch", F.floor(F.col("t") / span) + F.col("k"))
    around = Window.partitionBy("blocking", "stretch").orderBy("t", "post_id").rowsBetween(-cap, cap)
    rows = dealt.withColumn("near", F.collect_list(F.struct("t", "post_id")).over(around)).where("k = 0")
    gap = lambda x: F.abs(x["t"] - F.col("t"))
    close = F.filter("near", lambda x: (x["post_id"] != F.col("post_id")) & (gap(x) <= span))
    first = F.slice(F.array_sort(F.transform(close, lambda x: F.struct(gap(x).alias("gap"), x["post_id"].alias("other")))), 1, cap)
    return rows.select("post_id", F.explode(first).alias("n")).select("post_id", "n.other", "n.gap")


#: What a score stands on. Least shares of common words that count in a score: of titles, of summaries.
SCORED = ("normalized_url", "content_hash", "title_hash", "url_host", "published_at", "title_words", "summary_words", "tag_set")
TITLE_LIKE, SUMMARY_LIKE = 0.45, 0.42


def _ready(posts: DataFrame) -> DataFrame:
    """posts with their words, in place of their texts."""
    extra = {"title_words": text.tokens(F.col("title")), "summary_words": text.tokens(text.first_sentence(F.col("content"))), "tag_set": F.coalesce("tags", F.array().cast("array<string>"))}
    return posts.withColumns(extra)


def candidates(posts: DataFrame, days: int = 30, cap: int = 120) -> DataFrame:
    """score() of pool(): post_id, other, score, method, accepted. A post has one row.

    No score of 0.42 stands without an equal address, content or title or a likeness of words that counts. So the posts are
    worked out once, and the pairs of the pool are looked at where a stretch of a key lies in order of time; only those with
    such a signal are joined with their posts.
    """
    ranking.checkpoints(posts.sparkSession)
    ready = _ready(posts).select("post_id", "blocking", *SCORED).checkpoint()
    return _score(_signals(ready, days, cap), ready)


def _signals(ready: DataFrame, days: int, cap: int) -> DataFrame:
    """(post_id, other) of the pairs of pool() with a signal.

    A stretch is eight times `days`; a post is dealt to its own one, and to one beside it if it is within `days` of that. Rows
    come in order of time, and those of one task are held for `cap` rows before and after only.
    """
    span = days * 86400
    wide = 8 * span
    at = ready.where("published_at IS NOT NULL AND post_id IS NOT NULL").withColumn("t", F.unix_seconds("published_at"))
    stretch = lambda shift: F.floor((F.col("t") + shift) / wide)
    dealt = at.withColumn("own", stretch(0)).withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(-span), stretch(0), stretch(span)))))
    keys = ["blocking", "stretch"]
    shared = ["normalized_url", "content_hash", "title_hash"]
    rows = dealt.select(*keys, "t", "post_id", (F.col("own") == F.col("stretch")).alias("own"), *shared, "title_words", "summary_words")

    def alike(a: set, b: set, least: float) -> bool:
        low, high = sorted((len(a), len(b)))
        if not low or low < least * high - 1e-9:
            return False
        n = len(a & b)
        return n / (low + high - n) >= least

    def pairs(table: pa.Table, first: int, last: int) -> pa.RecordBatch:
        """Pairs of the rows first to last with those around."""
        t, ids, own = (table.column(i).to_numpy() for i in (2, 3, 4))
        own = own & (np.arange(len(t)) >= first) & (np.arange(len(t)) < last)
        group = np.zeros(len(t), np.int64)
        for i in range(2):
            group = np.unique(group * len(t) + _codes(table.column(i)) + 1, return_inverse=True)[1]
        left, right = [], []
        for d in range(1, min(cap, len(t) - 1) + 1):
            x = np.flatnonzero((group[d:] == group[:-d]) & (t[d:] - t[:-d] <= span))
            if not len(x):
                break  # rows are in order, so those farther off aren't near either
            x = x[ids[x] != ids[x + d]]
            left += [x[own[x]], x[own[x + d]] + d]
            right += [x[own[x]] + d, x[own[x + d]]]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        order = np.lexsort((ids[b], np.abs(t[a] - t[b]), a))
        a, b = a[order], b[order]
        near = np.arange(len(a)) - np.searchsorted(a, a) < cap
        a, b = a[near], b[near]
        same = np.zeros(len(a), bool)
        for i in range(5, 8):
            codes = _codes(table.column(i))
            same |= (codes[a] == codes[b]) & (codes[a] >= 0)
        titles, summaries = ([set(x or ()) for x in table.column(i).to_pylist()] for i in (8, 9))
        for k in np.flatnonzero(~same).tolist():
            x, y = a[k], b[k]
            same[k] = alike(titles[x], titles[y], TITLE_LIKE) or alike(summaries[x], summaries[y], SUMMARY_LIKE)
        return pa.RecordBatch.from_arrays([pa.array(ids[a[same]]), pa.array(ids[b[same]])], ["post_id", "other"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, 0  # rows that are still wanted, and the first of them whose pairs are open
        for batch in stream:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            last = held.num_rows - cap
            if last - first >= 2 * cap:
                yield pairs(held, first, last)
                drop = max(0, last - cap)
                held, first = held.slice(drop), last - drop
        if held is not None:
            yield pairs(held, first, held.num_rows)

    kind = ready.schema["post_id"].dataType.simpleString()
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t", "post_id").mapInArrow(run, f"post_id {kind}, other {kind}")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number of each different value; -1 of nulls and empty texts."""
    encoded = column.combine_chunks().dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = [i for i, x in enumerate(encoded.dictionary.to_pylist()) if x == ""]
    return np.where(np.isin(codes, empty), -1, codes)


def score(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, other, score, method, accepted of pairs of 0.42 and more."""
    return _score(pairs, _ready(posts))


def _score(pairs: DataFrame, ready: DataFrame) -> DataFrame:
    side = lambda key, p: ready.select(F.col("post_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in SCORED])
    rows = pairs.select("post_id", "other").join(side("post_id", "a"), "post_id").join(side("other", "b"), "other")
    same = lambda c: F.coalesce((F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != ""), F.lit(False))
    title, summary = (text.jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("title_words", "summary_words"))
    rows = rows.withColumns({"title_like": title, "summary_like": summary})
    zero = F.lit(0.0)
    signals = {
        "same_normalized_url": F.when(same("normalized_url"), 1.0).otherwise(zero),
        "same_content_hash": F.when(same("content_hash"), 0.98).otherwise(zero),
        "same_title_hash": F.when(same("title_hash"), 0.86).otherwise(zero),
        "title_similarity": F.when(F.col("title_like") >= 0.72, 0.74).when(F.col("title_like") >= TITLE_LIKE, 0.52).otherwise(zero),
        "summary_similarity": F.when(F.col("summary_like") >= 0.65, 0.68).when(F.col("summary_like") >= SUMMARY_LIKE, 0.49).otherwise(zero),
    }
    shared = F.size(F.array_intersect("a_tag_set", "b_tag_set"))
    days = F.abs(F.floor((F.unix_seconds("b_published_at") - F.unix_seconds("a_published_at")) / 86400))
    total = F.greatest(*signals.values()) + F.least(0.04 * shared, F.lit(0.12)) + F.when(same("url_host") & (F.col("title_like") >= 0.3), 0.08).otherwise(zero) + F.when(days <= 3, 0.08).when(days <= 10, 0.04).otherwise(zero)
    method = F.lit("title_similarity")
    for name in reversed([m for m in METHODS if m in signals]):
        method = F.when(signals[name] > 0, name).otherwise(method)
    out = rows.select("post_id", "other", F.round(F.least(total, F.lit(1.0)), 4).alias("score"), method.alias("method"), "title_like").where("score >= 0.42")
    hard = F.col("method").isin("same_normalized_url", "same_canonical_url", "same_content_hash")
    return out.withColumn("accepted", hard | ((F.col("score") >= 0.92) & (F.col("title_like") >= 0.72))).drop("title_like")


def split(updates: DataFrame) -> DataFrame:
    """updates (story_id, update_id, day, current) with place: earlier, current or later; without a current one all are earlier."""
    now = F.max(F.when(F.col("current"), F.col("day"))).over(Window.partitionBy("story_id"))
    return updates.withColumn("__now", now).withColumn("place", F.when(F.col("__now").isNull(), "earlier").when(F.col("current"), "current").when(F.col("day") < F.col("__now"), "earlier").otherwise("later")).drop("__now")


#: Decisions about candidates, in the order in which they are listed.
DECISIONS = ("accepted", "proposed", "needs_review", "rejected")


def role_of(method, relation, title, other_title):
    """The part that a candidate plays in a story, by how it was found and whether it is earlier or later."""
    differs = (F.trim(F.lower(F.coalesce(title, F.lit("")))) != "") & (F.trim(F.lower(F.coalesce(other_title, F.lit("")))) != "") & (F.trim(F.lower(title)) != F.trim(F.lower(other_title)))
    return (
        F.when(method.isin("same_canonical_url", "same_normalized_url", "same_content_hash"), "corroboration")
        .when(relation == "later", "follow_up")
        .when(relation == "earlier", "context")
        .when(differs, "commentary")
        .otherwise("context")
    )


def attach(stories: DataFrame, members: DataFrame, updates: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """stories, members and updates after accepted candidates are attached; attaching them again changes nothing.

    stories: story_id, title, first_seen, last_seen. members: story_id, post_id, role, relevance. updates: story_id, day, title,
    importance. accepted: story_id, post_id, title, role, score, published_at. Of a post the last role and the greatest
    relevance stay; a story's window grows; a day without an update gets one, of the best candidate of that day.
    """
    new = accepted.select("story_id", "post_id", "role", F.col("score").alias("relevance"), F.lit(1).alias("seq"))
    both = members.select("story_id", "post_id", "role", "relevance", F.lit(0).alias("seq")).unionByName(new)
    held = both.groupBy("story_id", "post_id").agg(F.max_by("role", F.struct("seq", "relevance")).alias("role"), F.max("relevance").alias("relevance"))
    seen = accepted.groupBy("story_id").agg(F.min("published_at").alias("low"), F.max("published_at").alias("high"))
    window = {"first_seen": F.least("first_seen", "low"), "last_seen": F.greatest("last_seen", "high")}  # nulls are passed over
    grown = stories.join(seen, "story_id", "left").withColumns(window).select(*stories.columns)
    days = accepted.where("published_at IS NOT NULL").select("story_id", F.to_date("published_at").alias("day"), "title", "score", "post_id")
    best = days.groupBy("story_id", "day").agg(F.max_by("title", F.struct("score", -F.col("post_id"))).alias("title"), F.max("score").alias("importance"))
    missing = best.join(updates.select("story_id", "day"), ["story_id", "day"], "left_anti")
    named = missing.join(stories.select("story_id", F.col("title").alias("__story")), "story_id", "left")
    made = named.select("story_id", "day", F.coalesce(F.nullif("title", F.lit("")), "__story", F.lit("Story update")).alias("title"), "importance")
    return grown, held, updates.select("story_id", "day", "title", "importance").unionByName(made)


def detail(stories: DataFrame, members: DataFrame, updates: DataFrame, most: int = 50) -> DataFrame:
    """A card of each story: counts, anchor, posts by role (the most relevant `most` of each) and updates in order.

    members: story_id, post_id, role, relevance, is_anchor. updates: story_id, day, title, importance.
    """
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("context"))
    rank = F.row_number().over(Window.partitionBy("story_id", "role").orderBy(F.col("relevance").desc(), "post_id"))
    ranked = members.withColumn("role", role).withColumn("rank", rank)
    roles = ranked.groupBy("story_id", "role").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "post_id")))).alias("p"))
    roles = roles.groupBy("story_id").agg(F.sum("n").alias("posts"), F.array_sort(F.collect_list(F.struct("role", "n", F.transform("p", lambda x: x["post_id"]).alias("post_ids")))).alias("roles"))
    anchor = members.where("is_anchor").groupBy("story_id").agg(F.max_by("post_id", F.struct("relevance", -F.col("post_id"))).alias("anchor"))
    told = updates.groupBy("story_id").agg(F.count("*").alias("updates"), F.max("day").alias("last_update"), F.array_sort(F.collect_list(F.struct("day", "title", "importance"))).alias("timeline"))
    out = stories.join(roles, "story_id", "left").join(anchor, "story_id", "left").join(told, "story_id", "left")
    return out.withColumns({"posts": F.coalesce("posts", F.lit(0)), "updates": F.coalesce("updates", F.lit(0))})


def candidate_order(candidates: DataFrame) -> DataFrame:
    """candidates (decision, score, published_at, created_at) in the order of a review list."""
    rank = F.lit(len(DECISIONS))
    for i, name in reversed(list(enumerate(DECISIONS))):
        rank = F.when(F.col("decision") == name, i).otherwise(rank)
    return candidates.orderBy(rank, F.col("score").desc(), "published_at", "created_at")
