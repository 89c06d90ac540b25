"""Evidence enrichment, artifacts, and relations between posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import entities, language, text, urls
from . import graph, ranking

VERSION = "evidence-foundation-v1"
#: Phrases that mark a translated text.
TRANSLATED = ("translated from", "translation", "перевод", "переведено", "traducción", "traduction", "übersetzung", "tradotto")


def enrich(posts: DataFrame) -> DataFrame:
    """posts (title, content, html, url) with language, hashes and normalised addresses."""
    return posts.withColumn("__found", language.detect(F.concat_ws("\n", "title", "content"))).withColumns(
        {
            "language_code": F.col("__found.code"),
            "language_confidence": F.col("__found.confidence"),
            "normalized_url": urls.normalize(F.col("url")),
            "url_host": urls.host(F.col("url")),
            "title_hash": text.hash_text(F.col("title")),
            "content_hash": text.hash_content(F.col("title"), F.col("content"), F.col("html")),
            "normalization_version": F.lit(VERSION),
        }
    ).drop("__found")


def artifacts(posts: DataFrame) -> DataFrame:
    """post_id, normalized_url, artifact_type, confidence, relation_type, is_primary: each address of a post once, first seen first."""
    none = F.array().cast("array<string>")
    places = F.array(
        F.struct(F.lit(0).alias("place"), F.when(F.col("url").isNull(), none).otherwise(F.array("url")).alias("found")),
        F.struct(F.lit(1).alias("place"), urls.find(F.col("title")).alias("found")),
        F.struct(F.lit(2).alias("place"), urls.find(F.col("content")).alias("found")),
        F.struct(F.lit(3).alias("place"), urls.find(F.col("html"), True).alias("found")),
    )
    each = posts.select("post_id", "platform", F.explode(places).alias("p")).select("post_id", "platform", "p.place", F.posexplode("p.found").alias("pos", "address"))
    named = each.select("post_id", "place", "pos", urls.normalize(F.col("address")).alias("normalized_url"), urls.artifact_type(F.col("address"), F.col("platform")).alias("artifact_type")).where("normalized_url IS NOT NULL")
    first = named.groupBy("post_id", "normalized_url").agg(F.min(F.struct("place", "pos", "artifact_type")).alias("f"))
    primary = F.col("f.place") == 0
    confidence = F.when(primary, 0.95).otherwise(0.8) - F.when(F.col("f.artifact_type").isin("article", "official_post"), 0.02).otherwise(0.0)
    return first.select(
        "post_id", "normalized_url", F.col("f.artifact_type").alias("artifact_type"), F.round(confidence, 3).alias("confidence"), F.when(primary, "announces").otherwise("links_to").alias("relation_type"), primary.alias("is_primary")
    )


def candidates(posts: DataFrame, shared: DataFrame, days: int = 7) -> DataFrame:
    """(probe, candidate), all of them: equal address and equal title or content, a shared artifact, or equal host within days.

    Posts of an address that differ in both have no relation by it, nor have posts of a host further apart. Hosts are joined by
    stretches of time, so that a busy one costs a post no more than its posts around.
    """
    probe = posts.select(F.col("post_id").alias("probe"), "normalized_url", F.explode(F.array("content_hash", "title_hash")).alias("mark")).where("mark <> '' AND normalized_url <> ''")
    by_url = probe.join(probe.withColumnRenamed("probe", "candidate"), ["normalized_url", "mark"]).select("probe", "candidate")
    links = shared.select("normalized_url", F.col("post_id").alias("probe"))
    by_artifact = links.join(links.withColumnRenamed("probe", "candidate"), "normalized_url").select("probe", "candidate")
    return by_url.unionByName(by_artifact).where("probe <> candidate").unionByName(same_host(posts, days)).distinct()


def same_host(posts: DataFrame, days: int = 7) -> DataFrame:
    """(probe, candidate) of equal host within days."""
    stretch = F.floor(F.unix_seconds("at") / (days * 86400))
    probe = posts.where("url_host <> '' AND published_at IS NOT NULL").select(F.col("post_id").alias("probe"), "url_host", F.col("published_at").alias("at")).withColumn("stretch", stretch)
    other = probe.select(F.col("probe").alias("candidate"), "url_host", F.col("at").alias("then"), F.explode(F.array(*[F.col("stretch") + k for k in (-1, 0, 1)])).alias("stretch"))
    near = F.abs(F.unix_seconds("then") - F.unix_seconds("at")) <= days * 86400
    return probe.join(other, ["url_host", "stretch"]).where(near & (F.col("probe") != F.col("candidate"))).select("probe", "candidate").distinct()


def stars(shared: DataFrame) -> DataFrame:
    """(a, b): each post of a shared artifact with the least one. Any two of them have a relation, so these connect the same."""
    heads = shared.groupBy("normalized_url").agg(F.min("post_id").alias("b"))
    return shared.join(heads, "normalized_url").select(F.col("post_id").alias("a"), "b").where("a <> b").distinct()


def relations(posts: DataFrame, shared: DataFrame, pairs: DataFrame) -> DataFrame:
    """from_id, to_id, relation_type, confidence of candidate pairs: the first of duplicate, syndication, translation, artifact, near copy.

    Only posts of pairs are looked at, and once. Pairs are joined with digests, lengths of titles and numbers of shared addresses;
    titles go to those whose lengths allow that they are alike, texts, of which 1200 characters are compared, to those whose titles are.
    """
    ranking.checkpoints(posts.sparkSession)
    pairs = pairs.checkpoint()
    ids = pairs.select(F.col("probe").alias("post_id")).unionByName(pairs.select(F.col("candidate").alias("post_id"))).distinct()
    digests = {c: F.when(F.col(c) != "", F.substring(F.unhex(F.sha2(c, 256)), 1, 16)) for c in ("normalized_url", "url_host", "title_hash", "content_hash")}
    whole = text.normalize(F.concat_ws(" ", "title", "content"))
    marked = F.lit(False)
    for phrase in TRANSLATED:
        marked = marked | whole.contains(phrase)
    start = {k: F.substring(text.normalize(F.col(c)), 1, 1200) for k, c in (("head", "title"), ("body", "content"))}
    facts = posts.join(ids, "post_id", "left_semi").select("post_id", *[v.alias(k) for k, v in (digests | start).items()], marked.alias("marked"), "language_code", "published_at").checkpoint()
    numbers = shared.groupBy("normalized_url").agg(F.min("post_id").alias("low"), F.max("post_id").alias("high")).where("low < high").select("normalized_url", F.monotonically_increasing_id().alias("n")).checkpoint()
    links = shared.join(numbers, "normalized_url").groupBy("post_id").agg(F.collect_set("n").alias("links"))
    known = facts.withColumn("head", F.char_length("head")).drop("body").join(links, "post_id", "left")
    a = known.select(F.col("post_id").alias("probe"), *[F.col(c).alias(f"a_{c}") for c in known.columns[1:]])
    b = known.select(F.col("post_id").alias("candidate"), *[F.col(c).alias(f"b_{c}") for c in known.columns[1:] if c != "marked"])
    same = {c: F.col(f"a_{c}") == F.col(f"b_{c}") for c in digests}
    later = F.col("a_published_at") > F.col("b_published_at")
    tongues = (F.col("a_language_code") != F.col("b_language_code")) & (F.col("a_language_code") != "und") & (F.col("b_language_code") != "und")
    near = F.abs(F.unix_seconds("a_published_at") - F.unix_seconds("b_published_at")) <= 7 * 86400

    def found(kind: str, confidence):
        return F.struct(F.lit(kind).alias("kind"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    copy = (
        F.when(same["normalized_url"] & same["content_hash"], found("exact_duplicate", 0.99))
        .when(same["normalized_url"] & same["title_hash"], found("exact_duplicate", 0.97))
        .when(later & same["content_hash"], found("syndicated_from", 0.95))
    )
    rows = pairs.join(a, "probe").join(b, "candidate")
    rows = rows.select(
        "probe", "candidate", copy.alias("copy"), F.coalesce(F.arrays_overlap("a_links", "b_links"), F.lit(False)).alias("artifact"), F.coalesce(near & same["url_host"], F.lit(False)).alias("near"),
        later.alias("later"), tongues.alias("tongues"), "a_marked", (F.col("a_published_at") >= F.col("b_published_at")).alias("from_probe"), "a_head", "b_head",
    )
    open_title = F.col("copy").isNull() & F.coalesce(F.when(F.col("artifact"), F.col("later") | F.col("tongues")).otherwise(F.col("near")), F.lit(False))
    least = F.when(F.col("artifact"), F.lit(0.84)).otherwise(F.lit(0.94))
    fits = (F.col("a_head") > 0) & (F.col("b_head") > 0) & (2.0 * F.least("a_head", "b_head") / (F.col("a_head") + F.col("b_head")) >= least)
    rows = rows.withColumn("open", open_title & F.coalesce(fits, F.lit(False))).where("copy IS NOT NULL OR artifact OR open").drop("a_head", "b_head", "near").checkpoint()
    heads = facts.select("post_id", "head")
    asked = rows.where("open").select("probe", "candidate", least.alias("least")).join(heads.select(F.col("post_id").alias("probe"), F.col("head").alias("x")), "probe").join(heads.select(F.col("post_id").alias("candidate"), F.col("head").alias("y")), "candidate")
    alike = asked.select("probe", "candidate", entities.alike("x", "y", "least").alias("titled")).where("titled")
    rows = rows.drop("open").join(alike, ["probe", "candidate"], "left").withColumn("titled", F.coalesce("titled", F.lit(False))).where("copy IS NOT NULL OR artifact OR titled").checkpoint()
    bodies = facts.select("post_id", "body")
    read = rows.where("titled").select("probe", "candidate").join(bodies.select(F.col("post_id").alias("probe"), F.col("body").alias("x")), "probe").join(bodies.select(F.col("post_id").alias("candidate"), F.col("body").alias("y")), "candidate")
    rows = rows.join(read.select("probe", "candidate", entities.similarity("x", "y").alias("like")), ["probe", "candidate"], "left")
    decision = (
        F.when(F.col("copy").isNotNull(), F.col("copy"))
        .when(F.col("later") & F.col("artifact") & F.col("titled") & (F.col("like") >= 0.72), found("syndicated_from", 0.82))
        .when(F.col("artifact") & F.col("tongues") & F.col("titled") & ((F.col("like") >= 0.45) | F.col("a_marked")), found("translation_of", F.when(F.col("a_marked"), 0.8).otherwise(0.72)))
        .when(F.col("artifact"), found("references_same_artifact", 0.86))
        .when(F.col("titled") & (F.col("like") >= 0.70), found("near_duplicate", 0.74))
    )
    rows = rows.withColumn("d", decision).where("d IS NOT NULL")
    directed, from_probe = F.col("d.kind").isin("syndicated_from", "translation_of"), F.col("from_probe")
    low, high = F.least("probe", "candidate"), F.greatest("probe", "candidate")
    out = rows.select(
        F.when(directed & from_probe, F.col("probe")).when(directed, F.col("candidate")).otherwise(low).alias("from_id"),
        F.when(directed & from_probe, F.col("candidate")).when(directed, F.col("probe")).otherwise(high).alias("to_id"),
        F.col("d.kind").alias("relation_type"),
        F.col("d.confidence").alias("confidence"),
    )
    return out.groupBy("from_id", "to_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def clusters(posts: DataFrame, links: DataFrame) -> DataFrame:
    """post_id, cluster (its earliest member), size, weight, over equal addresses and hashes, artifacts and relations."""
    keys = F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("normalized_url", "content_hash", "title_hash")]), lambda k: k.isNotNull())
    ranking.checkpoints(posts.sparkSession)
    keyed = posts.select("post_id", F.explode(keys).alias("key")).checkpoint()
    heads = keyed.groupBy("key").agg(F.min("post_id").alias("b"))
    edges = keyed.join(heads, "key").select(F.col("post_id").alias("a"), "b").unionByName(links.select("a", "b"))
    found = graph.components(edges)
    labelled = posts.join(found.withColumnRenamed("id", "post_id"), "post_id", "left").select("post_id", "published_at", F.coalesce("component", "post_id").alias("component"))
    whole = labelled.groupBy("component").agg(F.min_by("post_id", F.struct("published_at", "post_id")).alias("cluster"), F.count("*").alias("size"))
    return labelled.join(whole, "component").select("post_id", "cluster", "size", F.round(1 / F.col("size"), 6).alias("weight"))
