"""The driver's tables, and the domain views over them: posts, sources, interactions.

A post is a document: its title is the first line, it is published doc_id * 37 minutes after START. A source's priority is
its number plus 1. An interaction is an event, joined with posts by doc_id modulo the number of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
START = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, source_id, title, content, lang, minute, published_at, day."""
    minute = F.col("doc_id") * 37
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START), "yyyy-MM-dd") + minute * 60)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("source_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        "lang",
        minute.alias("minute"),
        at.alias("published_at"),
        F.to_date(at).alias("day"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, platform, priority, enabled."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("source_id"),
            F.element_at(F.array(*map(F.lit, ("rss", "reddit", "telegram", "youtube"))), F.coalesce(number, F.lit(0)) % 4 + 1).alias("platform"),
            (F.coalesce(number, F.lit(998)) + 1).alias("priority"),
            (F.coalesce(number, F.lit(0)) % 5 != 4).alias("enabled"),
        )
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, kind, happened, minute, value, k."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("kind"),
        at.alias("happened"),
        F.floor((F.unix_seconds(at) - F.unix_timestamp(F.lit(START), "yyyy-MM-dd")) / 60).alias("minute"),
        "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables and domain views."""
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for make in (posts, sources, interactions):
        make(spark, sf_dir).createOrReplaceTempView(make.__name__)


#: The domain views in DuckDB's SQL.
DUCKDB = {
    "posts": """SELECT doc_id AS post_id, source AS source_id, split_part(text, chr(10), 1) AS title, text AS content, lang,
  doc_id * 37 AS minute, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS published_at,
  CAST(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS DATE) AS day FROM documents""",
    "sources": """SELECT DISTINCT source AS source_id,
  list_extract(['rss', 'reddit', 'telegram', 'youtube'], CAST(coalesce(n, 0) % 4 + 1 AS INT)) AS platform,
  coalesce(n, 998) + 1 AS priority, coalesce(n, 0) % 5 <> 4 AS enabled
  FROM (SELECT source, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)""",
    "interactions": """SELECT event_id, user_id, event_type AS kind, CAST(ts AS TIMESTAMP) AS happened,
  CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP)) / 60) AS BIGINT) AS minute, value,
  TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
}


def duckdb_sql(body: str) -> str:
    """A statement over the domain views, for DuckDB."""
    used = [f"{name} AS ({sql})" for name, sql in DUCKDB.items() if name in body]
    if not used:
        return body
    rest = body.strip()
    joined = ", " + rest[4:].lstrip() if rest[:4].upper() == "WITH" else " " + rest
    return "WITH " + ", ".join(used) + joined
