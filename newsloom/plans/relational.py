"""Relational plans: scans, predicates, joins, aggregates, windows, sorts and set operations of the content store.

Each is one declarative statement that Spark's optimiser plans; the same statement runs on DuckDB as its check. Times are
minutes since the first post, so that arithmetic is exact in both.
"""

from __future__ import annotations

#: The moment that rolling windows look back from, as a share of all posts: the newest post's minute.
AS_OF = "(SELECT max(minute) FROM posts)"

ROLE = "CASE WHEN rn = 1 THEN 'anchor' WHEN rn <= 3 THEN 'update' ELSE 'context' END"

SQL: dict[str, str] = {
    # --- predicates and scans -------------------------------------------------------------------
    "posts_by_date": "SELECT post_id, source_id, title FROM posts WHERE day = DATE '2024-01-05'",
    "posts_in_range": "SELECT post_id, source_id, CAST(day AS STRING) AS day FROM posts WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-06'",
    "posts_since": f"SELECT post_id, minute FROM posts WHERE minute >= {AS_OF} - 7 * 1440",
    "posts_optional_filters": "SELECT post_id, lang FROM posts WHERE (lang = 'en' OR lang = 'de') AND source_id = 'src1' AND post_id <> 17",
    "posts_guarded_cast": "SELECT post_id, CASE WHEN regexp_replace(source_id, '^src', '') RLIKE_DIGITS THEN CAST(regexp_replace(source_id, '^src', '') AS INT) ELSE 999 END AS priority FROM posts",
    "posts_json_path": "SELECT event_id, coalesce(k, 999) AS k FROM interactions",
    "posts_coalesced": "SELECT post_id FROM posts WHERE coalesce(CASE WHEN post_id % 3 = 0 THEN day END, CASE WHEN post_id % 3 = 1 THEN CAST('2024-01-03' AS DATE) END, CAST('2024-01-09' AS DATE)) BETWEEN DATE '2024-01-02' AND DATE '2024-01-05'",
    "posts_membership": "SELECT post_id, title FROM posts WHERE post_id IN (3, 5, 8, 13, 21, 34)",
    "posts_semi_join": "SELECT p.post_id, p.source_id FROM posts p WHERE p.post_id IN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)",
    "posts_anti_join": "SELECT p.post_id, p.source_id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.post_id)",
    "topics_exist": "SELECT CAST(count(*) > 0 AS BOOLEAN) AS found FROM (SELECT 1 AS one FROM posts WHERE day = DATE '2024-01-02' LIMIT 1) x",
    "posts_literal_order": "SELECT v.ord, p.post_id, p.title FROM (VALUES (1, 21), (2, 3), (3, 8)) v(ord, post_id) JOIN posts p ON p.post_id = v.post_id",
    "items_by_kind": """SELECT post_id, CASE WHEN lang = 'en' THEN 'post' ELSE 'story' END AS target_type,
  CASE WHEN lang = 'en' THEN title END AS post_title, CASE WHEN lang <> 'en' THEN source_id END AS story_source FROM posts""",
    "source_search": "SELECT source_id, platform FROM sources WHERE platform LIKE '%red%' OR lower(source_id) LIKE '%1%'",
    "fetch_due": f"""SELECT s.source_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'fetch' WHEN {AS_OF} - last_minute < 20 * 60 THEN 'skip' ELSE 'fetch' END AS decision
  FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n, max(minute) AS last_minute FROM posts GROUP BY source_id) p ON p.source_id = s.source_id""",
    "ingest_order": "SELECT source_id, platform, CAST(row_number() OVER (PARTITION BY platform ORDER BY priority, source_id) AS INT) AS position FROM sources WHERE enabled",
    # --- joins ----------------------------------------------------------------------------------
    "posts_with_sources": "SELECT p.post_id, s.platform, s.priority FROM posts p JOIN sources s ON s.source_id = p.source_id",
    "label_posts_sources": "SELECT l.doc_id, l.quality, s.platform FROM labels l JOIN posts p ON p.post_id = l.doc_id JOIN sources s ON s.source_id = p.source_id",
    "source_counts_outer": """SELECT s.source_id, s.platform, s.priority, s.enabled, count(p.post_id) AS posts FROM sources s
  LEFT JOIN posts p ON p.source_id = s.source_id AND p.lang = 'fr' GROUP BY s.source_id, s.platform, s.priority, s.enabled""",
    "customer_order_summary": """SELECT c.c_custkey, coalesce(o.orders, 0) AS orders, coalesce(o.urgent, 0) AS urgent FROM customer c LEFT JOIN (
  SELECT o_custkey, count(*) AS orders, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "latest_interaction": """SELECT user_id, event_id, kind FROM (SELECT user_id, event_id, kind,
  row_number() OVER (PARTITION BY user_id ORDER BY happened DESC, event_id DESC) AS rn FROM interactions) x WHERE rn = 1""",
    "best_story_of_post": f"""WITH ranked AS (SELECT source_id, day, post_id, minute, row_number() OVER (PARTITION BY source_id, day ORDER BY minute, post_id) AS rn FROM posts),
roles AS (SELECT post_id, source_id, day, {ROLE} AS role, minute FROM ranked)
SELECT source_id, post_id, role FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE role WHEN 'anchor' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, minute DESC, post_id) AS pick FROM roles) x WHERE pick = 1""",
    "edges_both_ways": """WITH e AS (SELECT a.doc_id AS f, b.doc_id AS t FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1)
SELECT post_id, count(*) AS degree FROM (SELECT f AS post_id FROM e UNION ALL SELECT t AS post_id FROM e) x GROUP BY post_id""",
    "polymorphic_left_join": """WITH items AS (SELECT post_id AS target_id, CASE WHEN post_id % 2 = 0 THEN 'post' ELSE 'source' END AS target_type FROM posts)
SELECT i.target_id, i.target_type, p.title, l.quality FROM items i LEFT JOIN posts p ON i.target_type = 'post' AND p.post_id = i.target_id
LEFT JOIN labels l ON i.target_type = 'source' AND l.doc_id = i.target_id""",
    "table_counts": """SELECT (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE enabled) AS enabled, (SELECT count(*) FROM interactions) AS interactions""",
    "nation_revenue": """SELECT n.n_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name""",
    # --- aggregates -----------------------------------------------------------------------------
    "count_posts": "SELECT count(*) AS n FROM posts WHERE lang = 'en'",
    "source_bounds": "SELECT source_id, count(*) AS n, min(minute) AS first_minute, max(minute) AS last_minute, CAST(max(day) AS STRING) AS last_day FROM posts GROUP BY source_id",
    "filtered_counts": "SELECT user_id, count(*) FILTER (WHERE kind = 'view') AS views, min(minute) FILTER (WHERE kind = 'click') AS first_click, max(minute) FILTER (WHERE kind = 'click') AS last_click FROM interactions GROUP BY user_id",
    "conditional_sum": "SELECT user_id, CAST(sum(CASE WHEN kind = 'view' THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS seconds FROM interactions GROUP BY user_id",
    "distinct_posts": "SELECT source, count(DISTINCT text) AS texts FROM documents GROUP BY source",
    "platform_rollup": """SELECT s.platform, count(*) AS sources, CAST(sum(p.n) AS BIGINT) AS posts, max(CASE WHEN s.enabled THEN 1 ELSE 0 END) = 1 AS enabled FROM sources s
  JOIN (SELECT source_id, count(*) AS n FROM posts GROUP BY source_id) p ON p.source_id = s.source_id GROUP BY s.platform""",
    "posts_by_day": "SELECT CAST(day AS STRING) AS day, count(*) AS n, min(post_id) AS first_post FROM posts GROUP BY day",
    "top_kinds": """SELECT source_id, kind, n FROM (SELECT source_id, lang AS kind, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, min(post_id)) AS rn
  FROM posts GROUP BY source_id, lang) x WHERE rn <= 3""",
    "language_document_frequency": "SELECT lang, count(DISTINCT source_id) AS sources FROM posts GROUP BY lang",
    "coverage_ratio": """SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 4) END AS coverage,
  CAST(count(l.doc_id) AS DOUBLE) / count(*) >= 0.7 AS entities_ok, CAST(count(l.doc_id) AS DOUBLE) / count(*) >= 0.4 AS events_ok FROM posts p LEFT JOIN labels l ON l.doc_id = p.post_id""",
    "export_report": "SELECT count(DISTINCT s.platform) AS platforms, CAST(min(p.day) AS STRING) AS first_day, CAST(max(p.day) AS STRING) AS last_day, count(*) AS posts FROM posts p JOIN sources s ON s.source_id = p.source_id",
    "week_ranges": "SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS STRING) AS week, count(*) AS posts, count(DISTINCT source_id) AS sources FROM posts GROUP BY date_trunc('week', day)",
    "weekly_title_merge": "SELECT title, count(*) AS posts, min(post_id) AS first_post, CAST(min(day) AS STRING) AS first_day FROM posts GROUP BY title HAVING count(*) > 1",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    # --- windows --------------------------------------------------------------------------------
    "latest_update": "SELECT source_id, post_id, minute FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day DESC, length(content) DESC, post_id DESC) AS rn FROM posts) x WHERE rn = 1",
    "top_per_probe": "SELECT lang, source_id, post_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source_id ORDER BY minute DESC, post_id) AS rn FROM posts) x WHERE rn <= 5",
    "timeline_split": """SELECT post_id, CASE WHEN day < cur THEN 'earlier' WHEN post_id = cur_id THEN 'current' ELSE 'later' END AS place FROM (
  SELECT post_id, day, max(CASE WHEN rn = mid THEN day END) OVER (PARTITION BY source_id) AS cur, max(CASE WHEN rn = mid THEN post_id END) OVER (PARTITION BY source_id) AS cur_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY minute, post_id) AS rn, floor((count(*) OVER (PARTITION BY source_id) + 1) / 2) AS mid FROM posts) a) b""",
    "highlight_merge": """WITH marks AS (SELECT user_id, minute AS s, minute + 1 + coalesce(k, 0) * 30 AS e, event_id FROM interactions),
flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM marks),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM flagged)
SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS start_minute, max(e) AS end_minute, count(*) AS marks FROM islands GROUP BY user_id, island""",
    # --- sorts and limits -----------------------------------------------------------------------
    "page_of_posts": "SELECT post_id, minute FROM posts ORDER BY minute DESC, post_id LIMIT 20 OFFSET 40",
    "nearest_in_time": "SELECT post_id, abs(minute - 20000) AS gap FROM posts ORDER BY abs(minute - 20000), post_id LIMIT 25",
    "nulls_last": "SELECT p.post_id, l.quality FROM posts p LEFT JOIN labels l ON l.doc_id = p.post_id ORDER BY l.quality ASC NULLS LAST, p.post_id LIMIT 50",
    "source_health": f"""SELECT s.source_id, CASE WHEN p.n IS NULL THEN 'empty' WHEN {AS_OF} - p.last_minute > 4320 THEN 'stale' ELSE 'healthy' END AS status, coalesce(p.n, 0) AS posts
  FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n, max(minute) AS last_minute FROM posts GROUP BY source_id) p ON p.source_id = s.source_id""",
    "track_buckets": """SELECT CASE WHEN rn > 5 THEN 'Other Updates' ELSE source_id END AS track, CAST(sum(n) AS BIGINT) AS posts FROM (
  SELECT source_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(minute), source_id) AS rn FROM posts GROUP BY source_id) x GROUP BY CASE WHEN rn > 5 THEN 'Other Updates' ELSE source_id END""",
    "topics_in_order": "SELECT lang AS topic, source_id, lang = 'fr' AS is_outlier FROM posts WHERE day = DATE '2024-01-03' ORDER BY lang = 'fr', minute, post_id LIMIT 30",
    "inbox_in_order": "SELECT post_id, post_id % 10 AS priority FROM posts ORDER BY post_id % 10 DESC, minute, post_id LIMIT 25 OFFSET 10",
    "artifacts_in_order": "SELECT post_id, position FROM (SELECT post_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN post_id % 5 = 0 THEN 0 ELSE 1 END, post_id % 9 DESC, post_id) AS INT) AS position FROM posts) x WHERE position <= 3",
    "comments_by_score": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) % 17 DESC, turn) AS rn FROM conversations) x WHERE rn <= 5",
    "top_comments": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) x WHERE rn <= 5",
    # --- set operations -------------------------------------------------------------------------
    "shared_members": "SELECT text FROM documents WHERE source = 'src0' INTERSECT SELECT text FROM documents WHERE source = 'src1'",
    "mirror_delete": "SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM posts WHERE lang = 'fr' AND minute < 3000)",
    "unreferenced_posts": "SELECT post_id FROM posts EXCEPT SELECT doc_id FROM labels",
    # --- composite ------------------------------------------------------------------------------
    "reader_state": """SELECT user_id, count(*) FILTER (WHERE kind = 'view') AS opens, min(minute) FILTER (WHERE kind = 'view') AS first_opened, max(minute) FILTER (WHERE kind = 'view') AS last_opened,
  CAST(sum(CASE WHEN kind = 'view' THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS read_seconds, coalesce(max(CASE WHEN rn = 1 THEN CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END END), 0) = 1 AS favorite
  FROM (SELECT *, CASE WHEN kind IN ('purchase', 'error') THEN row_number() OVER (PARTITION BY user_id, kind IN ('purchase', 'error') ORDER BY happened DESC, event_id DESC) END AS rn FROM interactions) x GROUP BY user_id""",
    "recent_failures": """SELECT user_id, event_id, minute FROM interactions WHERE kind = 'error' ORDER BY minute DESC, event_id LIMIT 8""",
    "archive_catalogue": """SELECT source_id, CASE WHEN n >= 80 THEN 'archived' WHEN n >= 20 THEN 'partial' ELSE 'not_archived' END AS status, n FROM (SELECT source_id, count(*) AS n FROM posts GROUP BY source_id) x""",
    "story_cards": """SELECT source_id AS story, count(*) AS posts, count(DISTINCT day) AS updates, min(post_id) AS anchor, CAST(max(day) AS STRING) AS last_update FROM posts GROUP BY source_id""",
    "source_sync": """SELECT coalesce(w.source_id, c.source_id) AS source_id, CASE WHEN c.source_id IS NULL THEN 'add' WHEN w.source_id IS NULL THEN 'delete' WHEN w.enabled <> c.enabled THEN 'toggle' ELSE 'keep' END AS action
  FROM (SELECT source_id, priority % 2 = 0 AS enabled FROM sources WHERE priority > 3) w FULL OUTER JOIN (SELECT source_id, enabled FROM sources WHERE priority < 18) c ON c.source_id = w.source_id""",
    "outlier_assignment": "SELECT p.post_id, CASE WHEN l.quality IS NULL THEN -1 ELSE l.quality END AS topic, l.quality IS NULL AS is_outlier FROM posts p LEFT JOIN labels l ON l.doc_id = p.post_id",
}


def spark_sql(body: str) -> str:
    return body.replace("RLIKE_DIGITS", "RLIKE '^[0-9]+$'")


def duck_sql(body: str) -> str:
    return body.replace("regexp_replace(source_id, '^src', '') RLIKE_DIGITS", "regexp_matches(regexp_replace(source_id, '^src', ''), '^[0-9]+$')")
