"""Functions and operators on small cases, against plain Python where SQL can't express them."""

import difflib
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import entities, events, language, text, urls
from newsloom.operators import evidence, graph, inbox, memory, merge, stories
from newsloom.sources import feeds
from newsloom.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_urls(spark):
    cases = {
        "https://Example.com/path/?utm_source=newsletter&b=2&a=1#frag": "https://example.com/path?a=1&b=2",
        "https://youtu.be/dQw4w9WgXcQ?t=30": "https://youtube.com/watch?v=dQw4w9WgXcQ",
        "http://www.Example.org:80//a//b/": "http://example.org/a/b",
        "old.reddit.com/r/x": "https://reddit.com/r/x",
    }
    for given, wanted in cases.items():
        assert one(spark, urls.normalize(F.col("u")), u=given) == wanted
    assert one(spark, urls.normalize(F.col("u")), u="") is None
    assert one(spark, urls.artifact_type(F.col("u"), F.lit("rss")), u="https://github.com/a/b/issues/3") == "issue"
    assert one(spark, urls.artifact_type(F.col("u"), F.lit("rss")), u="https://arxiv.org/abs/1") == "paper"


def test_language(spark):
    for given, code in (("This is the text of an article about it", "en"), ("Это не то что мы думали", "ru"), ("ეს არის ქართული ტექსტი", "ka"), ("Das ist nicht der Text", "de")):
        found = one(spark, language.detect(F.col("t")), t=given)
        assert found["code"] == code and found["confidence"] > 0.5
    assert one(spark, language.detect(F.col("t")), t="")["code"] == "und"


def test_text(spark):
    assert one(spark, text.strip_html(F.col("t")), t="<p>a &amp; b</p> <i>c</i>") == "a & b c"
    assert one(spark, text.hash_text(F.col("t")), t="  ") == ""
    assert one(spark, text.brief(F.col("t"), F.lit("x")), t="Title") == "Title."
    assert one(spark, text.topic_key(F.col("t")), t="Agent Systems: Part 2") == "Agent Systems"
    assert [h["kind"] for h in one(spark, text.highlights(F.col("t")), t="One. Two! Three?")] == ["evidence", "detail", "detail"]


def test_event(spark):
    found = one(spark, events.best_event(text.normalize(F.col("t")), F.lit("")), t="OpenAI launches a new model with Microsoft")
    assert found["event_type"] == "release_launch" and found["less"] < 0


def test_mentions():
    found = {m["name"] for m in entities.mentions_of("@codex and Ada Memory Test met OpenAI. The IDE. They were here")}
    assert {"codex", "ada memory test", "openai"} <= found
    assert not {"the", "ide", "they", "here"} & found


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, i) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in found.collect()} == {x: find(x) for x in parent}


def test_translation_and_duplicates(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, "Launch news today", "Launch of the model", "https://a.org/1", "a.org", "h", "c", "en", t),
        (2, "Launch news today", "Launch of the model перевод", "https://b.org/2", "b.org", "h2", "c2", "ru", t.replace(hour=1)),
        (3, "Launch news today", "Launch of the model", "https://a.org/1", "a.org", "h", "c", "en", t.replace(hour=2)),
    ]
    posts = spark.createDataFrame(rows, "post_id long, title string, content string, normalized_url string, url_host string, title_hash string, content_hash string, language_code string, published_at timestamp")
    shared = spark.createDataFrame([(1, "https://x.org/p"), (2, "https://x.org/p")], "post_id long, normalized_url string")
    found = {(r["from_id"], r["to_id"], r["relation_type"]) for r in evidence.relations(posts, shared, evidence.candidates(posts, shared)).collect()}
    assert (2, 1, "translation_of") in found and (1, 3, "exact_duplicate") in found


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, None, 1), ("a", 3, "t", 2), ("b", 2, "u", 3)], "k string, c int, title string, seq long")
    rules = {"c": "greatest", "title": "latest"}
    once = merge.fold(rows.limit(0), rows, ["k"], rules)
    assert sorted(map(tuple, merge.fold(once, rows, ["k"], rules).collect())) == sorted(map(tuple, once.collect())) == [("a", 3, "t", 2), ("b", 2, "u", 3)]
    synced = merge.sync(rows.select("k", (F.col("c") > 2).alias("on")).distinct().where("k = 'a' AND on"), spark.createDataFrame([("b", True)], "k string, on boolean"), ["k"], "on")
    assert {tuple(r) for r in synced.collect()} == {("a", "delete"), ("b", "add")}


def test_timeline(spark):
    rows = [(1, 1, "2024-03-20", False), (1, 2, "2024-03-21", True), (1, 3, "2024-03-23", False), (2, 4, "2024-03-20", False)]
    found = stories.split(spark.createDataFrame(rows, "story_id int, update_id int, day string, current boolean"))
    assert {r["update_id"]: r["place"] for r in found.collect()} == {1: "earlier", 2: "current", 3: "later", 4: "earlier"}


def test_inbox_order(spark):
    stories_in = spark.createDataFrame([(1, 1.0, 4, 3, 1.0, 0.9, 1, 2)], "id long, hours double, posts long, updates long, importance double, anchor double, priority int, signals int")
    posts_in = spark.createDataFrame([(2, 1.0, 1, 0, False, False, 0.9, 1), (3, 500.0, 0, 0, True, False, 0.9, 900)], "id long, hours double, artifacts long, relations long, duplicates boolean, linked boolean, language_confidence double, priority int")
    assert [(r["target_type"], r["target_id"]) for r in inbox.rebuild(stories_in, posts_in).orderBy("position").collect()] == [("story", 1), ("post", 2)]


def test_resolution(spark):
    rows = [(1, datetime(2024, 1, 1), 0, "ada", "person", 0.8), (2, datetime(2024, 1, 2), 0, "ada", "person", 0.8), (3, datetime(2024, 1, 2), 5, "bob", "person", 0.8), (3, datetime(2024, 1, 2), 9, "cy", "person", 0.8), (4, datetime(2024, 1, 3), 0, "bob", "organization", 0.8)]
    known = spark.createDataFrame([("e1", "bob", "person"), ("e2", "cy", "person"), ("e3", "cy", "person")], "entity_id string, name string, entity_type string")
    table = spark.createDataFrame(rows, "post_id long, published_at timestamp, start int, name string, entity_type string, confidence double").withColumn("role", F.lit("body"))
    found = {(r["post_id"], r["name"]): r["state"] for r in memory.resolve(table, known).collect()}
    assert found == {(1, "ada"): "provisional", (2, "ada"): "resolved", (3, "bob"): "resolved", (3, "cy"): "needs_review", (4, "bob"): "provisional"}


def test_feed(spark):
    xml = """<rss><channel><item><title>A &amp; B</title><link>https://x.org/1</link><guid>g</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>
    <description><![CDATA[<p>Hello <img src="https://x.org/i.png"></p>]]></description><category>b</category><category>a</category></item>
    <item><title>old</title><link>https://x.org/0</link><description>none</description></item></channel></rss>"""
    rows = feeds.feed(spark.createDataFrame([("f", xml)], "feed_url string, xml string")).collect()
    assert [r["url"] for r in rows] == ["https://x.org/1", "https://x.org/0"]
    assert rows[0]["content"] == "Hello" and rows[0]["categories"] == ["a", "b"] and rows[0]["media_urls"] == ["https://x.org/i.png"] and rows[0]["published_at"] == datetime(2024, 1, 1, 10)


def test_comments(spark):
    rows = [(1, None, 0, "a"), (2, 1, 0, "[deleted]"), (3, 2, 0, "under"), (4, 1, 1, "b")]
    table = spark.createDataFrame(rows, "id long, parent_id long, position long, body string")
    assert [r["id"] for r in feeds.flatten_comments(table).collect()] == [1, 4]
    assert [r["id"] for r in feeds.flatten_comments(table, descend_deleted=True).collect()] == [1, 3, 4]


def test_listing_and_albums(spark):
    json = '{"data":{"children":[{"kind":"t3","data":{"id":"x","title":"T","selftext":"","permalink":"/r/a/x","subreddit":"a","link_flair_text":null,"created_utc":0}},{"kind":"t1","data":{"id":"y"}}]}}'
    row = feeds.listing(spark.createDataFrame([(json,)], "json string")).collect()
    assert [(r["external_id"], r["content"], r["categories"]) for r in row] == [("x", "T", ["a"])]
    messages = spark.createDataFrame([(1, 9, "one", "m1"), (2, 9, "two", "m2"), (3, 8, "", "m3")], "message_id long, grouped_id long, text string, media string")
    assert [tuple(r) for r in feeds.albums(messages).collect()] == [(2, "two", ["m1", "m2"])]


def test_stream_upsert(spark, tmp_path):
    schema = "url string, n int, seq long"
    for k, rows in enumerate(([("a", 1, 1), ("b", 5, 2)], [("a", 3, 3)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.upsert_stream(source, f"{tmp_path}/out", f"{tmp_path}/check", ["url"], {"n": "greatest"}).awaitTermination()
    table = ingest.table(spark, f"{tmp_path}/out")
    assert {r["url"]: r["n"] for r in table.collect()} == {"a": 3, "b": 5} and table.columns == ["url", "n", "seq"]
    written = sorted(len(found) for found in ingest.versions(spark, f"{tmp_path}/out").values())
    assert written == [1, 2]  # the second batch leaves the other bucket alone
    for k in range(4, 7):
        spark.createDataFrame([("a", k, k)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", ["url"], {"n": "greatest"}).awaitTermination()
    assert {r["url"]: r["n"] for r in ingest.table(spark, f"{tmp_path}/out").collect()} == {"a": 6, "b": 5}
    assert max(len(found) for found in ingest.versions(spark, f"{tmp_path}/out").values()) == ingest.KEPT


def test_deep_comments(spark):
    """Replies at any depth; a cut by depth, deleted parents, and comments without an author."""
    chain = [(str(i), str(i - 1) if i else None, 0, "text", "x") for i in range(40)]
    rows = [*chain, ("d", "3", 1, "[deleted]", "x"), ("e", "d", 0, "below", "x"), ("f", None, 1, "no author", None), ("g", "f", 0, "reply", "y")]
    table = spark.createDataFrame(rows, "id string, parent_id string, position int, body string, author string")
    ids = lambda **k: [r["id"] for r in feeds.flatten_comments(table, **k).collect()]
    whole = ids()
    assert whole[:4] == ["0", "1", "2", "3"] and len(whole) == 42 and "e" not in whole and whole[-2:] == ["f", "g"]
    assert "e" in ids(descend_deleted=True) and "d" not in ids(descend_deleted=True)
    assert len(ids(max_depth=2)) == 5 and "f" not in ids(authors=True) and "g" in ids(authors=True) and ids(limit=2) == ["0", "1"]


def test_rss_posts(spark):
    rows = [("http://x/atom.xml", f"u{i}", f"t{i}", "", "h", datetime(2024, 1, 1 + i) if i else None, ["B", "a", "b"], ["m"], None) for i in range(5)]
    items = spark.createDataFrame(rows, "feed_url string, url string, title string, content string, content_html string, published_at timestamp, categories array<string>, media_urls array<string>, guid string")
    now = F.lit(datetime(2024, 1, 6))
    assert [r["url"] for r in feeds.timeframe(items, 3, now=now).collect()] == ["u2", "u3", "u4"]
    assert [r["url"] for r in feeds.timeframe(items, 0, most=2, now=now).collect()] == ["u3", "u4"]
    post = {r["url"]: r for r in feeds.rss_post(items).collect()}
    assert post["u1"]["categories"] == ["a", "b"] and post["u1"]["content"] == "t1" and post["u0"]["date"] is not None and post["u0"]["metadata"]["undated"] == "true"
    assert post["u1"]["metadata"]["feed_type"] == "atom" and post["u1"]["metadata"]["guid"] == "u1"


def test_positions_and_tops(spark):
    from newsloom.operators import ranking

    rows = [(i, (i * 7919) % 101, i % 3) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, v long, k int").repartition(7)
    found = {r["id"]: r["position"] for r in ranking.positions(table, [F.col("v").desc(), F.col("id").asc()]).collect()}
    assert found == {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    tops = {(r["k"], r["rank"]): r["id"] for r in ranking.top(table, ["k"], [F.col("v").desc(), F.col("id").asc()], 5).collect()}
    assert tops == {(k, n + 1): r[0] for k in range(3) for n, r in enumerate(sorted((r for r in rows if r[2] == k), key=lambda r: (-r[1], r[0]))[:5])}
    assert ranking.positions(table.limit(0), [F.col("id")]).count() == 0


def test_detail(spark):
    from newsloom.operators import detail

    sources = spark.createDataFrame([("a", "rss", {"priority": "3"}), ("b", "youtube", None)], "source_id string, platform string, settings map<string,string>")
    found = {r["source_id"]: r["settings"] for r in detail.source_settings(sources).collect()}
    assert found["a"]["priority"] == "3" and found["a"]["max_posts_per_fetch"] == "20" and found["b"]["max_posts_per_fetch"] == "5"
    videos = spark.createDataFrame([("c", "1", "Agent Systems: Part 1", 3), ("c", "2", "Agent Systems: Part 2", 1), ("c", "3", "Something else entirely here", 2)], "channel string, video_id string, title string, published_at int")
    assert [(r["title"], r["kind"], r["videos"]) for r in detail.video_groups(videos).collect()] == [("Agent Systems", "topic_cluster", ["2", "1"]), ("Something else entirely here", "single", ["3"])]
    posts = spark.createDataFrame([(1,), (2,), (3,)], "post_id long")
    covered = detail.backfill(posts, spark.createDataFrame([("t", 1), ("t", 9)], "track string, post_id long"))
    assert {(r["track"], r["post_id"]) for r in covered.collect()} == {("t", 1), ("Other Updates", 2), ("Other Updates", 3)}
    shown = detail.post_detail(posts, spark.createDataFrame([("x", 1)], "topic_id string, post_id long"), spark.createDataFrame([("x", "T", False)], "topic_id string, title string, is_outlier boolean"))
    assert {r["post_id"]: r["topics_json"] for r in shown.collect()} == {1: '[{"title":"T","topic_id":"x","is_outlier":false}]', 2: "[]", 3: "[]"}
    members = spark.createDataFrame([("b", 2, 1), ("b", 1, 2), ("b", 2, 3)], "artifact_id string, post_id long, position int")
    marks = spark.createDataFrame([(2, "best", 0.9, 1), (2, "worse", 0.2, 2)], "post_id long, text string, importance double, position int")
    assert [(r["post_id"], r["role"], r["highlight"]) for r in detail.artifact_references(members, marks).orderBy("place").collect()] == [(2, "primary", "best"), (1, "supporting", None)]


def test_kinds_of_entities():
    """Types and confidences of mentions, by title and body."""
    kinds = {"OpenAI Research": "organization", "Dr Smith": "person", "@user": "unknown", "Anna": "organization", "NASA": "unknown", "DeepMind": "organization", "the": "unknown", "": "unknown", "Ada Lovelace": "organization"}
    assert {m: entities.kind_of(m) for m in kinds} == {**kinds, "Anna": "unknown"}  # of four letters
    assert entities.kind_of("Anna", "title") == "organization"
    found = {m["text"]: (m["kind"], m["confidence"]) for m in entities.mentions_of("#ai #science Berlin said Berlin and Paris, with OpenAI and Lab Lab")}
    assert found["#ai"] == ("hashtag", 0.55) and found["#science"] == ("hashtag", 0.66) and found["Berlin"][0] == "single" and "Paris" not in found
    assert found["Lab Lab"] == ("multiword", 0.88) and found["OpenAI"] == ("single", 0.70)
    assert [m["text"] for m in entities.mentions_of("Paris", "title")] == ["Paris"] and entities.mentions_of(None) == []


def test_upserts_change_nothing_twice(spark):
    """Every table's rules: merging the same rows again gives the same table."""
    from newsloom.operators import merge

    for table, (keys, rules) in merge.TABLES.items():
        kinds = {"map": "map<string,string>", "append": "array<string>", "any": "boolean", "add": "bigint"}
        own = {c: kinds.get(k, "string") for c, k in rules.items() if k not in ("add", "append", "concat")}
        row = lambda i: tuple({"map<string,string>": {"a": str(i), f"k{i}": "x"}, "boolean": i % 2 == 0, "string": None if i % 3 == 0 else f"v{i}"}[t] for t in own.values())  # noqa: E731, B023
        schema = ", ".join([*(f"{k} string" for k in keys), *(f"{c} {t}" for c, t in own.items()), "seq bigint"])
        frame = lambda ids: spark.createDataFrame([(*(f"key{i % 3}" + ("b" if k == "to_id" else "") for k in keys), *row(i), i) for i in ids], schema)  # noqa: E731, B023
        once = merge.upsert(table, frame(range(4)), frame(range(4, 9)))
        twice = merge.upsert(table, once.drop("first_write"), frame(range(4, 9)))
        strip = lambda t: sorted((str({k: v for k, v in r.asDict().items() if k != "first_write"}) for r in t.collect()))
        assert strip(once) == strip(twice), table


def test_transcripts(spark):
    from newsloom.functions import sources

    rows = [
        ("a", False, "de", 0, "vtt", "WEBVTT\n\n1\n00:00 --> 00:01\nHallo\n"),
        ("a", True, "en", 0, "json3", '{"events": [{"segs": [{"utf8": "Hi "}, {"utf8": "you"}]}, {}, {"segs": [{"utf8": "\\n"}]}, {"segs": [{"utf8": "there"}]}]}'),
        ("b", False, "fr", 0, "srv3", "<tt><p t='1'>un</p><p> </p><p>deux</p></tt>"),
        ("b", True, "fr", 0, "vtt", "later"),
        ("c", False, "en", 0, "vtt", "WEBVTT\n12\n"),
    ]
    tracks = spark.createDataFrame(rows, "video_id string, automatic boolean, language string, position int, kind string, payload string")
    found = {r["video_id"]: (r["source"], r["text"]) for r in sources.best_transcript(tracks).collect()}
    assert found == {"a": ("automatic_captions:en", "Hi you\nthere"), "b": ("subtitles:fr", "un\ndeux")}


def test_compaction_and_addresses(spark):
    from newsloom.functions import sources

    row = spark.range(1).select(
        F.char_length(sources.compact_text(F.repeat(F.lit("x"), 700), "content")).alias("short"),
        F.char_length(sources.compact_text(F.repeat(F.lit("x"), 700), "title")).alias("whole"),
        sources.compact_list(F.sequence(F.lit(1), F.lit(30)), "topics").alias("topics"),
        sources.compact_list(F.sequence(F.lit(1), F.lit(300)), "events").alias("events"),
        sources.compact_list(F.sequence(F.lit(1), F.lit(20)), "items").alias("items"),
        sources.public_address(F.lit("see http://127.0.0.1:9504/a and https://base/b"), "https://t.example", "https://base").alias("address"),
    ).first()
    assert row["short"] == 600 + len("... [truncated]") and row["whole"] == 700
    assert (len(row["topics"]["items"]), row["topics"]["dropped"], row["events"]["items"][0], len(row["items"]["items"])) == (12, 18, 101, 20)
    assert row["address"] == "see https://t.example/a and https://t.example/b"


def test_folding_and_references(spark):
    """As the standard library does, for references with a semicolon."""
    import html

    said = ["Straße &amp;lt; &lt;b&gt; &eacute;&#8217;&#x1F600;&nbsp;x &unknown; &copy 1", "ΟΔΟΣ ﬁn ẞ", "plain & simple", "&#0; &#xD800; &amp;amp;", "", "İstanbul"[1:]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", text.unescape(F.col("s")).alias("u"), text.casefold(F.col("s")).alias("f")).collect()
    for r in rows:
        wanted = html.unescape(said[r["i"]].replace("&copy 1", "@@"))
        assert r["u"].replace("&copy 1", "@@") == wanted and r["f"] == said[r["i"]].casefold()


def test_sources_csv(spark, tmp_path):
    from newsloom.sources import sinks

    sources = spark.createDataFrame([("1", "rss", "u", True, 3), ("2", "rss", None, False, 0), ("3", None, "w", True, None)], "id string, platform string, handle_or_url string, enabled boolean, post_count int")
    totals = {r["platform"]: (r["sources"], r["enabled"], r["posts"]) for r in sinks.sources_csv(sources, f"{tmp_path}/out").collect()}
    assert totals == {"rss": (2, 1, 3), "unknown": (1, 1, 0), None: (3, 2, 3)}
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == list(sinks.SOURCE_COLUMNS)


def test_mentions_of_long_texts():
    names = " ".join(f"Anna{'x' * (i % 40)}{i} Berta{i}" for i in range(4000))
    began = time.process_time()
    found = entities.mentions_of(names + " . " + names)
    assert time.process_time() - began < 20  # each name searched the whole text, and each mention all others, before
    assert len(found) >= 4000 and all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))


def test_normalize_is_worked_out_once(spark):
    said = ["A &amp;amp; B  Straße", "&#38;lt; \x85İı", None, "", "ΑΣ &copy 1 &copy; &#xD800; ﬁ\x1cx"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "post_id int, content string")
    old = text.casefold(text.squeeze(text.unescape(F.coalesce("content", F.lit("")))))
    assert rows.where(~text.normalize(F.col("content")).eqNullSafe(old)).count() == 0
    plan = memory.event_memory(rows.withColumn("title", F.lit("Firm launches a partnership")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000  # the text was normalised anew for each key word, with its tables of references


def test_relations_of_a_busy_address(spark):
    n = 300
    rows = [(i, f"Title number {i}", f"body {i}", f"https://h{i % 3}.example/{i}", "en", i) for i in range(n)]
    posts = spark.createDataFrame(rows, "post_id long, title string, content string, url string, lang string, m int").withColumns({"html": F.lit(None).cast("string"), "published_at": F.timestamp_seconds(F.col("m") * 3600)})
    posts, shared = evidence.enrich(posts), spark.createDataFrame([(i, "https://busy.example/x") for i in range(n)], "post_id long, normalized_url string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (5, 250)], "probe long, candidate long")
    found = evidence.relations(posts, shared, pairs)
    assert sorted((r["from_id"], r["to_id"]) for r in found.collect()) == [(1, 2), (2, 1), (5, 250)]
    draw = random.Random(3)
    for _ in range(300):  # the bounds rule out no pair that is alike
        a = "".join(draw.choice("abcde ") for _ in range(draw.randint(0, 60)))
        b = draw.choice((a[: draw.randint(0, 60)] + "ab", a[::-1], a))
        for least in (0.84, 0.94):
            assert entities.alike_of(a, b, least) == ((difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0) >= least)


@pytest.mark.parametrize("cap", [120, 5])
def test_story_candidates(spark, cap):
    """The same as the pool's pairs scored one by one, and no join gets pairs without a signal."""
    rng = random.Random(3)
    rows = []
    for i in range(700):
        said = " ".join(rng.choice("alpha bravo carol delta eagle flint".split()) for _ in range(5))
        at = None if i % 90 == 0 else rng.choice((0, 1, 2, 40, 250, 600)) * 86400 + rng.randrange(40) * 3600
        rows.append((i, at, said if i % 50 else None, f"{said[::-1]}. more", f"u{i % 97}" if i % 3 else "", f"c{i % 89}", f"t{i % 83}" if i % 5 else None, "h", ["ai"], f"k{i % 2}"))
    posts = spark.createDataFrame(rows, "post_id long, at long, title string, content string, normalized_url string, content_hash string, title_hash string, url_host string, tags array<string>, blocking string")
    posts = posts.withColumn("published_at", F.timestamp_seconds("at")).drop("at").repartition(3)
    pool = stories.pool(posts, cap=cap)
    expected = sorted(map(tuple, stories.score(pool, posts).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert sorted(map(tuple, stories.candidates(posts, cap=cap).collect())) == expected and len(expected) > 50
        assert stories._signals(stories._ready(posts), 30, cap).count() < 0.9 * pool.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stories.candidates(posts.limit(0)).count() == 0


def test_relations_are_not_capped(spark):
    """A busy host, address and artifact: partners beyond the newest 50 or 100 are found."""
    n = 130
    rows = [(i, f"{i:03d} {chr(97 + i % 26) * (i % 40 + 1)}", f"body {i} {i * i}", f"https://h.example/{i}", 600 + i) for i in range(n)]
    rows += [(i, "The very same title of two posts", "And the very same body of both posts", f"https://h.example/{i}", i - 199) for i in (200, 201)]
    rows += [(300 + i, f"{i % 60} of an address", f"{i % 60} said", "https://busy.example/one", 100000 + 500 * i) for i in range(n)]
    posts = spark.createDataFrame(rows, "post_id long, title string, content string, url string, m long")
    posts = evidence.enrich(posts.withColumns({"html": F.lit(None).cast("string"), "published_at": F.timestamp_seconds(F.col("m") * 60)})).checkpoint()
    shared = spark.createDataFrame([(i, "https://x.example/p") for i in range(n)], "post_id long, normalized_url string")
    found = evidence.relations(posts, shared, evidence.candidates(posts, shared)).collect()
    pairs = {(min(r["from_id"], r["to_id"]), max(r["from_id"], r["to_id"])) for r in found}
    assert (200, 201) in pairs and all((i, j) in pairs for i in range(n) for j in range(i + 1, n))
    assert {(r["from_id"], r["to_id"]) for r in found if r["relation_type"] == "exact_duplicate"} >= {(300 + i, 360 + i) for i in range(60)}
    whole = evidence.clusters(posts, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    near = evidence.relations(posts, shared.limit(0), evidence.same_host(posts)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    assert sorted(whole) == sorted(evidence.clusters(posts, near.unionByName(evidence.stars(shared))).collect()) and {r["size"] for r in whole} == {n, 2}
