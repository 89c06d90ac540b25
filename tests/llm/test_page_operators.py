"""WARC, main text and embeddings against plain Python on small tables with edge cases."""

import base64
import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("newsloom.llm")
from newsloom.llm import html, neighbours, warc
from newsloom.llm._shared import components, shared_dir, stored

PAGES = "page_id long, url string, html string, digest string"


def page(k, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t="</p>";f({k})</script></head><body><nav><ul><li><a href="/{k}">m{k}</a></li></ul></nav>'
        f'<!-- ad --><div class="ad">buy {k}</div><article><h1>Head {k} &amp; more</h1><p><b>First {k}</b>\n  line<br>two<p>Second &eacute; {k}</p>{extra}</article>'
        f'<div id="comments"><p>reader {k}</p></div><aside>side</aside><form><p>field</p></form><footer>&copy; x</footer></body></html>'
    )


def wanted(k):
    return f"Head {k} & more\n\nFirst {k} line two\n\nSecond é {k}"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://www.host{k % 2}.org/{k}", page(k), "x") for k in range(24)]
    rows += [(100, None, page(100), "x"), (101, "https://host0.org/a", page(3), "x"), (102, "u", None, "x"), (103, "u", "", "x"), (104, "u\r\nv", "<p>unclosed <b>bold", "x"), (None, "u", page(3), "x"), (None, "v", "alone", "x")]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_warc(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    best = {}
    for i, body in rows:
        if i is not None:
            best[body] = max(i, best.get(body, i))
    expected = sorted(
        (str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if best.get(b) in (i, None) else ("revisit", best[b]))) for i, b in rows
    )
    found = warc.round_trip(pages).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == expected
    assert {r["page_id"]: bytes(r["html"]).decode() for r in found if r["record_type"] == "response" and r["page_id"] == 5} == {5: page(5)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    short = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, least=10).collect()}
    assert short[102] == short[103] == "response"


def test_normalised_members(spark, pages):
    """Each member of the index inflates to one record; the whole file is what the monolithic one held."""
    folder = shared_dir(spark)
    raw = stored(warc.write(warc.deduplicated(pages), folder), folder)
    done = warc.normalise(raw, folder).collect()
    assert sum(r["n"] for r in done) == pages.count()
    fs, base = warc._files(folder)
    for r in done:
        with fs.open_input_stream(f"{base}/members/{r['path']}", compression=None) as f:
            packed = f.read()
        with fs.open_input_stream(f"{base}/members/{r['path']}.idx", compression=None) as f:
            index = [json.loads(x) for x in f.read().decode().splitlines()]
        assert [e["offset"] for e in index] == [sum(e["length"] for e in index[:k]) for k in range(len(index))] and sum(e["length"] for e in index) == len(packed)
        for e in index:
            assert zlib.decompress(packed[e["offset"] : e["offset"] + e["length"]], 31).startswith(b"WARC/1.1\r\n")


def test_broken_archive():
    import io

    body = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = body.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort") + body.flush()
    reader = warc.Inflated(io.BytesIO(packed))
    assert warc.header(reader.until(b"\r\n\r\n"))["content-length"] == "50"
    with pytest.raises(ValueError):
        list(reader.parts(50))


def test_main_text(pages):
    found = {r["page_id"]: r["text"] for r in html.extract(pages).collect() if r["page_id"] is not None}
    for k in (*range(24), 100):
        assert found[k] == wanted(k)
    assert found[101] == wanted(3) and found[102] == found[103] == "" and found[104] == "unclosed bold"
    assert html.extract(pages.limit(0)).count() == 0
    assert html.extract(pages).where("n_chars <> char_length(text)").count() == 0


def test_template_without_article(spark):
    """Text that all pages of a host have is its template, also where no element says so."""
    rows = [(k, "http://h.org/", f"<body><div><p>Welcome to our site</p></div><div><p>Story {k} {'long text ' * 20}</p><p>More of {k}</p></div></body>") for k in range(12)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Story {k} {('long text ' * 20).strip()}\n\nMore of {k}" for k in range(12))


LAYOUTS = {
    "wrapper": '<div class="content-sidebar-wrap"><article><h1>Head {k}</h1><p>Story {k} told.</p><p class="share-price">Price {k}</p></article></div><div class="sidebar">aside {k}</div>',
    "own header": '<article><header><h1>Head {k}</h1></header><div class="entry-header"><p>Story {k} told.</p></div><p>Price {k}</p><footer>by {k}</footer></article>',
    "marked headline": '<article><div class="header"><h1>Head {k}</h1></div><p>Story {k} told.</p><p>Price {k}</p><div class="share-buttons"><p>share {k}</p></div></article>',
    "teaser": '<main><article><h1>Head {k}</h1><p>Story {k} told.</p><p>Price {k}</p></article><article><p>read on</p></article></main><article><p>old {k}</p></article>',
    "form around": '<form id="aspnetForm"><div id="main"><h1>Head {k}</h1><p>Story {k} told.</p><p>Price {k}</p></div></form>',
    "newsletter": '<div class="newsletter"><p>Subscribe to {k} long letters a week and never miss what others read</p></div><div><h1>Head {k}</h1><p>Story {k} told.</p><p>Price {k}</p></div>',
    "columns": '<div class="menu"><a href="/{k}">m{k}</a></div><div class="intro"><h1>Head {k}</h1></div><div class="body"><p>Story {k} told.</p></div><div class="body2"><p>Price {k}</p></div><footer>f</footer>',
    "math": "<article><h1>Head {k}</h1><p>Story <math><mi>{k}</mi></math> told.<svg><text>no</text></svg></p><p>Price {k}</p></article>",
}


@pytest.mark.parametrize("count", [1, 12])
def test_layouts(spark, count):
    """Known articles of several layouts, on hosts with a template and on hosts of one page."""
    rows = [(100 * n + k, f"http://h{n}.org/{k}", f"<html><head><title>t</title></head><body><nav><ul><li>menu {k}</li></ul></nav>{x.format(k=k)}</body></html>") for n, x in enumerate(LAYOUTS.values()) for k in range(count)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, name in enumerate(LAYOUTS):
        for k in range(count):
            assert found[100 * n + k] == f"Head {k}\n\nStory {k} told.\n\nPrice {k}", name


def test_partitions_do_not_matter(spark):
    """Copies of a page count once, wherever they are."""
    body = "<body><div><p>Welcome to our site</p></div><div><p>Story {k} {more}</p></div></body>"
    rows = [(10 * c + k, "http://h.org/", body.format(k=k, more="long text " * 9)) for k in range(5) for c in range(5)]
    results = []
    for n in (1, 10):
        table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert html.tokens(table).where("token = 0").count() == 5
        results.append({r["page_id"]: r["text"] for r in html.extract(table).collect()})
    assert results[0] == results[1] and all("Welcome" not in t and t.startswith("Story") for t in results[0].values())


def test_deep_pages():
    import time
    import tracemalloc

    deep = "<div>" * 40_000 + "<p>text" + "</div>" * 40_000 + "<p>after"
    inline = "<p>" + "<b>" * 40_000 + "bold" + "</b>" * 40_000
    began = time.time()
    tracemalloc.start()
    assert html.Page(deep).text(None, set()) == "text\n\nafter" and html.Page(inline).text(None, set()) == "bold"
    assert tracemalloc.get_traced_memory()[1] < 100e6 and time.time() - began < 30
    tracemalloc.stop()


def test_marks():
    assert all(html.marked(x) for x in ("ad", "post comments", "adSlot", "main-menu", "sidebar-left", "cookie_notice"))
    assert not any(html.marked(x) for x in ("share-price", "entry-header", "content-sidebar-layout", "headers", "adjective", "story-body", ""))


def brute(vectors, cosine=0.9):
    import numpy as np

    good = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= cosine] for i, _ in vectors if i in unit}
    out = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("leaf, tile, hot", [(1500, 2500, 0), (40, 30, 0), (60, 25, 150)])
def test_forest(spark, leaf, tile, hot):
    """All links, with one leaf, with many and split leaves, and with a dense cluster in a ball."""
    rng = random.Random(leaf + hot)
    gauss = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(i, gauss(16)) for i in range(400)]
    for i in range(400, 520):
        v = rng.choice(rows)[1]
        rows.append((i, [x + rng.gauss(0, 0.12) for x in v]))
    centre = gauss(16)
    rows += [(1000 + i, [x + rng.gauss(0, 0.1 if i % 5 else 0.35) for x in centre]) for i in range(hot)]
    rows += [(2000 + i, list(rows[3][1])) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [float("inf")] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, [2.0, 4.0])]
    expected = brute(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.dedup(table, leaf=leaf, tile=tile, trees=8).collect()}
    assert found.keys() == expected.keys()
    recall = sum(v[0] for v in found.values()) / sum(v[0] for v in expected.values())
    assert 0.98 <= recall <= 1
    if leaf == 1500:
        assert found == expected


def test_forest_splits_large_leaves(spark, monkeypatch):
    """With a sample far too small for the table, leaves are split on, and pairs are counted once."""
    rng = random.Random(3)
    gauss = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(i, gauss(16)) for i in range(2500)]
    for i in range(2500, 2800):
        rows.append((i, [x + rng.gauss(0, 0.1) for x in rng.choice(rows)[1]]))
    rows += [(3000 + i, [1.0 + rng.gauss(0, 1e-9)] + [0.5] * 15) for i in range(300)]  # can't be split
    monkeypatch.setattr(neighbours, "SPLIT", 150)
    monkeypatch.setattr(neighbours, "TASK", 100)
    monkeypatch.setattr(neighbours, "balls", lambda sample, cosine: sample[:0])
    expected = brute(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    seen = []
    split = neighbours._split
    monkeypatch.setattr(neighbours, "_split", lambda *a: seen.append(split(*a)) or seen[-1])
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.dedup(table, leaf=30, tile=50, trees=10, sample=100).collect()}
    sizes = {r["leaf"]: r["n"] for r in seen[0][1].collect()}
    assert len(sizes) > 200 and max(sizes.values()) < 600  # the 300, and less of others
    assert all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(v[0] for v in found.values()) >= 0.98 * sum(v[0] for v in expected.values())


@pytest.mark.parametrize("fan, at_once", [(512, 300e6), (8, 0)])
def test_forest_sends_a_vector_once_a_tree(spark, monkeypatch, fan, at_once):
    """In one leaf of each tree, by one level or two, all trees at once or one by one; pairs just above the threshold are found and counted once."""
    import numpy as np

    gauss = np.random.default_rng(8).normal
    first = neighbours.unit(gauss(size=(1500, 64)))
    away = gauss(size=(300, 64))
    away = neighbours.unit(away - (away * first[:300]).sum(axis=1)[:, None] * first[:300])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((first, 0.902 * first[:300] + np.sqrt(1 - 0.902**2) * away)))]
    monkeypatch.setattr(neighbours, "FAN", fan, raising=False)
    monkeypatch.setattr(neighbours, "AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(neighbours, "OF_INPUT", at_once, raising=False)
    split, placed = neighbours._split, []

    def counted(*a):
        out = split(*a)
        placed.append(out[0].count())
        return out

    monkeypatch.setattr(neighbours, "_split", counted)
    found = neighbours.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), leaf=100, trees=10).collect()
    assert sum(placed) == 10 * len(rows) and len(placed) == (1 if at_once else 10)
    assert all(r["n_links"] <= 1 for r in found) and sum(r["n_links"] for r in found) >= 0.97 * 600
    assert all(r["component_id"] == r["vec_id"] % 1500 for r in found if r["n_links"])


def test_trees_grow_slowly():
    assert neighbours.trees_for(10**9) <= 40


def test_forest_repeated_ids(spark):
    """Equal ids with different vectors are one vertex; every row is returned; equal vectors link."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0]), (5, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).repartition(3)
    found = neighbours.dedup(table).collect()
    assert len(found) == len(rows)
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in found} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (5, 5, True)}


def test_trees_grow_with_the_table():
    assert [neighbours.trees_for(n) for n in (10, 10_000, 10**6, 10**9)] == sorted(neighbours.trees_for(n) for n in (10, 10_000, 10**6, 10**9))
    assert neighbours.trees_for(50_000) >= 8


def test_forest_empty(spark):
    assert neighbours.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark))
    assert {r["id"]: r["component"] for r in found.collect()} == {x: find(x) for x in parent}
