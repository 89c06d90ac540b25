"""The operators on documents and conversations against plain Python on small tables with edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("newsloom.llm")
from newsloom.llm import bpe, chat, jaccard, packing, passages, quality, scoring

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, __w int"


def words(n, seed=0):
    return [f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n)]


def texts():
    base, other = words(300), words(300, 5)
    near = base[:140] + ["changed"] + base[141:]
    passage = words(70, 9)
    return {
        1: " ".join(base),
        2: " ".join(near),
        3: " ".join(base),
        4: " ".join(other[:100] + passage + other[100:]),
        5: " ".join(words(90, 11) + passage + words(60, 12)),
        6: "",
        7: None,
        8: "One two Three",
        9: "one TWO three",
        10: "a b c d e\n a  b c d e f\x1f\na b c d e",
        11: " ".join(["same"] * 40),
        12: "It's <|endoftext|> 12 don't\n\n  x　 y \U0001f600 é<|endoftext|>",
        13: " ".join(words(4000, 3)),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", "s", None, "clash", i) for i, t in texts().items()] + [(None, "null id " + " ".join(words(60, 30)), "en", None, None, "clash", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs):
    sets = {i: shingles(t) for i, t in texts().items()}
    wanted = {}
    for i in sets:
        linked = [j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        wanted[i] = (len(sets[i]), min(linked, default=i))
    found = jaccard.join(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == wanted
    assert len(found) == len(sets) + 1 and jaccard.join(empty(docs)).count() == 0
    twice = {(r["doc_id"], r["component_id"]) for r in jaccard.join(docs.unionByName(docs)).collect()}
    assert twice == {(r["doc_id"], r["component_id"]) for r in found}


def test_jaccard_groups(spark, monkeypatch):
    """Tiles and column products give what all pairs give, on a family whose members are near to the threshold."""
    base = words(120)
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 9):
            w[(i * 13 + k * 17) % 120] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    wanted = {i: find(i) for i in sets}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for small, tile in ((400, 384), (3, 8)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.join(table).collect()} == wanted


def test_passages(docs):
    found = passages.find(docs).collect()
    pairs = {(r["doc_id"], r["source_id"]) for r in found}
    assert {(2, 1), (3, 1), (5, 4)} <= pairs and not {6, 7, 8, 9, 13} & {r["doc_id"] for r in found}
    span = next(r for r in found if (r["doc_id"], r["source_id"]) == (5, 4))
    assert (span["start"], span["stop"], span["source_start"]) == (90, 160, 100)
    kept = {r["doc_id"]: r["text"] for r in passages.remove(docs).collect()}
    all_texts = texts()
    assert kept[5].split() == all_texts[5].split()[:90] + all_texts[5].split()[160:] and kept[1] == all_texts[1] and kept[3] == "" and kept[7] is None
    assert passages.remove(docs).columns == docs.columns and passages.find(empty(docs)).count() == 0


def test_compact_windows():
    """Each window of the Cartesian tree, by its recursion."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(40)
    begin, width = np.array([0, 120, 120, 300]), 10
    hot = np.zeros(1 << jaccard.SLOT_BITS, bool)
    text, _, left, centre, right, kind = passages.compact_windows(x, begin, hot, width, 2)
    got = set(zip(*(a.tolist() for a in (text, left, centre, right, kind)), strict=True))
    wanted = set()
    for k in range(2):
        v = (passages.mix(x ^ passages._SEEDS[k]) >> np.uint64(1)).tolist()
        for t in range(3):
            stack = [(int(begin[t]), int(begin[t + 1]) - 1)]
            while stack:
                a, b = stack.pop()
                if b - a + 1 >= width:
                    c = min(range(a, b + 1), key=lambda i: (v[i], i))
                    wanted.add((t, a - int(begin[t]), c - int(begin[t]), b - int(begin[t]), k))
                    stack += [(a, c - 1), (c + 1, b)]
    assert got == wanted


def near_passages():
    """(words of the first text, words of the second, where the passage is) with one to three edits, Jaccard at least 0.75."""
    cases = [(60, (30,)), (60, (14,)), (55, (26,)), (90, (30, 60)), (100, (33, 66)), (120, (30, 60, 90)), (120, (40, 80)), (75, (20, 50))]
    for n, edits in cases:
        for seed in range(12):
            own = words(n, 1000 + 20 * n + seed)
            changed = [f"x{seed}" if i in edits else w for i, w in enumerate(own)]
            a, b = own, changed
            if seed % 3 == 1:  # a word more
                b = own[: edits[0]] + ["more"] + own[edits[0] :]
            one, other = shingles(" ".join(a)), shingles(" ".join(b))
            assert len(one & other) >= 0.75 * len(one | other)
            yield words(70, 5000 + seed) + a + words(50, 6000 + seed), words(40, 7000 + seed) + b + words(80, 8000 + seed), (40, 40 + len(b)), (n, edits, seed)


def test_edited_passages():
    """Every near passage whose texts have a min-hash of it in common is found whole, short of the runs beyond outer edits."""
    import numpy as np
    import pyarrow as pa

    hot, width = np.zeros(1 << jaccard.SLOT_BITS, bool), passages.LEAST - passages.SIZE + 1
    tried = 0
    for one, other, (low, high), case in near_passages():
        a, b = passages.Text.each(pa.array([" ".join(x) for x in (one, other)]))
        least = [set(passages.compact_windows(x.shingles, np.array([0, len(x.shingles)]), hot, width)[1].tolist()) for x in (a, b)]
        if len(least[0] & least[1]) < 2:
            continue
        tried += 1
        found = passages.shared_passages(a, b, width)
        assert found, case
        for start, end, _ in found:
            own = set(b.shingles[start : end + 1].tolist())
            assert start >= low and end + passages.SIZE <= high and end - start + 1 >= width
            assert len(own & set(a.shingles.tolist())) >= 0.75 * len(own)
        assert max(end + passages.SIZE - start for start, end, _ in found) >= 0.75 * (high - low), case
    assert tried > 70


def test_near_passage_recall(spark):
    """Near passages against brute force: 400 pairs of 50 to 60 words at Jaccard 0.75 to 0.85, at most one of them missed."""
    import random

    rng, rows = random.Random(5), []

    def fresh(n):
        return [f"r{rng.randrange(10**9)}" for _ in range(n)]

    for k in range(400):
        own = fresh(50 + k % 11)
        changed, n = list(own), 0
        while n < 2:  # edits at the ends cost least, and so two of them stay above the bound
            tried = list(changed)
            tried[rng.choice((0, 1, 2, len(own) - 1, len(own) - 2, rng.randrange(len(own))))] = f"e{k}x{n}"
            one, other = shingles(" ".join(own)), shingles(" ".join(tried))
            if len(one & other) < 0.75 * len(one | other):
                break
            changed, n = tried, n + 1
        rows.append((2 * k, " ".join(fresh(60) + own + fresh(60))))
        rows.append((2 * k + 1, " ".join(fresh(60) + changed + fresh(60))))
    found = {(r["doc_id"], r["source_id"]) for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({(2 * k + 1, 2 * k) for k in range(400)} - found) <= 1


def replaced(own, places, mark):
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(own)]


def test_drifting_copies(spark):
    """Each copy is near the one before it and not near the first: a settled text is a source for later ones."""
    rows = []
    for k in range(12):
        own = words(60, 100 * k + 7)
        second = replaced(own, (12,), f"s{k}x")
        third = replaced(second, (48,), f"t{k}x")  # 0.84 like the second, 0.70 like the first
        for i, passage in enumerate((own, second, third)):
            rows.append((10 * k + i, " ".join(replaced(range(80), range(80), f"a{k}x{i}x") + passage + replaced(range(80), range(80), f"b{k}x{i}x"))))
    found = {(r["doc_id"], r["source_id"]) for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(12):
        assert (10 * k + 1, 10 * k) in found and (10 * k + 2, 10 * k + 1) in found


def test_weaker_partner_first(spark):
    """Partners of smaller id that share 37 and more shingles around a centre and aren't similar don't hide one that is."""
    rows = []
    for k in range(12):
        own = words(90, 100 * k + 17)
        weak = [replaced(own, range(2 + i, 90, 18), f"v{k}x{i}x") for i in range(16)]  # stretches of 17 words, 0.64 alike at most
        for i, passage in enumerate((*weak, own, own)):
            rows.append((20 * k + i, " ".join(replaced(range(80), range(80), f"a{k}x{i}x") + passage + replaced(range(80), range(80), f"b{k}x{i}x"))))
    found = {(r["doc_id"], r["source_id"]) for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(12):
        assert (20 * k + 17, 20 * k + 16) in found


def test_quality(docs):
    def counts(t):
        w = WORD.findall(t or "")
        keys = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(keys)
        covered = {j for i, k in enumerate(keys) if often[k] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    found = {r["doc_id"]: r for r in quality.judge(docs).collect() if r["doc_id"] is not None}
    for i, t in texts().items():
        n = counts(t)
        assert tuple(found[i][c] for c in quality.COUNTS) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert found[i]["base_failed"] == failed and not (failed and found[i]["kept"])
    assert quality.judge(empty(docs)).count() == 0


def test_outliers(spark):
    rows = [(i, " ".join(words(80 + i % 40, i)), "en", "a") for i in range(80)] + [(100, " ".join(w + "%%%" for w in words(90, 99)), "en", "a"), (101, " ".join(w + "%%%" for w in words(90, 98)), "en", "few")]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in found.items() if not k] == [100, 101]  # the source with one row is judged by its language


def plain_mcd(v):
    """Squared distances by a minimum covariance determinant estimate of 60 random starts and one reweighting, in NumPy."""
    import numpy as np

    floor = np.diag([f**2 for _, f in quality.VECTOR])
    p = v.shape[1]

    def estimate(rows, share):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * quality.consistency(share) + floor

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)

    rng, best = np.random.default_rng(4), None
    for k in range(60):
        mean, cov = estimate(v[rng.choice(len(v), p + 1 if k else len(v), replace=False)], 0.75)
        size = np.inf
        for _ in range(100):
            d = distances(mean, cov)
            level = np.round(np.log(d + 1e-9) * 32)
            mean, cov = estimate(v[level <= np.sort(level)[int(np.ceil(0.75 * len(v))) - 1]], 0.75)
            now = np.linalg.slogdet(cov)[1]
            if now >= size - 1e-9:
                break
            size = now
        if best is None or size < best[0]:
            best = size, mean, cov
    mean, cov = estimate(v[distances(*best[1:]) <= quality.quantile(0.025)], 0.975)
    return distances(mean, cov)


def test_outliers_against_numpy(spark):
    """Verdicts by groups are those of a search over many starts."""
    import math
    import random

    import numpy as np

    rng, rows = random.Random(9), []
    for group in range(3):
        for i in range(150):
            n = rng.randrange(40, 300)
            mark = rng.choice(("", "", "", "#", "%%")) if i % 9 else "$$$$$$"
            size = 3 + group if i % 13 else 17
            lines = ["\n" if rng.random() < 0.05 else " " for _ in range(n)]
            rows.append((1000 * group + i, "".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, size + 3))) + (mark if rng.random() < 0.3 else "") + x for x in lines), "en", f"s{group}"))
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    for group in range(3):
        own = found[found.index // 1000 == group]
        own = own[~own.base_failed]
        grid = lambda x: math.floor(x * 1024 + 0.5) / 1024
        v = np.array([[grid(math.log(r.n_words)), grid(math.log((r.word_chars + 1) / r.n_words)), grid(math.log1p(10 * r.n_symbols / r.n_words)), grid(math.log1p(100 * r.n_dup_lines / (r.n_words + 20))), grid(math.log1p(10 * r.n_repeat_words / r.n_words))] for r in own.itertuples()])
        d = plain_mcd(v)
        assert (own.kept.to_numpy() == (d <= quality.quantile(quality.LEVEL))).all() and 0 < (~own.kept).sum() < 60


def test_quantiles():
    """Values of the published tables of the chi-square distribution."""
    assert quality.quantile(0.05) == pytest.approx(11.070, abs=1e-3) and quality.quantile(0.01, 7) == pytest.approx(18.475, abs=1e-3)
    assert quality.consistency(0.999999) == pytest.approx(1, abs=1e-3)


def test_bpe(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    found = {r["doc_id"]: r for r in bpe.encode(docs, VOCABULARY, outputs=outputs).collect()}
    for i, t in texts().items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == (t or "")
        assert found[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert bpe.encode(empty(docs), VOCABULARY).count() == 0
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert {r["doc_id"]: r["decoded"] for r in back.collect() if r["doc_id"]} == {i: t or "" for i, t in texts().items()}


def test_bpe_slices(monkeypatch):
    codec = bpe.Codec(VOCABULARY)
    long = " ".join(words(500)) + "\n\n" + "x" * 300 + "  end é ő"
    whole = next(codec.encode([long])).tolist()
    monkeypatch.setattr(bpe, "SLICE", 64)
    assert next(bpe.Codec(VOCABULARY).encode([long])).tolist() == whole


def test_packing(docs):
    found = packing.pack(docs, VOCABULARY, capacity=256).collect()
    ids = {r["doc_id"]: r["ids"] + [0] for r in bpe.encode(docs, VOCABULARY).collect()}
    bins, starts = {}, {}
    for r in found:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 256 and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        starts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for i, own in starts.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at)
            at += length
        assert at == len(ids[i])
    assert len(bins) <= -(-sum(map(len, ids.values())) // 256) + 1
    assert packing.pack(empty(docs), VOCABULARY).count() == 0


@pytest.mark.parametrize("large", [0.25, 0.45])
def test_plan_places_all(large):
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = Counter(rng.integers(1, 257, 3000).tolist())
    chosen = packing.plan(dict(sizes), 256, 16, (large,))
    placed = Counter()
    for lengths, t in chosen:
        assert sum(lengths) <= 256
        for n in lengths:
            placed[n] += t
    assert placed == sizes


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok \\ \\n \\s <\\p"
    rows = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", "é\n"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example_no", F.lit(1))
    found = {r["conv_id"]: r for r in chat.digest(chat.expand(table)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))]
        loss = "".join(t for r, t in own if r == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand(table).where("conv_id = 1").count() == 3 and chat.expand(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [scoring.BLOCK, 900])
def test_scoring(docs, monkeypatch, block):
    """Losses against a plain model over the same vocabulary, with all texts of a task in a block or in several."""
    import math

    monkeypatch.setattr(scoring, "BLOCK", block)
    found = {r["doc_id"]: r for r in scoring.cross_entropy_difference(docs, docs.where("doc_id IN (1, 2)").select("doc_id")).collect() if r["doc_id"] is not None}
    lists = {i: [w.lower() for w in WORD.findall(t or "")] for i, t in texts().items()}
    null = WORD.findall("null id " + " ".join(words(60, 30)))
    for name, chosen in (("background_loss", [*lists.values(), null]), ("target_loss", [lists[1], lists[2]])):
        single, pair, before = Counter(w for x in chosen for w in x), Counter(p for x in chosen for p in zip(x, x[1:], strict=False)), Counter(w for x in chosen for w in x[:-1])
        vocabulary = {w for x in [*lists.values(), null] for w in x}
        total = sum(single.values()) + scoring.SMOOTH * (len(vocabulary) + 1)
        for i, own in lists.items():
            if not own:
                assert found[i][name] is None and found[i]["n_tokens"] == 0
                continue
            losses = []
            for k, w in enumerate(own):
                p = (single[w] + scoring.SMOOTH) / total
                if k and before[own[k - 1]]:
                    p = scoring.MIX * pair[own[k - 1], w] / before[own[k - 1]] + (1 - scoring.MIX) * p
                losses.append(-math.log(p))
            assert found[i][name] == pytest.approx(sum(losses) / len(losses), rel=1e-5)
    assert scoring.cross_entropy_difference(empty(docs), docs.select("doc_id")).count() == 0


def test_jaccard_repeated_ids(spark):
    """The links of all rows of an id count, whichever is longest."""
    short = words(57, 61)
    rows = [(1, " ".join(words(400, 62))), (1, " ".join(short)), (2, " ".join([*short, "tail"])), (2, None), (3, " ".join(words(60, 63)))]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == len(rows) and {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 3)}


def test_passages_repeated_ids(spark):
    """Spans belong to a row: other rows of the id are left as they are."""
    passage, more, foreign = words(80, 71), words(50, 72), words(300, 73)
    rows = [(1, " ".join(passage)), (2, " ".join(passage + more)), (2, " ".join(foreign)), (3, " ".join(foreign[:90])), (3, " ".join(foreign[:90])), (None, " ".join(passage)), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, __id int").repartition(3)
    left = {r["__id"]: r["text"] for r in passages.remove(docs).collect()}
    assert len(left) == len(rows)
    assert [left[n] for n in (0, 2, 5, 6, 7)] == [" ".join(passage), " ".join(foreign), " ".join(passage), None, ""]
    assert left[1].split() == more and left[3].split() == left[4].split() == []
    assert {(r["doc_id"], r["source_id"]) for r in passages.find(docs).collect()} == {(2, 1), (3, 2)}


def test_cut_out_of_text():
    import pyarrow as pa

    cut = lambda *spans: passages._cut(pa.array(["é one two  three ", None, ""]), pa.array([[s for s, _ in spans], None, None]), pa.array([[e for _, e in spans], None, None])).to_pylist()
    assert cut((1, 3), (2, 3)) == ["é   three ", "", ""] and cut((0, 4)) == [" ", "", ""]
    with pytest.raises(ValueError):
        cut((3, 5))


def test_repeated_rows(spark):
    """Repeated rows, ids with several texts, null ids and very long texts, row by row."""
    from newsloom.llm import _shared

    long = " ".join(words(30_000, 5))
    said = [(1, "one two three " * 5), (1, "one two three " * 5), (1, "other words here"), (None, "null id text"), (None, None), (2, long), (2, long), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in said], "doc_id long, text string, lang string, source string, n_tokens int").repartition(3)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in said]
    digest = lambda x: hashlib.sha256(b"".join(v.to_bytes(4, "little") for v in x)).hexdigest()
    found = bpe.encode(docs, VOCABULARY, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in found) == sorted((str(i), len(x), digest(x)) for (i, _), x in zip(said, ids, strict=True))
    pieces = packing.pack(docs, VOCABULARY, capacity=512).collect()
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in ids) and max(r["offset"] + r["length"] for r in pieces) <= 512
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(i for i, _ in said)
    spans = {}
    for r in pieces:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    scores = scoring.cross_entropy_difference(docs, docs.where("doc_id = 1").select("doc_id")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in scores) == sorted((str(i), len(WORD.findall(t or ""))) for i, t in said)
    assert len({r["difference"] for r in scores if r["n_tokens"] == 15}) == 1
    judged = quality.judge(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in judged) == sorted((str(i), len(WORD.findall(t or ""))) for i, t in said)
    assert all(r["kept"] == (not r["base_failed"]) for r in judged)  # too few rows for an estimate
    assert _shared.spread(docs.limit(0)).count() == 0


def test_driver_gives_memory_back(spark):
    from newsloom.llm import _shared

    assert "->" in _shared.trim(spark)


def test_scoring_answers_ranges_one_by_one(docs, monkeypatch):
    """No shuffle has all requests, and those that are answered go."""
    answers, seen = scoring._answers, []

    def run(requests, *rest):
        size = lambda: requests.sparkSession.read.parquet(requests.inputFiles()[0].rpartition("/kind=")[0]).where("kind <> 'text'").agg({"n_keys": "sum"}).first()[0]
        seen.append((requests.selectExpr("sum(octet_length(keys))").first()[0], size()))
        return answers(requests, *rest)

    monkeypatch.setattr(scoring, "_answers", run)
    assert scoring.cross_entropy_difference(docs, docs.where("doc_id = 1").select("doc_id")).count() == docs.count()
    assert len(seen) == scoring.RANGES and max(x for x, _ in seen) < 0.4 * sum(x for x, _ in seen)
    assert all(b < 0.9 * a for (_, a), (_, b) in zip(seen, seen[1:], strict=False))


def test_scoring_without_words(spark):
    """A block, and a whole table, of texts without words."""
    rows = spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id long, text string").repartition(2)
    found = scoring.cross_entropy_difference(rows, rows.select("doc_id")).collect()
    assert {(r["doc_id"], r["n_tokens"], r["difference"]) for r in found} == {(1, 0, None), (2, 0, None), (None, 0, None)}


def test_scoring_tells_copies_apart(spark):
    """By the default parameters, texts of words that nobody else uses score apart when they occur twice."""
    rows = [(i, " ".join(f"only{i}x{k}" for k in range(60))) for i in range(40)] + [(100 + i, " ".join(f"only{i}x{k}" for k in range(60))) for i in range(10)]
    rows += [(200 + i, " ".join(words(80, 900 + i))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["difference"] for r in scoring.cross_entropy_difference(docs, docs.where("doc_id >= 200").select("doc_id")).collect()}
    twice, once = [found[i] for i in (*range(10), *range(100, 110))], [found[i] for i in range(10, 40)]
    assert max(twice) < min(once)


def test_jaccard_copies_are_one_row(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(100 * copy + k, t) for copy in range(8) for k, t in enumerate(texts)] + [(2, texts[1]), (None, texts[0]), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for few in (0, 100):  # merged, broadcast
        jaccard_few, jaccard.FEW = jaccard.FEW, few
        try:
            sets = jaccard.one_of_each(jaccard.stored(jaccard.prefixes(docs, jaccard.counted(docs))), jaccard.shared_dir(spark)).collect()
        finally:
            jaccard.FEW = jaccard_few
        assert len(sets) == len(rows)
        kept = [(r["doc_id"], tuple(sorted(r["prefix"]))) for r in sets if r["prefix"]]
        assert sorted(d for d, _ in kept) == [0, 1, 2] and len({p for _, p in kept}) == 3
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert all(found[100 * copy + k] == (0 if k == 0 else 1) for copy in range(8) for k in range(3))  # 2 has two texts: 1's and its own
    assert found[7] == 7 and found[None] is None


def test_jaccard_in_rounds(spark, monkeypatch):
    """Tiles leave out sizes that can't be linked and hold all pairs that can; rounds and ranges lose no link."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "TILE", 4)
    rows = [(g, i, n) for g in (0, 1) for i, n in enumerate([10, 10, 12, 13, 13, 20, 40, 41, 45, 60, 80, 80, 81, 200, 201, 202, 203])]
    placed = jaccard.dealt(spark.createDataFrame(rows, "group long, id long, n long")).collect()
    at = {(r["group"], r["id"]): r for r in placed}
    for g, i, n in rows:
        for h, j, m in rows:
            if g == h and 4 * min(n, m) >= 3 * max(n, m):
                assert at[g, j]["part"] in at[g, i]["with"]
    assert len(at) == len(rows) and sum(len(r["with"]) for r in placed) < len(rows) * 5 - 20  # every part with every other before
    table = [(i, " ".join(["common"] * 5 + words(60, 40 + i % 7)[: 40 + i % 5] + words(12, 60 + i % 3)[: i % 13])) for i in range(60)]
    sets = {i: shingles(t) for i, t in table}
    least = dict.fromkeys(sets)
    for i in sets:
        least[i] = i
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 75 * len(x | y):
                    least[i] = min(least[i], least[j])
    asked = []
    monkeypatch.setattr(jaccard, "ROUND", 0)
    monkeypatch.setattr(jaccard, "rounds", lambda work, whole: asked.append(work) or 3)
    found = jaccard.join(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == least and len(asked) == 3 and sum(asked) > 0
