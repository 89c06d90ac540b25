"""Substring dedup by compact windows.

A text is a sequence of five-word shingles. For each of HASHES hash functions, the Cartesian tree over its values has a node for
every shingle that is the least of a stretch; a node (l, c, r) whose stretch has at least the least length is a compact
window, and stands for all passages inside l..r that hold c, as they share the min-hash at c. Windows of equal min-hash are
joined; two texts that share two are verified: runs of equal shingles are chained, and stretches of a Jaccard similarity of 0.75
or more are passages.

A min-hash of m windows isn't multiplied out to m * m aligned pairs: every text is compared with the first one; windows whose
centre lies in a verified passage are settled. For the rest of the min-hash the shingles around the centres are multiplied out
in tiles with those of all its texts, settled ones too, and each text is compared with those before it that share enough of
them: in rounds, the first ones first, as long as none settles it. Stretches with very few different shingles (a word said again
and again) are compared with the first text that has their min-hash, and not multiplied out. So that a short line that many
texts share doesn't gather such rests, the shingles of short lines that a fixed-size count of all texts shows to be frequent
come last in every hash function's order: they are centres only where nothing else is in a whole window.

Copies of whole texts are found by a hash first: each is a passage of the first one, and takes no part in the rest.

Results are passages of a text that an earlier one (by doc_id) has too; removing them leaves the first one.

Defined results: null, empty and short texts have no passages. Repeated doc_ids: every different text of an id is a text of its
own, after the id's others of lesser hash; equal rows (id and text) are one text, and removal applies to each of them. A null
doc_id is left as it is. Texts are read whole. An empty table gives no rows. Further columns are kept by remove().
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._shared import forget, mix, release, shared_dir, stored, text_chunks, tune, windows, words
from .jaccard import SLOT_BITS, counted, few, frequent, product, whole_groups

#: Words of the shortest passage, hash functions (two must agree), similarity, words of a shingle.
LEAST, HASHES, SIMILARITY, SIZE = 50, 6, 0.75, 5
#: Rows of a tile's side where a min-hash is multiplied out.
SIDE = 256
#: Shingles of even hash that surroundings must share: of the 37 and more that a passage has, fewer are even in one case of 1,000.
SHARED = 10
#: Copies whose ids are broadcast.
FEW = 500_000
#: Candidates of a text, min-hash and tile that are verified in each round, while none before settles it; in the last all that are left.
ROUNDS = (6, None)
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64)


def _lines(shingles: np.ndarray, begin: np.ndarray, hot: np.ndarray, longest: int) -> np.ndarray:
    """Marks runs of frequent shingles inside one text that are shorter than `longest`: lines that many texts share."""
    often = hot[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    start = often & ~np.concatenate(([False], often[:-1]))
    inner = begin[(begin > 0) & (begin < len(often))]
    start[inner] = often[inner]
    run = np.cumsum(start)
    return often & (np.bincount(run, weights=often)[run] < longest)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each run of `width`."""
    done = 1
    while 2 * done <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def compact_windows(shingles: np.ndarray, begin: np.ndarray, hot: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """(text, min-hash, l, c, r) of the compact windows of every text; begin bounds the texts' shingles, hot are the frequent slots.

    Only shingles that are the least of some run of `width` can be centres, and the nearest lesser value of a centre is a
    centre itself, so the tree is built over these few alone. Of equal values the first counts as less.
    """
    n, texts = len(shingles), len(begin) - 1
    if n < width or not (np.diff(begin) >= width).any():
        return tuple(np.zeros(0, np.uint64 if i == 1 else np.int64) for i in range(6))
    late = _lines(shingles, begin, hot, width - 6).astype(np.uint64) << np.uint64(63)
    value = np.concatenate([mix(shingles ^ _SEEDS[k]) >> np.uint64(1) | late for k in range(hashes)])  # all functions, one after another
    bounds = np.concatenate([*(begin[:-1] + k * n for k in range(hashes)), [hashes * n]])
    long = np.diff(bounds) >= width
    change = np.zeros(len(value) + 1, np.int64)
    np.add.at(change, bounds[:-1][long], 1)
    np.add.at(change, bounds[1:][long] - width + 1, -1)
    low = np.where(np.cumsum(change[: len(value)])[: len(value) - width + 1] > 0, _sliding(value, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), width, np.maximum) == value)
    owner = np.searchsorted(bounds, places, "right") - 1
    left, right = _nearest(value[places], owner)
    left = np.where(left >= 0, places[left] + 1, bounds[owner])
    right = np.where(right < len(places), places[np.minimum(right, len(places) - 1)] - 1, bounds[owner + 1] - 1)
    keep = right - left + 1 >= width
    places, owner, left, right = places[keep], owner[keep], left[keep], right[keep]
    kind, start = owner // max(texts, 1), bounds[owner]
    return owner % max(texts, 1), mix(shingles[places - kind * n] + _SEEDS[hashes + kind]), left - start, places - start, right - start, kind


def _nearest(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, the place of the nearest one before it that isn't greater and after it that is less, of the same owner.

    Everybody points at a neighbour and goes on to where that points while it doesn't serve, so pointers grow together. -1 and
    len(value): none.
    """
    n = len(value)
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    if n:
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        left[first] = -1
        right[np.concatenate((first[1:], [True]))] = n
    open_left, open_right = np.flatnonzero(left >= 0), np.flatnonzero(right < n)
    while len(open_left):
        open_left = open_left[value[left[open_left]] > value[open_left]]
        left[open_left] = left[left[open_left]]
        open_left = open_left[left[open_left] >= 0]
    while len(open_right):
        open_right = open_right[value[right[open_right]] >= value[open_right]]
        right[open_right] = right[right[open_right]]
        open_right = open_right[right[open_right] < n]
    return left, right


def min_hashes(docs: DataFrame, hot: np.ndarray, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, hs, cs): the min-hashes of each text's compact windows and the shingles that have them, their centres."""
    width = least - SIZE + 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = batch.column(0)
            for row, raw, bounds in text_chunks(batch.column(1)):
                hashes, _, _, first = words(raw, bounds, True)
                text, value, _, centre, _, _ = compact_windows(*windows(hashes, first, SIZE), hot, width)
                order = np.lexsort((centre, value, text))
                text, value, centre = text[order], value[order], centre[order]
                order = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))[: len(text)])  # the first centre of each min-hash
                offsets = pa.array(np.searchsorted(text[order], np.arange(len(bounds))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value[order].view(np.int64), centre[order].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(bounds) - 1), pa.array(np.diff(first)), *lists], ["doc_id", "n_words", "hs", "cs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, hs array<long>, cs array<int>")


class Text:
    """A text's shingles, in its order and sorted."""

    def __init__(self, shingles: np.ndarray) -> None:
        self.shingles = shingles

    @classmethod
    def each(cls, texts: pa.Array) -> Iterator["Text"]:
        """Every text of a column, whose words are hashed together."""
        for _, raw, bounds in text_chunks(texts):
            hashes, _, _, first = words(raw, bounds, True)
            shingles, begin = windows(hashes, first, SIZE)
            for low, high in zip(begin.tolist(), begin[1:].tolist(), strict=False):
                yield cls(shingles[low:high])

    @functools.cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.shingles, kind="stable")

    @functools.cached_property
    def sorted(self) -> np.ndarray:
        return self.shingles[self.order]

    @functools.cached_property
    def again(self) -> np.ndarray:
        """How many shingles before each place stand before too."""
        twice = np.zeros(len(self.shingles), np.int64)
        twice[self.order[1:]] = self.sorted[1:] == self.sorted[:-1]
        return np.concatenate(([0], np.cumsum(twice)))


def shared_passages(a: Text, b: Text, width: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(first shingle of b, last shingle of b, first shingle of a) of every similar stretch of the two texts.

    Runs of equal shingles are chained, from the longest one on, to both sides. In a similar stretch of several runs each gap
    costs at least 2 * (SIZE - 1) shingles, so that its longest run has (SIZE - 1) * similarity / (1 - similarity) or more:
    shorter ones needn't be begun with.
    """
    if len(a.shingles) < width or len(b.shingles) < width:
        return []
    found = _runs(a, b)
    if found is None:
        return []
    inside, b_at, a_at, n = found
    total = np.concatenate(([0], np.cumsum(inside)))
    shortest = (SIZE - 1) * similarity / (1 - similarity)
    if (total[width:] - total[:-width]).max() < 2 * similarity / (1 + similarity) * width - 2:  # no stretch has as many as a passage asks for
        return []
    b_at, a_at, n = _grown(a.shingles, b.shingles, b_at, a_at, n)
    if n.max() < shortest:
        return []
    covered = np.zeros(len(b.shingles), bool)
    out: list[tuple[int, int, int]] = []
    chains = _Chains(a_at, b_at, n, similarity)
    hopeless: set[int] = set()
    for k in np.argsort(-n, kind="stable").tolist():
        if n[k] < shortest:
            break
        if k in hopeless or covered[b_at[k] + n[k] // 2]:
            continue
        runs, mid, members = chains.through(k)
        matches = np.concatenate(([0], np.cumsum(runs[:, 2])))
        share = similarity / (1 + similarity)
        gain = matches[:-1] - share * (_place(a, runs[:, 0]) + _place(b, runs[:, 1]))
        loss = matches[1:] - share * (_place(a, runs[:, 0] + runs[:, 2]) + _place(b, runs[:, 1] + runs[:, 2]))
        after, before = np.maximum.accumulate(loss[::-1])[::-1], np.minimum.accumulate(gain)
        hope = runs[:, 2] >= similarity * width  # long enough alone; or else there is a similar stretch with a run beside it
        hope[:-1] |= after[1:] >= before[:-1] - 1e-6
        hope[1:] |= after[1:] >= before[:-1] - 1e-6
        hopeless.update(m for m, h in zip(members, hope.tolist(), strict=True) if not h)
        if not hope[mid]:
            continue
        best = _best(a, b, (runs, mid), width, similarity)
        if best:
            out.append(best)
            covered[best[0] : best[1] + 1] = True
    return out


def _place(text: Text, at: np.ndarray) -> np.ndarray:
    """Different shingles before each place."""
    return at - text.again[at]


def _runs(a: Text, b: Text) -> tuple[np.ndarray, ...] | None:
    """Which shingles of b a has, and runs of them: where they begin in b and in a, and lengths. None: there is none."""
    at = np.minimum(np.searchsorted(a.sorted, b.shingles), len(a.sorted) - 1)
    inside = a.sorted[at] == b.shingles
    if not inside.any():
        return None
    place = np.where(inside, a.order[at], -2)
    on = inside[1:] & inside[:-1] & (place[1:] == place[:-1] + 1)
    first = np.flatnonzero(inside & ~np.concatenate(([False], on)))
    last = np.flatnonzero(inside & ~np.concatenate((on, [False])))
    return inside, first, place[first], last - first + 1


def _grown(one: np.ndarray, other: np.ndarray, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each run made as long as it can be, in their order: a shingle that `one` has several times may have ended it."""
    right, left = np.zeros(len(b), bool), np.zeros(len(b), bool)
    can = (b + n < len(other)) & (a + n < len(one))
    right[can] = other[(b + n)[can]] == one[(a + n)[can]]
    can = (b > 0) & (a > 0)
    left[can] = other[b[can] - 1] == one[a[can] - 1]
    done: dict[int, int] = {}  # by diagonal, the end of the last run
    for k in np.flatnonzero(right | left).tolist():
        x, y, m = int(a[k]), int(b[k]), int(n[k])
        if done.get(x - y, -1) >= y + m:
            n[k] = 0  # part of a run before it
            continue
        m += _equal(one[x + m :], other[y + m :]) if right[k] else 0
        back = _equal(one[:x][::-1], other[:y][::-1]) if left[k] else 0
        a[k], b[k], n[k] = x - back, y - back, m + back
        done[x - y] = y + m
    if not done:
        return b, a, n
    order = np.lexsort((a, b))
    b, a, n = b[order], a[order], n[order]
    kept = (n > 0) & np.concatenate(([True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])))
    return b[kept], a[kept], n[kept]


def _equal(one: np.ndarray, other: np.ndarray) -> int:
    """Length of the common start."""
    at, step, n = 0, 32, min(len(one), len(other))
    while at < n:
        end = min(n, at + step)
        off = (one[at:end] != other[at:end]).argmax()
        if one[at + off] != other[at + off]:
            return at + int(off)
        at, step = end, 4 * step
    return n


class _Chains:
    """Runs in order: after a run comes always the one with fewest shingles between; the end is where all matches couldn't pay."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> None:
        """Runs in the order of b. Where the neighbour follows with less between than any further one can have, it is the next one."""
        a_end, b_end = a + n, b + n
        ends = max(a_end.max(), b_end.max())
        self.n, self.most = n, (1 - similarity) / similarity * n.sum()
        self.sides = ((a, b), (ends - a_end, ends - b_end))
        self.known: tuple[dict[int, tuple[int, int]], ...] = ({}, {})
        between = a[1:] - a_end[:-1], b[1:] - b_end[:-1]
        cost = between[0] + between[1]
        plain = (between[0] >= 0) & (between[1] >= 0) & (cost <= self.most)
        further = np.append(b[2:] - b_end[:-2], 1 << 60)[: len(cost)]
        self.known[0].update((k, (k + 1, 0)) for k in np.flatnonzero(plain & (cost <= further)).tolist())
        further = np.concatenate(([1 << 60], b[2:] - np.maximum.accumulate(b_end)[:-2]))[: len(cost)]
        self.known[1].update((k + 1, (k, 0)) for k in np.flatnonzero(plain & (cost <= further)).tolist())

    def _next(self, side: int, k: int) -> tuple[int, int]:
        """The run after k, or -1, and how much of its start k has already."""
        if k not in self.known[side]:
            a, b = self.sides[side]
            x, y = a[k] + self.n[k], b[k] + self.n[k]
            skip = np.maximum(0, np.maximum(x - a, y - b))
            cost = np.where(skip < self.n, a + b + 2 * skip - x - y, 1 << 60)
            j = int(cost.argmin())
            self.known[side][k] = (j, int(skip[j])) if cost[j] <= self.most else (-1, 0)
        return self.known[side][k]

    def _onward(self, side: int, k: int) -> tuple[list[int], list[int]]:
        """The runs after k, and how much of its start each has lost."""
        out, skips = [], []
        while (step := self._next(side, k))[0] >= 0:
            k = step[0]
            out.append(k)
            skips.append(step[1])
        return out, skips

    def through(self, k: int) -> tuple[np.ndarray, int, list[int]]:
        """Rows (in a, in b, length) of the chain that holds run k, k's place in it, and the numbers of its runs."""
        (after, lost), (before, cut) = self._onward(0, k), self._onward(1, k)
        before.reverse()
        own = [*before, k, *after]
        a, b = self.sides[0]
        runs = np.stack((a[own], b[own], self.n[own]), axis=1)
        runs[: len(before), 2] -= np.array(cut[::-1], np.int64)  # on this side a run's end is what it loses
        runs[len(before) + 1 :] += np.array(lost, np.int64)[:, None] * (1, 1, -1)
        return runs, len(before), own


def _best(a: Text, b: Text, chain: tuple[np.ndarray, int], width: int, similarity: float) -> tuple[int, int, int] | None:
    """Of the stretches of a chain that hold its longest run, the similar one with most matches less others.

    So a run beyond an edit is taken if it is longer than the edit, and a shorter one where the stretch is too short or not
    similar without it. Very many candidates are taken in blocks.
    """
    runs, mid = chain
    matches = np.concatenate(([0], np.cumsum(runs[:, 2])))
    starts, ends = runs[: mid + 1], runs[mid:]
    a_end, b_end = (ends[:, i] + ends[:, 2] for i in range(2))
    block = max(1, 1_000_000 // len(ends))
    for k in range(max(0, mid + 1 - block), -1, -block) if block <= mid else (0,):
        own = starts[k : k + block]
        both = matches[mid + 1 :][None, :] - matches[k : k + len(own)][:, None]
        a_size, b_size = a_end[None, :] - own[:, 0][:, None], b_end[None, :] - own[:, 1][:, None]
        a_twice = a.again[a_end][None, :] - a.again[own[:, 0]][:, None]
        b_twice = b.again[b_end][None, :] - b.again[own[:, 1]][:, None]
        most = np.maximum(a_size, width) - a_twice + np.maximum(b_size, width) - b_twice  # different shingles, at least
        i, j = np.nonzero((b_size >= similarity * width) & ((1 + similarity) * both >= similarity * most - 1e-6))
        for x in np.lexsort((-b_size[i, j], b_size[i, j] - 2 * both[i, j])).tolist():
            start, end = _widened(int(own[i[x], 1]), int(b_end[j[x]]) - 1, len(b.shingles), width)
            source, last = _widened(int(own[i[x], 0]), int(a_end[j[x]]) - 1, len(a.shingles), width)
            if _alike(a.shingles[source : last + 1], b.shingles[start : end + 1], similarity):
                return start, end, source
    return None


def _widened(start: int, end: int, n: int, width: int) -> tuple[int, int]:
    """start and end, moved apart to `width` shingles inside 0..n-1 where they are nearer: an edit beside an end leaves fewer matches."""
    start = max(0, min(start, end - width + 1))
    return start, min(n - 1, max(end, start + width - 1))


def _alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    if len(one) == len(other) and (one == other).all():
        return True
    one, other = np.unique(one), np.unique(other)
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= similarity * (len(one) + len(other) - both)


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Rows of verified passages: doc_id, source_id, start, stop, source_start in words."""
    names = ["doc_id", "source_id", "start", "stop", "source_start"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in stream:
            found: list[tuple] = []
            texts_a = batch.column(2)
            for n, (a, b, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), Text.each(batch.column(3)), strict=True)):
                if a != last:
                    last, one = a, next(Text.each(texts_a.slice(n, 1)))
                found += [(b, a, start, end + SIZE, base) for start, end, base in shared_passages(one, other, width)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(5)], names)

    one = few(pairs, "b").hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    wanted = few(stored(pairs.select("a").distinct()), "a").hint("merge").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.hint("merge").join(wanted, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, source_id, start, stop, source_start, in words, of every passage that an earlier text has too.

    stop is exclusive. A passage is listed with the first text that it was verified against.
    """
    tune(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    texts, keys, marks = _texts(docs, doc_id, text, folder)
    found = _find(texts, marks, least, folder)
    if keys is None:
        return found
    names = keys.select("key", "id")
    found = found.join(names.toDF("doc_id", "__b"), "doc_id").join(names.toDF("source_id", "__a"), "source_id")
    return found.select(F.col("__b").alias("doc_id"), F.col("__a").alias("source_id"), "start", "stop", "source_start")


def _texts(docs: DataFrame, doc_id: str, text: str, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(doc_id, text) of the different texts, each with an id of its own, the keys that stand for ids, or None, and (doc_id, mark)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    marks = stored(texts.select("doc_id", _mark("text").alias("mark")), folder)
    several = stored(marks.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("mark").alias("x"), F.max("mark").alias("y")).where("n > 1"), folder)
    if several.isEmpty():
        return texts, None, marks
    if several.where("x < y").isEmpty():
        return stored(texts.dropDuplicates(["doc_id"]), folder), None, marks.distinct()
    keys = _keys(texts, folder)
    own = _keyed(texts, keys, "doc_id", "text").select(F.col("key").alias("doc_id"), "text")
    return stored(own.dropDuplicates(["doc_id"]), folder), keys, keys.select(F.col("key").alias("doc_id"), "mark")


def _mark(text: str) -> Column:
    return F.xxhash64(F.col(text), F.octet_length(text))


def _keys(texts: DataFrame, folder: str) -> DataFrame:
    """(key, id, mark) of the different texts of all ids, numbered in the order of id and mark."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in stream:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows))], ["part", "id", "mark", "n"])
            n += batch.num_rows

    pairs = texts.select(F.col("doc_id").alias("id"), _mark("text").alias("mark")).distinct()
    dealt = pairs.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select(F.spark_partition_id().alias("part"), "id", "mark")
    ranked = stored(dealt.mapInArrow(run, "part int, id long, mark long, n long"), folder)
    sizes = sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    starts = texts.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before[:-1], strict=True)], "part int, before long")
    return stored(ranked.join(F.broadcast(starts), "part").select((F.col("before") + F.col("n")).alias("key"), "id", "mark"), folder)


def _keyed(rows: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rows with the key of each one's text; null where the id is null."""
    return rows.join(keys, (F.col(doc_id).cast("long") == F.col("id")) & (_mark(text) == F.col("mark")), "left").drop("id", "mark")


def _copies(marks: DataFrame, folder: str) -> DataFrame:
    """(doc_id, source_id) of texts that are equal to an earlier one."""
    several = marks.groupBy("mark").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("n")).where("n > 1").select("mark", "source_id")
    return stored(marks.join(few(stored(several, folder), "source_id").hint("merge"), "mark").where("doc_id <> source_id").select("doc_id", "source_id"), folder)


def _find(texts: DataFrame, marks: DataFrame, least: int, folder: str) -> DataFrame:
    """find() of texts (doc_id, text), whose ids differ, with their marks (doc_id, mark). Copies of whole texts are settled first and take no part in the rest."""
    spark = texts.sparkSession
    copies = _copies(marks, folder)
    if copies.limit(FEW + 1).count() <= FEW:
        single = texts.join(F.broadcast(copies.select("doc_id")), "doc_id", "left_anti")
    else:
        single = stored(texts.join(copies.select("doc_id").hint("merge"), "doc_id", "left_anti"), folder)
    hot = frequent(counted(single, kinds=1)[0])
    width = least - SIZE + 1
    held = stored(min_hashes(single, hot, least), folder)
    whole = copies.join(held.where(F.col("n_words") >= least).select(F.col("doc_id").alias("source_id"), F.col("n_words").cast("long").alias("stop")), "source_id")
    whole = stored(whole.select("doc_id", "source_id", F.lit(0).cast("long").alias("start"), "stop", F.lit(0).cast("long").alias("source_start")), folder)
    rows = held.select("doc_id", F.explode(F.arrays_zip("hs", "cs")).alias("w")).select("doc_id", F.col("w.hs").alias("h"), F.col("w.cs").alias("at"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("c"), F.min_by("at", "doc_id").alias("c_at"), F.max("doc_id").alias("z"), F.count("*").alias("holders"))
    first = first.where("c < z").select("h", "c", "c_at", "holders")
    first = stored(first, folder)  # as a plain table, so that the rows of a frequent min-hash are split where they meet it
    shared = stored(rows.join(few(first, "c").hint("merge"), "h").where("c <> doc_id").select("h", "c", "c_at", "doc_id", "holders", "at"), folder)
    forget(spark, held)
    pairs = shared.groupBy(F.col("c").alias("a"), F.col("doc_id").alias("b")).agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("a", "b")
    tried = stored(pairs, folder)
    found = stored(_verify(tried, texts, width), folder)
    rest = stored(_open(shared, tried, found), folder)
    forget(spark, shared)
    around = _contexts(rest, texts, width, folder)
    rest, left = rest.where("open = 1").select("h", "doc_id", "at"), None
    for most in ROUNDS:
        near = stored(_near(around, left, most, width), folder)
        pairs = stored(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), folder)
        again = stored(_verify(pairs, texts, width), folder)
        found, tried = found.unionByName(again), tried.unionByName(pairs)
        if most is None:
            break
        left = near.groupBy("h", "x", F.col("b").alias("doc_id")).agg(F.max("a").alias("after"), F.count("*").alias("n")).where(F.col("n") >= most).drop("n")
        left = stored(left.join(_unsettled(rest, again).select("h", "doc_id").distinct(), ["h", "doc_id"], "left_semi"), folder)
        forget(spark, near)
        if left.isEmpty():
            break
    return found.unionByName(whole)


def _unsettled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, at, ...) without those whose centre is in a found passage."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    inside = F.exists("__spans", lambda x: (x["start"] <= F.col("at")) & (F.col("at") + SIZE <= x["stop"]))
    return rows.join(spans, "doc_id", "left").where(F.col("__spans").isNull() | ~inside).drop("__spans")


def _open(shared: DataFrame, tried: DataFrame, found: DataFrame) -> DataFrame:
    """(h, doc_id, at, open): min-hashes of texts that no passage explains yet, and with open = 0 all texts that can be their sources.

    Settled texts and first holders stay as sources. A text with fewer than two min-hashes that earlier ones have isn't open. Of a
    min-hash with two holders, the pair may have been tried; else the pair has just this one, or it has others, which are open,
    or settled by a third text.
    """
    many = shared.groupBy("doc_id").agg(F.min("h").alias("__x"), F.max("h").alias("__y")).where("__x < __y").select("doc_id")
    left = _unsettled(shared, found).join(many, "doc_id", "left_semi")
    settled = found.select("doc_id").distinct()
    two = left.where("holders = 2").join(settled, "doc_id", "left_semi").join(tried.select(F.col("a").alias("c"), F.col("b").alias("doc_id")), ["c", "doc_id"], "left_anti")
    left = left.where("holders > 2").unionByName(two.select(*left.columns))
    left = stored(left.select("h", "c", "c_at", "doc_id", "at"))
    firsts = stored(left.select("h", F.col("c").alias("doc_id"), F.col("c_at").alias("at"), F.lit(0).alias("open")).distinct())
    source = shared.select("h", "doc_id", "at").join(few(firsts.select("h", F.col("doc_id").alias("c")), "c").hint("merge"), "h").select("h", "doc_id", "at")
    source = source.join(left.select("h", "doc_id").hint("merge"), ["h", "doc_id"], "left_anti").withColumn("open", F.lit(0))
    return source.unionByName(firsts).unionByName(left.select("h", "doc_id", "at", F.lit(1).alias("open")))


def _contexts(rows: DataFrame, texts: DataFrame, width: int, folder: str) -> DataFrame:
    """rows (h, doc_id, at, open) with around: of the shingles within `width` of the centre, those of even hash, half of them.
    Those with fewer than SHARED are left out."""
    wanted = rows.groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.collect_list("at").alias("ats"), F.collect_list("open").alias("opens"))
    joined = few(stored(wanted, folder), "doc_id").hint("merge").join(texts, "doc_id").select("doc_id", "hs", "ats", "opens", "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists, around = [batch.column(i) for i in (1, 2, 3)], []
            kept = np.zeros(len(lists[0].flatten()), bool)
            places, at = lists[1].flatten().to_numpy().tolist(), 0
            for n, own in zip(lists[0].value_lengths().to_pylist(), Text.each(batch.column(4)), strict=True):
                short = (own.shingles >> np.uint64(32)).astype(np.uint32).view(np.int32)
                before = np.full(len(short), -1)  # where each shingle stands before
                before[own.order[1:]] = np.where(own.sorted[1:] == own.sorted[:-1], own.order[:-1], -1)
                even = np.flatnonzero(short & 1 == 0)
                short, before = short[even], before[even]
                low = np.maximum(0, np.array(places[at : at + n]) - width)
                first, last = np.searchsorted(even, low), np.searchsorted(even, low + 2 * width, "right")
                for k, (c, x, y) in enumerate(zip(low.tolist(), first.tolist(), last.tolist(), strict=True)):
                    if y - x >= SHARED:
                        near = short[x:y][before[x:y] < c]
                        if len(near) >= SHARED:
                            kept[at + k] = True
                            around.append(near)
                at += n
            ids = np.repeat(batch.column(0).to_numpy(), lists[0].value_lengths().to_numpy())[kept]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in around]))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(around) if around else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists[0].flatten().to_numpy()[kept]), pa.array(lists[2].flatten().to_numpy()[kept]), sets], ["doc_id", "h", "open", "around"])

    return stored(joined.mapInArrow(run, "doc_id long, h long, open int, around array<int>"), folder)


def _near(rows: DataFrame, left: DataFrame | None, most: int | None, width: int) -> DataFrame:
    """(h, x, a, b): for each open text and min-hash the first `most` texts before it in each part x of the holders, or all,
    whose surroundings share SHARED. left (h, x, doc_id, after): only these, and texts after `after`.

    Open rows and all rows of a min-hash are multiplied out, in tiles of bounded sides.
    """
    least = SHARED
    sizes = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum("open").alias("u")).where("n > 1 AND u > 0")
    dealt = rows.join(sizes.select("h", *[F.ceil(F.col(c) / SIDE).cast("int").alias(f"{c}_sides") for c in "nu"]), "h")
    part = F.xxhash64("doc_id")
    sides = [F.pmod(part, F.col(f"{c}_sides")).cast("int") for c in "nu"]
    single = F.col("n_sides") == 1  # then a row is source and, if open, target; otherwise an open row is dealt twice
    source = dealt.where(~(single & (F.col("open") == 1))).select("h", sides[0].alias("x"), F.explode(F.sequence(F.lit(0), F.col("u_sides") - 1)).alias("y"), "doc_id", F.lit(0).alias("role"), "around")
    target = dealt.where("open = 1").select("h", F.explode(F.sequence(F.lit(0), F.col("n_sides") - 1)).alias("x"), sides[1].alias("y"), "doc_id", F.when(single, 2).otherwise(1).alias("role"), "around")
    placed = source.unionByName(target)
    if left is None:
        placed = placed.withColumn("after", F.lit(-(2**63)).cast("long"))
    else:
        placed = placed.join(left.select("h", "x").distinct(), ["h", "x"], "left_semi").join(left, ["h", "x", "doc_id"], "left")
        placed = placed.where("role <> 1 OR after IS NOT NULL").withColumn("role", F.when(F.col("after").isNull(), 0).otherwise(F.col("role")))
        placed = placed.withColumn("after", F.coalesce("after", F.lit(-(2**63)).cast("long")))

    def candidates(ids: np.ndarray, role: np.ndarray, after: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        target, source = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        if not len(target) or not len(source):
            return []
        if len(ids) <= 12:
            held = [set(x.tolist()) for x in sets]
            both = np.array([[len(held[i] & held[j]) for j in source] for i in target])
        else:
            both = product([sets[i] for i in target], [sets[j] for j in source])
        mine, theirs = ids[target], ids[source]
        enough = (both >= least) & (mine[:, None] > theirs[None, :]) & (theirs[None, :] > after[target][:, None])
        out = []
        for b in np.unique(mine[enough.any(axis=1)]).tolist():
            out += [(a, b) for a in np.unique(theirs[enough[mine == b].any(axis=0)])[:most].tolist()]
        return out

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, 3):
            keys = [table.column(i).to_numpy() for i in range(3)]
            ids, role, after = (table.column(i).to_numpy() for i in (3, 4, 5))
            lists = table.column(6).combine_chunks()
            values, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            change = np.zeros(max(0, len(ids) - 1), bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            found: list[tuple[int, int, int, int]] = []
            for own in np.split(np.arange(len(ids)), np.flatnonzero(change) + 1):
                h, x = int(keys[0][own[0]]), int(keys[1][own[0]])
                found += [(h, x, a, b) for a, b in candidates(ids[own], role[own], after[own], [values[offsets[r] : offsets[r + 1]] for r in own])]
            columns = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, i].astype(np.int32) if i == 1 else columns[:, i]) for i in range(4)], ["h", "x", "a", "b"])

    placed = placed.select("h", "x", "y", "doc_id", "role", "after", "around").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    return placed.mapInArrow(run, "h long, x int, a long, b long")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with every found passage cut out of its text, from its first word's start to its last word's end."""
    tune(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    texts, keys, marks = _texts(docs, doc_id, text, folder)
    spans = _find(texts, marks, least, folder).select("doc_id", "start", "stop").distinct()
    spans = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("start").alias("__from"), F.collect_list("stop").alias("__to"))
    bare = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)])  # so that no name clashes
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    if keys is None:
        placed = bare.withColumn("__key", F.col(names[doc_id]).cast("long"))
    else:
        placed = _keyed(bare, keys, names[doc_id], names[text]).withColumnRenamed("key", "__key")
    joined = placed.join(spans, F.col("__key") == F.col("__id"), "left").select(*names.values(), "__from", "__to")
    schema = T.StructType([T.StructField(names[f.name], f.dataType) for f in docs.schema])
    at = docs.columns.index(text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = batch.columns
            starts, stops = columns.pop(-2), columns.pop(-1)
            has = starts.is_valid()
            rows = pa.array(np.flatnonzero(has.to_numpy(zero_copy_only=False)))
            if len(rows):
                cut = _cut(columns[at].take(rows), starts.take(rows), stops.take(rows)).cast(columns[at].type)
                columns[at] = pc.replace_with_mask(columns[at], has, cut)
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        release()

    return joined.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in names.items()])


def _cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    """texts without the words from each start to each stop. Raises if a passage isn't inside its text."""
    out = []
    for row, raw, bounds in text_chunks(texts):
        n = len(bounds) - 1
        _, begins, ends, first = words(raw, bounds, True)
        low, high = starts.slice(row, n), stops.slice(row, n)
        owner = np.repeat(np.arange(n), np.nan_to_num(low.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
        low, high = (first[owner] + x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (low, high))
        if (low < first[owner]).any() or (high > first[owner + 1]).any() or (high <= low).any():
            raise ValueError("a passage is not inside its text")
        change = np.zeros(len(raw) + 1, np.int64)
        np.add.at(change, begins[low], 1)
        np.add.at(change, ends[high - 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        offsets = np.concatenate(([0], np.cumsum(kept)))[bounds]
        data = raw[kept]
        out.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())
