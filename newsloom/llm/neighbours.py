"""Embedding near-dedup by a forest of random-projection trees.

A node of a tree takes many random directions (differences of two vectors of the sample), projects what it holds on them, from its
centre, and sends each vector to the one with the largest projection. Wide nodes part fewer near pairs than the levels of
two-way splits that make as many leaves, and a vector is in one leaf of each tree. Vectors that share a leaf in any tree are compared: in
single precision, and in double precision where that doesn't settle it. A pair counts in the first tree that puts its
vectors in one leaf, so that pairs needn't be gathered to be counted once. Links are joined to components.

The trees are fitted on a bounded sample (SAMPLE vectors, of those of least id hash); every vector is sent down every tree. There are as many
leaves as make one hold LEAF vectors, or more where the sample is uneven. A leaf of more than TILE vectors is compared in
square tiles of at most TILE a side, so no task grows with a leaf.

The number of trees grows with the leaves, as a pair at the threshold is kept by fewer of them: as many as leave less than
MISSED of such pairs apart in all, by the formula for vectors without structure (`kept`) and by pairs made of the sample. A few
trees are answered at a time, so that what is shuffled at once stays near the input's size.

Copies and dense clusters: equal vectors are one vertex with a weight. Where the sample shows a dense cluster, a ball is laid
around one of its vectors, of half the angle that links: all within are linked, so their links are counted, not compared.
Only vectors outside a ball that are near enough to link with one inside are compared with it, in blocks.

Defined results: a vector that is null, zero, or holds nulls or non-finite numbers links with nothing. Vectors of different
sizes don't link. Repeated ids: each row is returned; equal ids are one vertex, links count rows. A null id is returned with
no links and a null component. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import components, forget, least_labels, shared_dir, stored, tune

COSINE, LEAF, TILE, SAMPLE = 0.9, 1000, 4000, 20_000
#: Most children of a node, share of pairs at the threshold that may be apart in all trees, most trees.
FAN, MISSED, MOST = 512, 0.005, 96
#: Sample vectors by which the keeping of pairs is measured, rows that a task sends on at once, leaves whose sizes are broadcast.
SPLIT, TASK, FEW = 2_000, 100_000, 100_000
#: Bytes shuffled at once: so many, and so many of each vector's own.
AT_ONCE, OF_INPUT = 300e6, 1.1
#: Dense clusters: sample vectors looked at, share of them that makes a cluster, most balls.
LOOKED, DENSE, BALLS = 6_000, 0.004, 64


def usable(vector) -> object:
    """Whether a vector has a direction."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def kept(leaves: float) -> float:
    """Share of pairs at cosine 0.9 that a tree of so many leaves keeps: a fit to measurements on 64 components, 2 to 4,096 leaves of one node."""
    levels = 1 if leaves <= FAN else 2
    return math.exp(-0.232 * levels * math.log(max(2.0, leaves) ** (1 / levels)) ** 0.77)


def trees_for(total: int, leaf: int = LEAF, share: float = 1.0) -> int:
    """Trees for a table of `total` vectors, where a tree keeps at most `share` of the pairs at the threshold."""
    return min(MOST, max(1, math.ceil(math.log(MISSED) / math.log(1 - min(share, kept(total / leaf), 0.99)))))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Forest:
    """Random-projection trees of one or two levels of wide nodes; leaves are numbered across trees."""

    def __init__(self, sample: np.ndarray, total: int, trees: int | None, leaf: int = LEAF, cosine: float = COSINE, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        wanted = max(1, math.ceil(total / leaf)) if len(sample) > 1 and np.ptp(sample, axis=0).max() > 1e-6 else 1
        self.middle = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        self.trees = self._grow(sample, wanted, 2, rng)
        for _ in range(3 if wanted > 1 else 0):  # an uneven table gets more leaves, if they help
            more = self._grow(sample, 2 * wanted, 2, rng)
            if self._met(sample) * total < 2 * leaf or self._met(sample, more) > 0.75 * self._met(sample):
                break
            wanted, self.trees = 2 * wanted, more
        if trees is None:
            share = self._kept(sample, cosine, rng) if wanted > 1 else 1.0
            trees = trees_for(wanted * leaf, leaf, share) if wanted > 1 else 1
        self.trees = (self.trees + self._grow(sample, wanted, max(0, trees - 2), rng))[:trees]
        self.bases = np.cumsum([0] + [len(t[0]) * (len(t[1]) if len(t) > 1 else 1) for t in self.trees])[:-1]  # first leaf of each

    def _grow(self, rows: np.ndarray, wanted: int, trees: int, rng) -> list[list[np.ndarray]]:
        """Of each tree: directions of the first level, and, if there are two, of the second with their projections of each child's centre."""
        out = []
        for _ in range(trees):
            fan = wanted if wanted <= FAN else math.ceil(math.sqrt(wanted))
            first = self._directions(rows, fan, rng)
            if wanted <= FAN:
                out.append([first])
                continue
            second = self._directions(rows, fan, rng)
            own, at = rows - self.middle, ((rows - self.middle) @ first.T).argmax(axis=1)
            centres = np.zeros((fan, rows.shape[1]))
            np.add.at(centres, at, own)
            length = float(np.mean(np.einsum("ij,ij->i", own, first[at])))
            centres = (centres + length * first) / (np.bincount(at, minlength=fan) + 1)[:, None]  # few of the sample: where they would be
            out.append([first.astype(np.float32), second.astype(np.float32), (centres @ second.T).astype(np.float32)])
        return out

    @staticmethod
    def _directions(rows: np.ndarray, n: int, rng) -> np.ndarray:
        out = np.zeros((0, rows.shape[1]))
        if n > 1:
            for _ in range(20):
                apart = rows[rng.integers(len(rows), size=2 * n)] - rows[rng.integers(len(rows), size=2 * n)]
                sizes = np.linalg.norm(apart, axis=1)
                out = np.concatenate((out, apart[sizes > 1e-6] / sizes[sizes > 1e-6, None]))[:n]
                if len(out) == n:
                    break
        missing = n - len(out)
        return np.concatenate((out, rng.normal(size=(missing, rows.shape[1])) / math.sqrt(rows.shape[1]))).astype(np.float32)

    def codes(self, rows: np.ndarray, trees: list | None = None) -> np.ndarray:
        """The leaf of each row in each tree."""
        own = (rows - self.middle).astype(np.float32)
        trees, base = self.trees if trees is None else trees, 0
        out = np.empty((len(own), len(trees)), np.int32)
        for begin in range(0, len(own), 2048):
            part, base = own[begin : begin + 2048], 0
            for t, (first, *more) in enumerate(trees):
                at, size = (part @ first.T).argmax(axis=1), len(first)
                if more:
                    scores = part @ more[0].T
                    scores -= more[1][at]
                    at, size = at * len(more[0]) + scores.argmax(axis=1), size * len(more[0])
                out[begin : begin + 2048, t] = at + base
                base += size
        return out

    def _met(self, rows: np.ndarray, trees: list | None = None) -> float:
        """Share of the other vectors that one shares a leaf with in a tree."""
        codes = self.codes(rows, trees)
        sizes = [np.unique(codes[:, t], return_counts=True)[1].astype(float) for t in range(codes.shape[1])]
        return float(np.mean([(n * (n - 1)).sum() for n in sizes])) / (len(rows) * (len(rows) - 1))

    def _kept(self, rows: np.ndarray, cosine: float, rng) -> float:
        """Share of pairs at the threshold that a tree keeps: sample vectors turned towards differences of others."""
        a = rows[rng.integers(len(rows), size=SPLIT)]
        away = rows[rng.integers(len(rows), size=SPLIT)] - rows[rng.integers(len(rows), size=SPLIT)]
        away -= np.einsum("ij,ij->i", away, a)[:, None] * a
        sizes = np.linalg.norm(away, axis=1)
        a, away = a[sizes > 1e-6], away[sizes > 1e-6] / sizes[sizes > 1e-6, None]
        if not len(a):
            return 1.0
        return float(max(0.01, (self.codes(a) == self.codes(cosine * a + math.sqrt(1 - cosine * cosine) * away)).mean()))


def balls(sample: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Centres of dense clusters of the sample, the fullest first."""
    rows, radius = sample[:LOOKED], np.sqrt((1 + cosine) / 2)
    near = np.concatenate([rows[i : i + 500] @ rows.T >= radius for i in range(0, len(rows), 500)]) if len(rows) else np.zeros((0, 0), bool)
    free, centres = np.ones(len(rows), bool), []
    while len(centres) < BALLS and len(rows):
        sizes = (near & free).sum(axis=1) * free
        if sizes.max() < max(20, DENSE * len(rows)):
            break
        centres.append(int(sizes.argmax()))
        free &= ~near[centres[-1]]
    return rows[centres]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of _packed."""
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].copy().view(kind).reshape(len(column), -1)


def _compare(left: tuple, right: tuple | None, cosine: float, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between left and right (vectors, weights, leaves), or within left: (weight of each left row's links, of each right row's, labels).

    Pairs that share a leaf of a tree before `tree` count there, not here. Pairs are gathered a block at a time only; a row's
    label is the first row of its component, left rows before right ones.
    """
    a, wa, ca = unit(left[0].astype(np.float64)), left[1], left[2]
    b, wb, cb = (a, wa, ca) if right is None else (unit(right[0].astype(np.float64)), right[1], right[2])
    fa, margin = a.astype(np.float32), 1e-6 * (a.shape[1] + 16)
    fb = fa if right is None else b.astype(np.float32)
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    labels = np.arange(len(a) + (0 if right is None else len(b)))
    for x in range(0, len(a), 512):
        for y in range(x if right is None else 0, len(b), 1024):
            near = fa[x : x + 512] @ fb[y : y + 1024].T
            at = np.flatnonzero(near >= cosine - margin)
            i, j = np.divmod(at, near.shape[1])
            sure = near.ravel()[at] >= cosine + margin
            i, j = i + x, j + y
            if right is None:
                i, j, sure = i[i < j], j[i < j], sure[i < j]
            if not len(i):
                continue
            open_ = np.flatnonzero(~sure)
            sure[open_] = np.concatenate([np.einsum("ij,ij->i", a[i[o]], b[j[o]]) >= cosine for o in np.array_split(open_, len(open_) // 10_000 + 1)])
            for t in range(tree):
                sure &= ca[i, t] != cb[j, t]
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            na += np.bincount(i, wb[j], len(a)).astype(np.int64)
            if right is None:
                na += np.bincount(j, wa[i], len(a)).astype(np.int64)
            else:
                nb += np.bincount(j, wa[i], len(b)).astype(np.int64)
            labels = least_labels(i, j if right is None else j + len(a), labels)
    return na, nb, labels


def _found(ids: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    has = counts > 0
    return ids[has], counts[has], ids[labels[has]]


def dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. trees: by default as many as the table asks for."""
    spark = vectors.sparkSession
    tune(spark)
    folder = shared_dir(spark)
    plain = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(plain).alias("v"))  # floats are shuffled as such
    good = usable(F.col("v")) & F.col("id").isNotNull()
    classes = stored(rows.where(good).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")).withColumn("dims", F.size("v")), folder)
    out_rows = stored(rows.join(classes.select("v", F.col("id").alias("rep"), "w"), "v", "left").select("id", F.when(good, F.col("rep")).alias("rep"), F.when(good, F.col("w")).alias("w")), folder)
    found = []
    for row in classes.groupBy("dims").agg(F.count("*").alias("n")).collect():  # sizes of vectors: one, as a rule
        own = classes.where(F.col("dims") == row["dims"])
        found += _links(own, row["n"], folder, cosine, trees, leaf, tile, sample)
    copies = rows.where(good & F.lit(False)).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    for f in found:
        copies = copies.unionByName(f)
    forget(spark, classes)
    links = stored(copies, folder)
    known = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(out_rows.where("rep IS NOT NULL").select(F.col("id").alias("a"), F.col("rep").alias("b"))), folder)
    counted = links.groupBy("id").agg(F.sum("n").alias("n"))
    joined = out_rows.join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(vec_id), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _links(classes: DataFrame, total: int, folder: str, cosine: float, trees: int | None, leaf: int, tile: int, sample: int) -> list[DataFrame]:
    """(id, n, root): weights of links and a linked id, from balls, the rims of balls, and leaves."""
    spark = classes.sparkSession
    few = classes if total <= 4 * sample else classes.where(F.xxhash64("id") < F.lit(int(2 * sample / total * 2**64) - 2**63))
    taken = few.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    fitted = unit(np.stack(taken).astype(np.float64))
    centres = balls(fitted, cosine)
    inner, outer = float(np.sqrt((1 + cosine) / 2)) + 1e-12, float(np.cos(np.arccos(cosine) * 1.5)) - 1e-9
    free = (fitted @ centres.T < inner).all(axis=1)
    forest = Forest(fitted[free] if free.any() else fitted, math.ceil(total * max(0.01, free.mean())), trees, leaf, cosine)
    model = spark.sparkContext.broadcast((forest, centres))  # bounded by the sample's size
    kind = "f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "f8"

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's bytes with its ball (or -1), the balls whose rim it is on, and its leaf in each tree (none inside a ball)."""
        own_forest, own_centres = model.value
        for batch in stream:
            if not batch.num_rows:
                continue
            given = _matrix(batch.column(1))
            unit_rows = unit(given.astype(np.float64))
            near = unit_rows @ own_centres.T if len(own_centres) else np.zeros((len(unit_rows), 0))
            inside = near >= inner
            ball = np.where(inside.any(axis=1), inside.argmax(axis=1) if near.shape[1] else 0, -1)
            rim = [np.flatnonzero((r >= outer) & (np.arange(len(r)) != b)).tolist() for r, b in zip(near, ball, strict=True)] if near.shape[1] else [[]] * len(ball)
            codes = own_forest.codes(unit_rows)
            bounds = np.concatenate(([0], np.cumsum(np.where(ball < 0, codes.shape[1], 0)))).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes[ball < 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(given), batch.column(2), pa.array(ball, pa.int32()), pa.array(rim, pa.list_(pa.int32())), leaves], ["id", "v", "w", "ball", "rim", "leaves"])

    sent = stored(classes.select("id", "v", "w").mapInArrow(send, "id long, v binary, w long, ball int, rim array<int>, leaves array<int>"), folder)
    out = []
    schema = "id long, n long, root long"

    if len(centres):
        in_ball = sent.where("ball >= 0").groupBy("ball").agg(F.sum("w").alias("total"), F.min("id").alias("root"))
        out.append(stored(sent.where("ball >= 0").join(in_ball, "ball").select("id", (F.col("total") - F.col("w")).alias("n"), "root"), folder))
        # rims: each is split in parts, each part meets every part of the ball's vectors; of two balls the lower one is the ball
        rim = sent.select("id", "v", "w", "ball", F.explode("rim").alias("of")).where("ball < 0 OR ball > of")
        sizes = {r["of"]: r["n"] for r in rim.groupBy("of").agg(F.count("*").alias("n")).collect()}  # at most BALLS rows
        inside = {r["ball"]: r["n"] for r in sent.where("ball >= 0").groupBy("ball").agg(F.count("*").alias("n")).collect()}
        parts = [(b, -(-inside.get(b, 0) // tile), -(-n // tile)) for b, n in sizes.items()]
        if parts:
            spread = spark.createDataFrame(parts, "of int, balls int, rims int")
            one = sent.where("ball >= 0").select("id", "v", "w", F.col("ball").alias("of")).join(spread, "of")
            one = one.select("*", F.pmod(F.xxhash64("id"), F.col("balls")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("rims") - 1)).alias("y"))
            two = rim.join(spread, "of").where("balls > 0")
            two = two.select("*", F.pmod(F.xxhash64("id"), F.col("rims")).alias("y"), F.explode(F.sequence(F.lit(0), F.col("balls") - 1)).alias("x"))
            keep = ["id", "v", "w", "of", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")]

            other = two.select(*keep).toDF(*(f"{c}2" for c in ("id", "v", "w", "of", "x", "y")))

            def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                if not len(left) or not len(right):
                    return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
                right = right.set_axis(left.columns, axis=1)
                na, nb, labels = _compare(*((_unpacked(pa.array(x["v"], pa.binary()), kind), x["w"].to_numpy(np.int64), None) for x in (left, right)), cosine, 0)
                ids = np.concatenate((left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)))
                return pd.DataFrame(dict(zip(("id", "n", "root"), _found(ids, np.concatenate((na, nb)), labels), strict=True)))

            out.append(stored(one.select(*keep).groupBy("of", "x", "y").cogroup(other.groupBy("of2", "x2", "y2")).applyInPandas(meet, schema), folder))

    bases = forest.bases

    def within(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of each tile; a tile's vectors stand together."""
        key, held, done, waiting = None, [], [], 0

        def answer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, v, w, leaves, part = (np.concatenate(x) for x in zip(*held, strict=True))
            tree, (_, x, y) = int(np.searchsorted(bases, key[0], "right")) - 1, key
            if x == y:
                counts, _, labels = _compare((v, w, leaves), None, cosine, tree)
                return _found(ids, counts, labels)
            n = int((part == x).sum())  # in order of parts
            na, nb, labels = _compare((v[:n], w[:n], leaves[:n]), (v[n:], w[n:], leaves[n:]), cosine, tree)
            return _found(ids, np.concatenate((na, nb)), labels)

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["id", "n", "root"])

        for batch in stream:
            if not batch.num_rows:
                continue
            ids, w, place, x, y, part = (batch.column(i).to_numpy() for i in (0, 2, 4, 5, 6, 7))
            v, leaves = _unpacked(batch.column(1), kind), _matrix(batch.column(3))
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = (int(place[a]), int(x[a]), int(y[a]))
                if now != key and held:
                    done.append(answer())
                    held, waiting = [], waiting + len(done[-1][0])
                    if waiting > TASK:
                        yield batch_of(done)
                        done, waiting = [], 0
                key = now
                held.append((ids[a:b], v[a:b], w[a:b], leaves[a:b], part[a:b]))
        if held:
            done.append(answer())
        if done:
            yield batch_of(done)

    own = fitted.shape[1] * int(kind[1])
    count = len(forest.trees)
    at_once = max(1, int((AT_ONCE + OF_INPUT * (own + 24) * total) / ((own + 4 * count + 60) * total)))
    for first in range(0, count, at_once):
        placed, _ = _split(sent.where("ball < 0").withColumn("leaf", F.explode(F.slice("leaves", first + 1, min(at_once, count - first)))), folder, tile)
        dealt = placed.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y", "part")
        out.append(stored(dealt.mapInArrow(within, schema), folder))  # its shuffle goes before the next trees'
    forget(spark, sent)
    return out


def _split(placed: DataFrame, folder: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """Each vector of a leaf once for each tile (leaf, x, y) that it is in, with its part of the leaf; and (leaf, n)."""
    sizes = stored(placed.groupBy("leaf").agg(F.count("*").alias("n")), folder)
    big = sizes.where(F.col("n") > tile).select("leaf", F.ceil(F.col("n") / tile).cast("int").alias("sides"))
    many = big.limit(FEW + 1).count()
    rows = placed.select("id", "v", "w", "leaves", "leaf")
    if not many:
        return rows.select("*", *(F.lit(0).alias(c) for c in ("x", "y", "part"))), sizes
    sided = rows.join(big.hint("broadcast" if many <= FEW else "merge"), "leaf", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    dealt = sided.withColumn("part", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return dealt.select("id", "v", "w", "leaves", "leaf", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), "part"), sizes
