"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity`. The plan is made from the histogram of piece lengths, which has at most
`capacity` entries at any input size: large lengths are cut into groups of equal cardinality and rounded up to the largest of
their group; a linear program over fillings of a sequence (columns generated by a knapsack, solved by the simplex method) packs
the few rounded sizes; actual documents take the rounded places; small ones go best-fit into what is left, then into new
sequences. Pieces are matched with the plan by their rank among those of equal length, so nothing of the size of the input is
collected and no group of equal lengths meets in one task.

Defined results: null text is empty: the end token alone. A text of any length is encoded whole; one of more than `capacity`
tokens is cut, the first piece taking what doesn't fill a whole one. Repeated rows are packed row by row. An empty table gives
no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe
from ._shared import shared_dir, stored

CAPACITY, END, GROUPS = 2048, 0, 32
#: Shares of the capacity from which a length counts as large; the plan of fewest sequences is taken.
LARGE = (1 / 4, 1 / 3, 0.45, 1 / 2)
#: Rows of equal length ranked in one task.
RANKED = 200_000


# --- pieces -------------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each row's ids followed by `end`."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(path)
        tail = np.array([end] if end is not None else [], "<u4")
        for batch in bpe.batches(stream, own):
            at, piece, start, length, crc, parts = [], [], [], [], [], []
            for row, ids in enumerate(own.encode(batch.column(1).to_pylist())):
                ids = np.concatenate((ids.astype("<u4"), tail))
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


# --- the plan -----------------------------------------------------------------------------------


def groups_of(sizes: dict[int, int], k: int) -> list[list[tuple[int, int]]]:
    """Large lengths in descending order, dealt into k groups of equal cardinality: lists of (length, count)."""
    per = -(-sum(sizes.values()) // k)
    out: list[list[tuple[int, int]]] = [[]]
    room = per
    for length in sorted(sizes, reverse=True):
        left = sizes[length]
        while left:
            if not room:
                out.append([])
                room = per
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return [g for g in out if g]


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one sequence that is worth most."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        fits = [(best[c - s] + prices[i], i) for i, s in enumerate(sizes) if s <= c and prices[i] > 1e-12]
        if fits and (top := max(fits))[0] > best[c] + 1e-12:
            best[c], last[c] = top
    filling, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            filling[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), filling


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 400) -> list[tuple[np.ndarray, int]]:
    """(filling, times) that cover the demand for few sizes: column generation, rounded down, the rest by first fit."""
    k = len(sizes)
    need = np.array(demand, float)
    basis = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    for _ in range(most):
        prices = inverse.sum(axis=0)  # each sequence costs 1
        value, filling = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction, level = inverse @ filling, inverse @ need
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, level / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[out] = filling
        inverse = np.linalg.inv(np.array(basis, float).T)
    times = np.floor(np.maximum(inverse @ need, 0) + 1e-9).astype(np.int64)
    left = np.array(demand, np.int64)
    plan: list[tuple[np.ndarray, int]] = []
    for filling, t in zip(basis, times, strict=True):
        with np.errstate(divide="ignore"):
            t = int(min([t, *(left[filling > 0] // filling[filling > 0])]))
        if t > 0:
            plan.append((filling, t))
            left = left - filling * t
    while left.any():  # first fit by descending size, whole runs at a time
        filling, room = np.zeros(k, np.int64), capacity
        for i in range(k):
            filling[i] = min(left[i], room // sizes[i])
            room -= filling[i] * sizes[i]
        t = int(min(left[filling > 0] // filling[filling > 0]))
        plan.append((filling, t))
        left = left - filling * t
    return plan


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: Sequence[float] = LARGE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) that place every piece of the histogram."""
    plans = [_plan(histogram, capacity, groups, share) for share in large]
    return min(plans, key=lambda p: sum(t for _, t in p))


def _plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[tuple[int, ...], int]]:
    big = {n: c for n, c in histogram.items() if n > large * capacity}
    dealt = groups_of(big, groups)
    runs: list[tuple[tuple[int, ...], int]] = []
    if dealt:
        sizes, demand = [g[0][0] for g in dealt], [sum(c for _, c in g) for g in dealt]
        queues = [[list(x) for x in g] for g in dealt]
        for filling, times in configurations(sizes, demand, capacity):
            places = np.repeat(np.arange(len(sizes)), filling)
            while times:  # actual lengths take the rounded places, in runs of equal ones
                taken: list[int] = []
                used: Counter = Counter()
                heads: list[tuple[int, int]] = []
                for g in places:
                    j = 0
                    while queues[g][j][1] - used[g, j] <= 0:
                        j += 1
                    used[g, j] += 1
                    heads.append((g, j))
                    taken.append(queues[g][j][0])
                t = min([times, *(queues[g][j][1] // u for (g, j), u in used.items())])
                for (g, j), u in used.items():
                    queues[g][j][1] -= u * t
                for g in set(places.tolist()):
                    while queues[g] and not queues[g][0][1]:
                        queues[g].pop(0)
                runs.append((tuple(taken), t))
                times -= t
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, t in runs:
        room[capacity - sum(lengths)].append((lengths, t))
    open_rooms = np.zeros(capacity + 1, bool)
    open_rooms[[r for r in room if room[r]]] = True
    for n in sorted((n for n in histogram if n <= large * capacity), reverse=True):  # best fit
        left = histogram[n]
        while left:
            fits = np.flatnonzero(open_rooms[n:])
            if not len(fits):
                room[capacity].append(((), left))  # new sequences, as many as could be needed
                open_rooms[capacity] = True
                continue
            r = int(fits[0]) + n
            lengths, t = room[r].pop()
            open_rooms[r] = bool(room[r])
            take = min(t, left)
            if r == capacity:  # fill new sequences one after another
                per = min(capacity // n, left)
                take = left // per
                room[capacity - per * n].append(((n,) * per, take))
                open_rooms[capacity - per * n] = True
                left -= take * per
                continue
            left -= take
            room[r - n].append(((*lengths, n), take))
            open_rooms[r - n] = True
            if t > take:
                room[r].append((lengths, t - take))
                open_rooms[r] = True
    return [(lengths, t) for own in room.values() for lengths, t in own if lengths]


# --- placing ------------------------------------------------------------------------------------


def ranked(rows: DataFrame, n_rows: int, by: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """rows with rank (from 0, long) among those of equal `by`; hot values are ranked in hash buckets that are then lined up."""
    buckets = max(1, n_rows // RANKED)
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    count = dealt.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offset = count.select(by, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    inner = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1
    return dealt.withColumn("__r", inner).join(offset, [by, "__b"]).withColumn("rank", F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def place(rows: DataFrame, chosen: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """rows (with length and rank) with sequence_id and offset, by the plan; its size follows the number of different lengths."""
    seen: Counter = Counter()
    spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, t in chosen:
        offset = 0
        for n in lengths:
            spans[n].append((seen[n], first, offset))
            seen[n] += t
            offset += n
        first += t
    tables = {n: np.array(x, np.int64).T for n, x in spans.items()}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                begins, firsts, offsets = tables[n]
                at = np.searchsorted(begins, rank[own], "right") - 1
                sequence[own], offset[own] = firsts[at] + rank[own] - begins[at], offsets[at]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("rank").schema)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", groups: int = GROUPS, large: Sequence[float] = LARGE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = stored(pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, capacity), shared_dir(docs.sparkSession))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    chosen = plan(histogram, capacity, groups, large)
    placed = place(ranked(cut, sum(histogram.values()), order=("doc_id", "piece", "start", "ids_crc32")), chosen)
    return placed.select(F.col("doc_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
