"""N-gram Jaccard join: the blocked sparse product of the document by shingle incidence.

The product's columns are shingles, and only those of a row's prefix are kept: in an order that puts rare shingles first,
two sets of the wanted similarity share one of the first n - ceil(t n) + 1, so other columns cannot add a pair. Blocks are
shuffle partitions of columns. Pairs of sizes
that rule out the similarity are dropped; the others' overlaps are counted over whole sets and held against the bound that
the two sizes give.

Copies are one row: of the texts that have the same set, found by a digest of it, that of the least id is compared, and the others
belong to its component.

Only components are wanted, so a column of m rows isn't multiplied out to m * m pairs. Its first row is compared with each
other one, and components are formed. Columns whose other rows lie in one component are done. The rest are grouped by their
first row. In a small group the product of its columns gives the pairs across components that can reach the bound, which are
compared; a large one is multiplied out over whole sets in square tiles, cut in order of size so that tiles whose sizes rule
out the similarity aren't made. Every pair that shares a kept column is thus compared, ruled out, or lies in one component already.

What is shuffled at a time is bounded by the input: columns are joined in ranges of their hashes, and pairs and tiles get their
texts in as many rounds as these have of the input's shingles. A round's shuffle files go before the next.

The order: shingles that stand out in a sketch that counts every shingle of every text come last, the others go by the
frequency of their words, rare ones first, so that shingles that many texts have by chance seldom are kept. The sketches have
2**18 counters at any input size and decide only speed: any order gives the same links.

Defined results: null, empty or wordless text: 0 shingles, linked with nothing. Repeated doc_ids are one vertex, with the
links of all their rows; each row is returned. A null doc_id is returned with a null component. An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import components, forget, least_labels, shared_dir, shingle_sets, stored, text_chunks, tune, weighted_sets, windows, words

SIZE, SIMILARITY, SLOT_BITS = 5, (75, 100), 18
#: Rows of a group up to which its columns are multiplied; rows of a tile's side; columns multiplied at a time; copies that are broadcast.
SMALL, TILE, BLOCK, FEW = 400, 384, 4096, 100_000
#: Ranges of columns; shingles of texts that a round has at least.
RANGES, ROUND = 4, 5_000_000


def counted(docs: DataFrame, text: str = "text", bits: int = SLOT_BITS, size: int = SIZE, kinds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts in 2**bits slots each, of fixed size: of shingles, and (of two kinds) of words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in stream:
            for _, raw, bounds in text_chunks(batch.column(0)):
                hashes, _, _, first = words(raw, bounds, True)
                joined, _ = windows(hashes, first, size)
                for k, x in enumerate((joined, hashes)[:kinds]):
                    counts[k] += np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        kind, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(slot, pa.int32()), pa.array(counts[kind, slot])], ["kind", "slot", "n"])

    out = np.zeros((2, 1 << bits), np.int64)
    rows = docs.select(text).mapInArrow(run, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows["kind"].to_numpy(), rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out[0], out[1]


def frequent(counts: np.ndarray) -> np.ndarray:
    """Slots of the shingle count that stand out from the mean and its spread."""
    mean = float(counts.mean())
    return counts > mean + 6 * np.sqrt(mean) + 30


def prefixes(docs: DataFrame, counts: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, same_as, mark, prefix): a digest of each set and its first shingles, rare ones first; same_as instead of
    them where an earlier row of the task has the same set."""
    shingles, single = counts
    late = np.where(frequent(shingles), np.log2(shingles + 1.0) * 16, 0).astype(np.int64)
    up, down = similarity
    shift = np.uint64(64 - int(len(shingles)).bit_length() + 1)
    handed = docs.sparkSession.sparkContext.broadcast((late, np.round(np.log2(single + 1.0) * 4).astype(np.int64)))  # 4 MB at any input size

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (late, weights), seen = handed.value, {}
        for batch in stream:
            ids = batch.column(0).to_pylist()
            sizes, same, marks, lists, lengths = [], [], [], [], []
            for row, own, heavy in weighted_sets(batch.column(1), weights, size=size):
                n, key = len(own), None
                sizes.append(n)
                if n and ids[row] is not None:
                    key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    first = seen.get(key)
                    if first is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen[key] = ids[row]
                if key is None or first is not None:
                    same.append(first if key else None)
                    marks.append(None)
                    lengths.append(-1)
                    continue
                keep = n - -(-up * n // down) + 1
                order = np.argsort(heavy + 1000 * late[(own >> shift).astype(np.int64)], kind="stable")[:keep]
                same.append(None)
                marks.append(key)
                lists.append(own[order])
                lengths.append(keep)
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            lengths = np.array(lengths, np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0)))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(same, pa.int64()), pa.array(marks, pa.binary()), prefix], ["doc_id", "n_shingles", "same_as", "mark", "prefix"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n_shingles long, same_as long, mark binary, prefix array<long>")


def one_of_each(sets: DataFrame, folder: str) -> DataFrame:
    """prefixes with same_as, instead of a prefix, where a smaller id of any task has the same set; the stored sets go."""
    marks = sets.where("mark IS NOT NULL").select("mark", "doc_id")
    heads = marks.groupBy("mark").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("mark", "head")
    copies = stored(marks.join(heads, "mark").where("doc_id <> head").distinct(), folder)
    n = copies.count()
    if not n:
        return sets
    found = sets.join(copies.hint("broadcast" if n <= FEW else "merge"), ["mark", "doc_id"], "left")
    prefix = F.when(F.col("head").isNull(), F.col("prefix"))
    out = stored(found.select("doc_id", "n_shingles", F.coalesce("same_as", "head").alias("same_as"), prefix.alias("prefix")), folder)
    forget(sets.sparkSession, sets, copies)
    return out


def linked(pairs: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, size: int = SIZE) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    up, down = similarity

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, said, left = None, None, None
        for batch in stream:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            right = [s for _, s in shingle_sets(batch.column(3), size=size)]
            found = []
            lefts = batch.column(2)
            for i, other in enumerate(right):
                if last is None or a[i] != last or lefts[i].as_py() != said:
                    last, said = a[i], lefts[i].as_py()
                    left = next(s for _, s in shingle_sets(lefts.slice(i, 1), size=size))
                both = len(np.intersect1d(left, other, assume_unique=True))
                if both and down * both >= up * (len(left) + len(other) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], ["a", "b"])

    one = few(pairs, "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    wanted = few(stored(pairs.select("a").distinct()), "a").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.hint("merge").join(wanted, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of each left with each right set, added up over blocks of columns."""
    sizes = np.array([len(x) for x in (*left, *right)])
    out = np.zeros((len(left), len(right)), np.float32)
    if not sizes.sum():
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    column, at, seen = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    often = seen[at] > 1  # other columns add nothing
    row, at = row[often], np.unique(at[often], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    columns = int(at[-1]) + 1 if len(at) else 0
    for begin in range(0, columns, BLOCK):
        own = slice(*np.searchsorted(at, (begin, begin + BLOCK)))
        dense = np.zeros((len(sizes), min(BLOCK, columns - begin)), np.float32)
        dense[row[own], at[own] - begin] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def rounds(work: int, whole: int) -> int:
    """In how many rounds texts of `work` shingles are shuffled, of an input of `whole` ones."""
    return max(1, -(-work // max(whole, ROUND)))


def each_stored(tables: Iterable[DataFrame], folder: str) -> DataFrame:
    """The union of tables, written one after another as one stored table."""
    path = f"{folder}/{uuid.uuid4().hex}"
    for table in tables:
        table.write.mode("append").option("compression", "snappy").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def dealt(members: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(group, id, n, part, with): the part of TILE rows, by size, that a member (group, id, n) is in, and those it can be linked with."""
    up, down = similarity
    place = F.row_number().over(Window.partitionBy("group").orderBy("n", "id")) - 1
    placed = members.select("group", "id", "n").withColumn("part", F.floor(place / TILE).cast("int"))
    ends = placed.groupBy("group", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = ends.select("group", F.col("part").alias("with"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    meet = ends.join(other, "group").where((down * F.col("hi") >= up * F.col("low")) & (down * F.col("high") >= up * F.col("lo")))
    return placed.join(meet.groupBy("group", "part").agg(F.collect_list("with").alias("with")), ["group", "part"]).select("group", "id", "n", "part", "with")


def tiles(members: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, size: int = SIZE, turn: int = 0, turns: int = 1) -> DataFrame:
    """(a, b) that span the links within each group: members, as dealt, multiplied out over whole sets, tile by tile, in this turn of several."""
    up, down = similarity
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    own = F.filter("with", lambda w: F.pmod(F.xxhash64("group", F.least("part", w), F.greatest("part", w)), F.lit(turns)) == turn)
    rows = few(members.withColumn("with", own).where(F.size("with") > 0), "id").join(texts, "id").withColumn("with", F.explode("with"))
    rows = rows.select("id", "text", "group", "part", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"))

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame["x"].iloc[0]), int(frame["y"].iloc[0])
        sides = [frame[frame["part"] == k] for k in ((x,) if x == y else (x, y))]
        sets = [[s for _, s in shingle_sets(pa.array(f["text"], pa.string()), size=size)] for f in sides]
        ids = np.concatenate([f["id"].to_numpy(np.int64) for f in sides])
        left, right = sets[0], sets[-1]
        both = product(left, right)
        total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
        i, j = np.nonzero((both > 0) & ((up + down) * both >= up * total))
        j = j + (0 if x == y else len(left))
        labels = least_labels(i, j, np.arange(len(ids)))
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[labels[moved]]})

    return rows.groupBy("group", "x", "y").applyInPandas(multiply, "a long, b long")


def whole_groups(stream: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in the order of their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for i in range(keys):
            x = batch.column(i).to_numpy(zero_copy_only=False)
            same &= x == x[-1]
        other = np.flatnonzero(~same)
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        elif held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def column_pairs(rows: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b, n): pairs of different components in a group (group, id, n, component, hs) that can be linked.

    hs has half the bits of the row's kept columns that others have too: counts can only come out too high. Of two rows the one whose kept columns end first has all that it
    shares among them, so the overlap is at most their common columns and what follows in that row: this must reach the bound
    that the two sizes give.
    """
    up, down = similarity

    def pairs_of(ids: np.ndarray, n: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        follows = -(-up * n // down) - 1
        if len(ids) <= 12:
            held = [set(x.tolist()) for x in sets]
            both = np.array([[len(x & y) for y in held] for x in held])
        else:
            both = product(sets, sets)
        can = (both > 0) & (component[:, None] != component[None, :]) & (ids[:, None] < ids[None, :])
        can &= (up + down) * (both + np.maximum(follows[:, None], follows[None, :])) >= up * (n[:, None] + n[None, :])
        can &= down * np.minimum(n[:, None], n[None, :]) >= up * np.maximum(n[:, None], n[None, :])
        return np.nonzero(can)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, 1):
            group, ids, n, component = (table.column(i).to_numpy() for i in range(4))
            lists = table.column(4).combine_chunks()
            values, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            found: list[list[np.ndarray]] = [[], [], []]
            for own in np.split(np.arange(len(group)), np.flatnonzero(group[1:] != group[:-1]) + 1):
                if len(own) > 1 and (component[own] != component[own[0]]).any():
                    i, j = pairs_of(ids[own], n[own], component[own], [values[offsets[r] : offsets[r + 1]] for r in own])
                    for k, x in enumerate((ids[own[i]], ids[own[j]], n[own[j]])):
                        found[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found], ["a", "b", "n"])

    dealt = rows.select("group", "id", "n", "component", "hs").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long, n long")


def few(rows: DataFrame, key: str) -> DataFrame:
    """rows, said to be few by a filter that holds for all: Spark then sends a bloom filter of their keys to the join's other side."""
    return rows.where(F.col(key) >= F.lit(-(2**63)))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")  # else all texts are shuffled for the few, where these are over 10 MB
    folder = shared_dir(spark)
    up, down = similarity
    counts = counted(docs, text, size=size)
    sets = one_of_each(stored(prefixes(docs, counts, doc_id, text, similarity, size), folder), folder)
    base = stored(sets.select("doc_id", "n_shingles", "same_as"), folder)
    whole = base.agg(F.sum("n_shingles")).first()[0] or 0
    columns = sets.where("prefix IS NOT NULL").select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "h"))
    ranges = RANGES if whole > ROUND else 1

    def shared_columns(k: int) -> DataFrame:
        own = columns.where(F.pmod("h", F.lit(ranges)) == k)
        centres = own.groupBy("h").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("z")).where("c < z").select("h", "c")
        return own.join(centres, "h").select("h", "c", "doc_id", "n", "pos")

    held = each_stored(map(shared_columns, range(ranges)), folder)
    shared = held.where("c <> doc_id")
    forget(spark, sets)
    sizes = base.where("same_as IS NULL").select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m")).distinct()  # of a repeated id: one of each row
    total = F.col("n") + F.col("m")
    alike = (down * F.least("n", "m") >= up * F.greatest("n", "m")) & ((up + down) * (F.col("n") - F.col("pos")) >= up * total)
    same = base.where("same_as IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        sized = pairs.groupBy("a", "b", "n").agg(F.min("pos").alias("pos")).join(sizes, "a").where(alike)
        sized = stored(sized.groupBy("a", "b").agg(F.max(total).alias("work")), folder)
        turns = rounds(sized.agg(F.sum("work")).first()[0] or 0, whole)
        turn = F.pmod(F.xxhash64("a"), F.lit(turns))
        return each_stored((linked(sized.where(turn == k).select("a", "b"), docs, doc_id, text, similarity, size) for k in range(turns)), folder)

    first = verified(shared.select(F.col("c").alias("a"), F.col("doc_id").alias("b"), "n", "pos"))
    labels = components(same.unionByName(first), folder).withColumnRenamed("id", "doc_id")
    labelled = stored(shared.join(labels.hint("merge"), "doc_id", "left").select("h", "c", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), folder)
    several = labelled.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h")
    members = stored(labelled.join(several, "h").select(F.col("c").alias("group"), F.col("doc_id").alias("id"), "n", "component").distinct(), folder)
    groups = members.groupBy("group").agg(F.count("*").alias("rows"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    sided = members.join(groups.select("group", "rows"), "group")
    large = stored(dealt(sided.where(F.col("rows") > SMALL), similarity), folder)
    turns = rounds(large.agg(F.sum(F.col("n") * F.size("with"))).first()[0] or 0, whole)
    spans = each_stored((tiles(large, docs, doc_id, text, similarity, size, k, turns) for k in range(turns)), folder)
    few_members = sided.where(F.col("rows") <= SMALL).drop("rows")
    kept = held.join(few_members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.expr("cast(h & 2147483647 as int)")).alias("hs"))
    second = verified(column_pairs(few_members.join(kept, "id"), similarity).withColumn("pos", F.lit(0)))
    forget(spark, held, labelled, members, large)
    known = components(same.unionByName(first).unionByName(spans).unionByName(second), folder)
    out = base.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
