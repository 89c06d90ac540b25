"""Helpers of the llm operators: shared-folder tables, array text hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_STEPS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


# --- session and shared storage -------------------------------------------------------------


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits in a Python worker; shuffle files go when their query ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")  # a large table joined with few keys is filtered before its shuffle
    trim(spark)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the session ends; a local session has a default."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file:///tmp/checkpoints"
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/newsloom-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, a table as it is read, dealt out anew where it has fewer partitions than the session has cores: a small one in few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            discard(spark, file.rpartition("/")[0])
    spark.sparkContext._jvm.System.gc()  # plans, shuffles and broadcasts that only they were for are let go as garbage is collected
    trim(spark)


def trim(spark: SparkSession) -> str:
    """The driver gives back memory that compilers and ended threads have freed, which its C library keeps; what the JVM says
    of it, empty where it has no such command."""
    context = spark.sparkContext
    jvm, new = context._jvm, context._gateway.new_array
    release()
    try:
        kind = jvm.java.lang.Class.forName
        types, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", types)  # by its interface: the class isn't open
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return ""


# --- words and shingles as arrays of hashes --------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 23:
            _powers[name] = have
    return have[:n]


def release() -> None:
    """Gives freed memory back, as a worker is used again by tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_read = [0]  # bytes of text since memory was given back


def text_chunks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) for runs of rows of about `most` bytes; a longer text is a run of its own. Null: empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary()).cast(pa.large_string())
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        last = min(last, n)
        yield row, raw[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last
    _read[0] += len(raw)
    if _read[0] > 16 << 20:  # not after each batch: memory that is given back has to be asked for again
        _read[0] = 0
        release()


def words(raw: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte, end byte of each word, and for each text the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * _power("up", _BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power("down", _BASE_INV, n)[starts])
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def windows(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` words that lies inside one text, and for each text the index of its first window."""
    n = len(hashes)
    count = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(count, out=begin[1:])
    if n < size:
        return np.zeros(0, np.uint64), begin
    with np.errstate(over="ignore"):
        joined = hashes[: n - size + 1] * _STEPS[0]
        for k in range(1, size):
            joined = joined + hashes[k : n - size + 1 + k] * _STEPS[k]
        joined = mix(joined)
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    return joined[at], begin


def shingle_sets(texts: pa.Array, lower: bool = True, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; a text of fewer words gives its whole sequence as one shingle."""
    for row, own, _ in weighted_sets(texts, None, lower, size):
        yield row, own


def weighted_sets(texts: pa.Array, weights: np.ndarray | None, lower: bool = True, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """shingle_sets with, for each shingle, the sum of its words' weights; weights are found by the top bits of word hashes."""
    for row, raw, bounds in text_chunks(texts):
        hashes, _, _, first = words(raw, bounds, lower)
        joined, begin = windows(hashes, first, size)
        if weights is not None:
            total = np.concatenate(([0], np.cumsum(weights[(hashes >> np.uint64(64 - int(len(weights)).bit_length() + 1)).astype(np.int64)])))
            at = np.repeat(first[:-1] - begin[:-1], np.diff(begin)) + np.arange(begin[-1])
            sums = total[at + size] - total[at]
        for i in range(len(bounds) - 1):
            own = joined[begin[i] : begin[i + 1]]
            if weights is not None:
                if len(own):
                    own, place = np.unique(own, return_index=True)
                    yield row + i, own, sums[begin[i] : begin[i + 1]][place]
                    continue
                heavy = np.zeros(1 if first[i + 1] > first[i] else 0, np.int64)
            else:
                heavy = None
            if not len(own) and first[i + 1] > first[i]:
                short = hashes[first[i] : first[i + 1]]
                with np.errstate(over="ignore"):
                    own = mix((short * _STEPS[: len(short)]).sum(keepdims=True) + np.uint64(len(short)))
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield row + i, own, heavy


def least_labels(i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """labels with i and j joined for each pair: the least label of a component, where labels[x] is a member of x's."""
    while len(i):
        m = np.minimum(labels[i], labels[j])
        if (labels[i] == m).all() and (labels[j] == m).all():
            break
        for at in (labels[i], labels[j], i, j):
            np.minimum.at(labels, at, m)
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that edges reach.

    Alternating large-star and small-star rounds: each is two aggregations and two joins by key, linear in the edges,
    with a hub's aggregation combined before the shuffle. Each round is written to the shared folder.
    Repeated edges, loops and nulls are dropped first.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder
    )
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, folder)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.*").where("a <> b").distinct()
        after = stored(small, folder)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(spark, now, large)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
