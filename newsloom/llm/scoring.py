"""Cross-entropy difference of matched n-gram models.

A target and a background bigram model share one vocabulary: every word of the corpus. Each text's score is the mean over its
tokens of background loss less target loss: higher means more like the target. The background is every text, the target those
that are marked.

Models: unigram probabilities with additive smoothing, P(b) = (c(b) + SMOOTH) / (N + SMOOTH * (V + 1)), the one more for words
that no text has; pairs are mixed in, P(b|a) = MIX * c(a, b) / c(a) + (1 - MIX) * P(b), with c(a) the pairs that begin with a;
after a word without pairs P(b) alone. The probabilities of a context add up to 1. No word or pair of the corpus is left out.

The models grow with the corpus, so no task holds one. Texts are dealt in blocks of bounded size; a block asks for the counts
of its own different words and pairs, and brings how often it has each. Requests are sorted by key hash and dealt to buckets of
bounded size, which add up the counts of all blocks and answer each; every block then scores its texts. A key is asked for once
by a block, however frequent it is, so that buckets are even. The keys are cut in RANGES by hash and answered one range after
another, so that only a part of the requests is shuffled at a time, and those that are answered go.

Defined results: null text or one without words has no tokens: 0 tokens and null losses. A corpus without target texts gives
the target model its smoothing only. Repeated rows count as often as they occur. An empty table gives no rows. Null id: kept,
never a target. Further columns are not read. Key hashes of 55 bits stand for words and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._shared import discard, mix, release, shared_dir, stored, text_chunks, tune, words

MIX, SMOOTH = 0.5, 0.1
#: Bytes of text of a block, keys of a bucket, target ids that are broadcast.
BLOCK, BUCKET, FEW = 5 << 20, 600_000, 500_000
#: Ranges of keys, a power of two.
RANGES = 4
_SEED = np.random.default_rng(41).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as the planes of their bytes, as many as the greatest has, compressed; first come the planes and the numbers' count."""
    planes = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    raw = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return np.array([planes, len(x)], np.uint64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(x: pa.Scalar) -> np.ndarray:
    raw = x.as_py()
    planes, n = np.frombuffer(raw, np.uint64, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(raw[16:], planes * n, "zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return out.view(np.uint64).reshape(-1)


def _packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys: the first one, and differences."""
    return x[:1].tobytes() + _packed(np.diff(x)) if len(x) else b""


def _unpacked_keys(x: pa.Scalar) -> np.ndarray:
    raw = x.as_py()
    if not raw:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(raw, np.uint64, 1), _unpacked(pa.scalar(raw[8:], pa.binary())))), dtype=np.uint64)


class Block:
    """The tokens of a run of texts as numbers of its different words, pairs and contexts, and their keys."""

    def __init__(self, texts: list[pa.Array]) -> None:
        hashes, firsts, n = [], [np.zeros(1, np.int64)], 0
        for array in texts:
            for _, raw, bounds in text_chunks(array):
                own, _, _, first = words(raw, bounds, True)
                hashes.append(own)
                firsts.append(first[1:] + n)
                n += len(own)
        self.first = np.concatenate(firsts)
        self.words, number = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        del hashes
        self.number = number.astype(np.int32)
        inner = np.ones(max(0, n - 1), bool)  # tokens that have one before them in their text
        inner[self.first[(self.first > 0) & (self.first < n)] - 1] = False
        self.second = np.flatnonzero(inner) + 1
        code = number[self.second - 1] * max(1, len(self.words)) + number[self.second]
        del number
        self.pairs, pair = np.unique(code, return_inverse=True)
        del code
        self.pair = pair.astype(np.int32)
        self.before, self.after = np.divmod(self.pairs, max(1, len(self.words)))
        self.contexts, self.context = np.unique(self.before, return_inverse=True)  # of each pair

    def keys(self) -> np.ndarray:
        """Of words (odd), contexts and pairs (even), below 2**56."""
        one, low = np.uint64(1), np.uint64(8)
        with np.errstate(over="ignore"):
            single = mix(self.words * _SEED[0])
            context = mix(self.words[self.contexts] * _SEED[1])
            pair = mix(self.words[self.before] * _SEED[2] + self.words[self.after] * _SEED[3])
        return np.concatenate((single >> low | one, context >> low & ~one, pair >> low & ~one))

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """[in all texts, in marked texts] of each key."""
        own = np.repeat(marked, np.diff(self.first))
        out = []
        for numbers, pairs in ((self.number, self.pair), (self.number[own], self.pair[own[self.second]])):
            pair = np.bincount(pairs, minlength=len(self.pairs))
            context = np.bincount(self.context, pair, len(self.contexts)).astype(np.int64)
            out.append(np.concatenate((np.bincount(numbers, minlength=len(self.words)), context, pair)))
        return np.array(out)

    def losses(self, counts: np.ndarray, n: float, vocabulary: int) -> np.ndarray:
        """Loss of each token in nats, by the counts of each key in the corpus, and of tokens and words in all."""
        single, context, pair = np.split(counts.astype(float), np.cumsum((len(self.words), len(self.contexts))))
        of_word = (single + SMOOTH) / (n + SMOOTH * (vocabulary + 1))
        out = of_word[self.number]
        follows = context[self.context]
        rest = of_word[self.after]
        of_pair = np.where(follows > 0, MIX * pair / np.maximum(follows, 1) + (1 - MIX) * rest, rest)
        out[self.second] = of_pair[self.pair]
        return -np.log(out)


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (id, text, target) with the block of each, and one more row for each block and range of keys that it has (the first always): its sorted keys and their counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            own = Block([b.column(1) for b in held])
            marked = np.concatenate([b.column(2).to_numpy(zero_copy_only=False).astype(bool) for b in held])
            keys = own.keys()
            order = np.argsort(keys)
            keys, counts = keys[order], own.counts(marked)[:, order]
            for b in held:
                blank = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number)), b.column(0), b.column(1), *blank], names)
            cuts = np.searchsorted(keys, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(2**56 // RANGES)).tolist()
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x < y or not k:
                    parts = (_packed_keys(keys[x:y]), *(_packed(c[x:y]) for c in counts))
                    row = [pa.array([number]), pa.nulls(1, held[0].column(0).type), pa.nulls(1, pa.string()), pa.array([k], pa.int32()), pa.array([y - x]), *(pa.array([p], pa.binary()) for p in parts)]
                    yield pa.RecordBatch.from_arrays(row, names)
            release()

        for batch in stream:
            at = 0
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                last = max(at + 1, int(np.searchsorted(sizes, done + BLOCK - size, "right")))
                held.append(batch.slice(at, last - at))
                size += int(sizes[min(last, batch.num_rows) - 1]) - done
                at = last
                if size >= BLOCK or at < batch.num_rows:
                    yield from close()
                    held, size, number = [], 0, number + 1
        if held:
            yield from close()

    names = ["block", "id", "text", "range", "n_keys", "keys", "n", "t"]
    return docs.select("id", "text", "target").mapInArrow(run, f"block long, id {kind}, text string, range int, n_keys long, keys binary, n binary, t binary")


def _answers(requests: DataFrame, before: int, buckets: int) -> DataFrame:
    """(block, bucket, n, t): counts in the whole corpus of each block's keys, in order; block null: v, v_n and v_t have a bucket's
    different words and the sums of their counts. requests are of one range of keys, in `buckets` buckets after `before` others."""

    def split(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                keys, n, t = _unpacked_keys(batch.column(1)[row]), _unpacked(batch.column(2)[row]), _unpacked(batch.column(3)[row])
                if not len(keys):
                    continue
                own = ((keys >> np.uint64(24)) * np.uint64(buckets * RANGES) >> np.uint64(32)).astype(np.int64) - before
                found, begin = np.unique(own, return_index=True)
                end = [*begin[1:], len(keys)]
                parts = [pa.array([f(x[a:b]) for a, b in zip(begin, end, strict=True)], pa.binary()) for x, f in ((keys, _packed_keys), (n, _packed), (t, _packed))]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([batch.column(0)[row].as_py()] * len(found), pa.int64()), *parts], ["bucket", "block", "keys", "n", "t"])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> pa.RecordBatch:
            keys, n, t = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            held[:] = [(x[0], len(x[1])) for x in held]
            found, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at, x, len(found)).astype(np.int64) for x in (n, t)]
            cuts = np.cumsum([x[1] for x in held])[:-1]
            parts = [[_packed(x) for x in np.split(s[at], cuts)] for s in sums]
            word = (found & np.uint64(1)).astype(bool)
            columns = [pa.array([x[0] for x in held] + [None], pa.int64()), pa.array([bucket + before] * (len(held) + 1), pa.int32())]
            columns += [pa.array([None] * len(held) + [int(x)], pa.int64()) for x in (word.sum(), *(s[word].sum() for s in sums))]
            columns += [pa.array([*p, None], pa.binary()) for p in parts]
            return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "v", "v_n", "v_t", "n", "t"])

        for batch in stream:
            for row, own in enumerate(batch.column(0).to_pylist()):
                if own != bucket and held:
                    yield close()
                    held = []
                bucket = own
                held.append((batch.column(1)[row].as_py(), _unpacked_keys(batch.column(2)[row]), _unpacked(batch.column(3)[row]), _unpacked(batch.column(4)[row])))
        if held:
            yield close()
        release()

    dealt = requests.select("block", "keys", "n", "t").mapInArrow(split, "bucket int, block long, keys binary, n binary, t binary")
    return dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(add, "block long, bucket int, v long, v_n long, v_t long, n binary, t binary")


def _scored(rows: DataFrame, kind: str, doc_id: str, totals: tuple[int, int, int]) -> DataFrame:
    """Scores of rows in the order of block, each block's answers before its texts."""
    names = [doc_id, "n_tokens", "background_loss", "target_loss", "difference"]
    vocabulary, *sums = totals

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers, held = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            own = Block([b.column(3) for b in held])
            order = np.argsort(own.keys())
            sizes = np.diff(own.first)
            mean = []
            for k in range(2):
                counts = np.empty(len(order), np.int64)
                counts[order] = np.concatenate([a[k] for a in answers]) if len(order) else []
                total = np.concatenate(([0.0], np.cumsum(own.losses(counts, sums[k], vocabulary))))
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean.append((total[own.first[1:]] - total[own.first[:-1]]) / sizes)
            none = sizes == 0
            columns = [pa.array(x, pa.float64(), mask=none) for x in (*mean, mean[0] - mean[1])]
            ids = pa.concat_arrays([b.column(2) for b in held])
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *columns], names)
            release()

        for batch in stream:
            blocks = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if blocks[a] != block:
                    if held:
                        yield from close()
                    block, answers, held = blocks[a], [], []
                asked = batch.column(1).slice(a, b - a).to_pylist()
                n = sum(x is not None for x in asked)  # answers come first
                answers += [tuple(_unpacked(batch.column(i)[a + r]).astype(np.int64) for i in (4, 5)) for r in range(n)]
                if b - a > n:
                    held.append(batch.slice(a + n, b - a - n))
        if held:
            yield from close()

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, background_loss double, target_loss double, difference double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, background_loss, target_loss (means per token), difference (background less target) of every row.

    The target is the docs in target_ids (a column named like doc_id).
    """
    spark = docs.sparkSession
    tune(spark)
    folder = shared_dir(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    marks = stored(target_ids.select(F.col(doc_id).alias("__t")).where("__t IS NOT NULL").distinct(), folder)
    how = "broadcast" if marks.count() <= FEW else "merge"
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(marks.hint(how), F.col("id") == F.col("__t"), "left")
    path = f"{folder}/blocks"
    both = _blocks(rows.select("id", "text", F.col("__t").isNotNull().alias("target"))).withColumn("kind", F.coalesce(F.col("range").cast("string"), F.lit("text")))
    both.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    written = spark.read.schema(both.schema).parquet(path)
    dealt, asked = written.where("kind = 'text'").drop("kind"), written.where("kind <> 'text'")
    n_keys, last = asked.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.max("block"), F.lit(0))).first()
    buckets = max(RANGES, -(-int(n_keys) // BUCKET), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_keys) // 50_000)))
    buckets = -(-buckets // RANGES)  # of a range
    for k in range(RANGES):
        _answers(asked.where(F.col("kind") == str(k)).drop("kind"), k * buckets, buckets).write.mode("append").option("compression", "snappy").parquet(f"{folder}/answers")
        discard(spark, f"{path}/kind={k}")
    answers = spark.read.schema("block long, bucket int, v long, v_n long, v_t long, n binary, t binary").parquet(f"{folder}/answers")
    totals = tuple(answers.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "v_n", "v_t")]).first())
    texts = dealt.select("block", F.lit(None).cast("int").alias("bucket"), "id", "text", *[F.lit(None).cast("binary").alias(c) for c in "nt"])
    own = answers.where("block IS NOT NULL").select("block", "bucket", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), "n", "t")
    both = texts.unionByName(own).repartitionById((last >> 24) + 1, F.shiftright("block", 24).cast("int"))
    return _scored(both.sortWithinPartitions("block", F.col("bucket").asc_nulls_last()), kind, doc_id, totals)
