"""Byte-level BPE encoding and decoding by a pair occurrence index.

Per batch: texts are cut into segments that no pre-token crosses (white space, then what follows it), distinct segments into
pre-tokens, and all new pre-tokens are merged together: an index maps the rank of each adjacent pair to all its positions;
ranks are applied in ascending order by a heap, each to all its positions at once, and the lists of the pairs that this makes
are updated. Merges of a BPE vocabulary only make pairs of higher ranks, so ascending order gives what a merge loop per word
gives. Segments stay in a bounded cache of the Python worker.

Special tokens of the vocabulary file that occur in a text become their ids, as the tokenizers library does by default.

Defined results: null text is an empty text: no ids, decoded to an empty text. A text of any length is encoded whole, in
slices between segments. Repeated rows are encoded row by row; an empty table gives no rows. Further columns of the input
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import release

#: The pre-token pattern of byte-level BPE, Latin letters of one byte in Latin-1, Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Segments that a worker's cache holds, longest segment held, code points encoded at a time, bytes of text in a batch.
CACHE, LONGEST, SLICE, BATCH = 250_000, 40, 1 << 20, 5 << 20
_NO_RANK = np.int64(2**40)


def _byte_letters() -> dict[str, int]:
    """The letter that a vocabulary file writes for each byte: itself if printable, else the next free from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(free)): b for b in range(256)}


class _Numbers(dict):
    """Numbers of segments; one that is asked for first gets the next number and is listed in new."""

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.new.append(segment)
        return number


class Codec:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right, self.made = left, right, np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        parts: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            parts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.part_length = np.array([len(p) for p in parts], np.int64)
        self.part_start = np.concatenate(([0], np.cumsum(self.part_length)[:-1]))
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.pre = regex.compile(PATTERN)
        self.segment = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        #: PATTERN for texts of `simple` characters only, where each class can be written out.
        self.simple = re.compile(f"[\\x00-\\x7f{LATIN}]*")
        self.plain = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\\t-\\r {LATIN}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")
        self.cut = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers({t: k for k, t in enumerate(self.special)})
        self.known.new = []
        self.flat = np.array([*self.special.values()], np.int64)
        self.start = np.arange(len(self.special), dtype=np.int64)
        self.length = np.ones(len(self.special), np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], _NO_RANK)

    def merge(self, tokens: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pre-tokens one after another, and how many each has, by the pair occurrence index."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(symbol)
        if not n:
            return symbol, sizes
        small = np.int32 if n < 2**31 else np.int64
        after, before = np.arange(1, n + 1, dtype=small), np.arange(-1, n - 1, dtype=small)
        ends = np.cumsum(sizes)
        after[ends[ends > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = self._ranks(symbol[places], symbol[after[places]])
            has = ranks < _NO_RANK
            places, ranks = places[has], ranks[has]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[rank], self.right[rank]
            follows = after[places]
            places = places[alive[places] & (symbol[places] == a) & (follows >= 0) & (symbol[follows] == b)]
            if a == b and len(places) > 1:  # overlapping: leftmost first
                taken, last = [], -1
                for p, q in zip(places.tolist(), after[places].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                places = np.array(taken, np.int64)
            if not len(places):
                continue
            gone = after[places]
            symbol[places] = self.made[rank]
            alive[gone] = False
            beyond = after[gone]
            after[places] = beyond
            has = beyond >= 0
            before[beyond[has]] = places[has]
            prior = before[places]
            note(np.unique(np.concatenate((prior[prior >= 0], places[has]))))
        counts = np.add.reduceat(alive.astype(np.int64), np.minimum(ends - sizes, n - 1)) if len(sizes) else sizes
        return symbol[alive], np.where(sizes > 0, counts, 0)

    def _learn(self, segments: list[str], whole: bool) -> None:
        """Ids of new segments; self.known has their numbers already. whole: each is a pre-token."""
        if whole:
            flat, lengths = self.merge([s.encode() for s in segments])
        else:
            flat, lengths = self._of_words(segments)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.flat = np.concatenate((self.flat, flat))

    def _of_words(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[str, int] = {}
        uses: list[int] = []
        per: list[int] = []
        for s in segments:
            found = self.pre.findall(s)
            per.append(len(found))
            uses += [words.setdefault(w, len(words)) for w in found]
        ids, sizes = self.merge([w.encode() for w in words])
        starts = np.cumsum(sizes) - sizes
        uses_at = np.array(uses, np.int64)
        flat = _gather(ids, starts[uses_at], sizes[uses_at])
        bounds = np.concatenate(([0], np.cumsum(per)))
        total = np.concatenate(([0], np.cumsum(sizes[uses_at])))
        return flat, total[bounds[1:]] - total[bounds[:-1]]

    def _segments(self, text: str, simple: bool) -> Iterator[list[str]]:
        """Lists of segments of a text, of about SLICE code points each; of a simple text, its pre-tokens."""
        segment = self.plain if simple else self.segment
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield [part]
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > SLICE and (m := self.cut.search(part, at + SLICE)):
                    end = m.start()
                yield segment.findall(part, at, end)
                at = end

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > CACHE:
            self._reset()
        whole = True
        numbers: list[list[np.ndarray]] = []
        known = self.known
        new = known.new = []
        for text in texts:
            own = []
            simple = self.simple.fullmatch(text or "") is not None
            for found in self._segments(text or "", simple):
                had = len(new)
                own.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                whole &= simple or len(new) == had
            numbers.append(own)
        if new:
            self._learn(new, whole)
        for own in numbers:
            at = np.concatenate(own) if own else np.zeros(0, np.int32)
            yield _gather(self.flat, self.start[at], self.length[at])
        if any(len(s) > LONGEST for s in new):
            self._trim()

    def _trim(self) -> None:
        """Drops long segments, which seldom come again, when they'd fill the cache."""
        if len(self.flat) > 8 * CACHE:
            self._reset()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(self.part_bytes, self.part_start[ids], self.part_length[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and length, joined."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1])]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and file."""
    return Codec(path)


def batches(stream: Iterator[pa.RecordBatch], codec: Codec, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Record batches joined up to BATCH bytes, so that their new pre-tokens are merged together; then the cache is emptied."""
    held, size = [], 0
    release()
    for batch in stream:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            release()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    codec._reset()  # the worker goes on to tasks of other stages
    held.clear()
    release()


#: Columns that encode() can give.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", outputs: Sequence[str] = ("ids", "n_tokens")) -> DataFrame:
    """doc_id and the `outputs` of each row's text: its ids, their count, the text decoded from the ids, and digests of both."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(stream, own):
            rows: dict[str, list] = {c: [] for c in outputs}
            keys = batch.column(0)
            for ids in own.encode(batch.column(1).to_pylist()):
                plain = ids.astype("<u4")
                decoded = own.decode(ids) if {"decoded", "decoded_sha256"} & set(outputs) else ""
                for c in outputs:
                    rows[c].append(
                        plain.astype(np.int32)
                        if c == "ids"
                        else len(ids)
                        if c == "n_tokens"
                        else hashlib.sha256(plain.tobytes()).hexdigest()
                        if c == "ids_sha256"
                        else decoded
                        if c == "decoded"
                        else hashlib.sha256(decoded.encode()).hexdigest()
                    )
            types = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(rows[c], types[OUTPUTS[c]]) for c in outputs)], [doc_id, *outputs])

    return docs.select(doc_id, text).mapInArrow(run, ", ".join([f"`{doc_id}` {kind}", *(f"{c} {OUTPUTS[c]}" for c in outputs)]))


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each row's ids (null: empty text)."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in stream:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [doc_id, "decoded"])

    return encoded.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind}, decoded string")
