"""WARC archives: writing, the monolithic gzip normaliser, and reading by its sidecar index.

write() makes archives whose records share one gzip stream. normalise() inflates each such file once, front to back, rewrites
every record as a gzip member of its own and writes a sidecar index of offsets beside it. read() seeks to each member.

Files lie in the shared folder, named by partition and attempt; only the names that a task returns count, so a task that is
run again leaves no record twice. A task holds one record and fixed buffers.

Defined results: null html is an empty payload; null url has no target header; a null page_id has an empty record id, never
is referred to, and revisits a response of equal payload if that has an id. Of equal payloads every row with the largest
page_id is a response (repeated rows too). An empty table gives no records. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._shared import shared_dir, stored

ID, DATE, LEVEL, BUFFER, ROLL = "urn:newsloom:page:", "2024-01-01T00:00:00Z", 6, 1 << 20, 512 << 20


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record of an HTTP response; a revisit has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{ID}{refers_to}>"}
    fields["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class Inflated:
    """What a gzip file of one or more members holds, read front to back."""

    def __init__(self, file) -> None:
        self.file, self.engine, self.held, self.ended = file, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        left = self.engine.unconsumed_tail
        if not left and self.engine.eof:
            left, self.engine = self.engine.unused_data, zlib.decompressobj(31)
        left = left or self.file.read(BUFFER)
        if not left:
            self.ended = True
            return False
        self.held += self.engine.decompress(left, BUFFER)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; None at the end."""
        at = 0
        while (found := self.held.find(mark, max(0, at))) < 0:
            at = len(self.held) - len(mark)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[: found + len(mark)])
        del self.held[: found + len(mark)]
        return out

    def parts(self, size: int) -> Iterator[bytes]:
        """The next size bytes, in pieces."""
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            yield out


# --- operators ----------------------------------------------------------------------------------


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Payloads of fewer than `least` bytes are never revisits."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "sha", "left")
    revisit = F.coalesce((F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """(path, n) of archives, each a single gzip stream over all its records."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _files(folder)
        file, engine, n, size, made = None, None, 0, 0, []
        for batch in stream:
            for page_id, url, payload, refers, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if file is None:
                    fs.create_dir(f"{base}/raw")
                    path = f"{base}/raw/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made)}.warc.gz"
                    file, engine, n, size = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                raw = record(page_id, url, payload, refers, revisit)
                file.write(engine.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= ROLL:
                    file.write(engine.flush())
                    file.close()
                    made, file = [*made, (path, n)], None
        if file is not None:
            file.write(engine.flush())
            file.close()
            made = [*made, (path, n)]
        yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[1] for p, _ in made], pa.string()), pa.array([x for _, x in made], pa.int64())], ["path", "n"])

    return records.mapInArrow(run, "path string, n long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives (path, n) rewritten with a gzip member for each record and a sidecar index: (path, n, size)."""

    def rewrite(fs, base: str, name: str, attempt: int) -> tuple[str, int, int]:
        out = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz"
        at, n = 0, 0
        with (
            fs.open_input_stream(f"{base}/raw/{name}", compression=None) as source,
            fs.open_output_stream(f"{base}/members/{out}", compression=None) as target,
            fs.open_output_stream(f"{base}/members/{out}.idx", compression=None) as side,
        ):
            inflated = Inflated(source)
            while (head := inflated.until(b"\r\n\r\n")) is not None:
                fields = header(head)
                engine, begin = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
                for part in itertools.chain([head], inflated.parts(int(fields["content-length"]) + 4), [None]):
                    packed = engine.flush() if part is None else engine.compress(part)
                    target.write(packed)
                    at += len(packed)
                entry = {"offset": begin, "length": at - begin, "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
                side.write((json.dumps(entry) + "\n").encode())
                n += 1
        return out, n, at

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        for batch in stream:
            fs.create_dir(f"{base}/members")
            done = [rewrite(fs, base, name, TaskContext.get().taskAttemptId()) for name in batch.column(0).to_pylist()]
            for (_, n, _), want in zip(done, batch.column(1).to_pylist(), strict=True):
                if n != want:
                    raise ValueError(f"{n} records of {want}")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n", "size"])

    return _one_each(archives).mapInArrow(run, "path string, n long, size long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives, read by seeking to the offsets of the sidecar index."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html binary"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(ID)
        return int(text) if text else None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        for batch in stream:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(f"{base}/members/{name}") as file, fs.open_input_stream(f"{base}/members/{name}.idx", compression=None) as side:
                    for line in side.read().decode().splitlines():
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        raw = zlib.decompress(file.read(entry["length"]), 31)
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        fields = header(head)
                        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        full = int(header(http)["content-length"])
                        revisit = fields["warc-type"] == "revisit"
                        known = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != full or digest(payload) != known):
                            raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
                        rows.append((number(fields["warc-record-id"]), full, known, fields["warc-type"], number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), None if revisit else payload))
                        held += len(payload)
                        if held > 4 * BUFFER:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return _one_each(archives).mapInArrow(run, schema)


def _one_each(archives: DataFrame) -> DataFrame:
    """A task for each archive."""
    return archives.repartition(max(1, archives.count()))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written as archives, normalised, and read back."""
    folder = shared_dir(pages.sparkSession)
    raw = stored(write(deduplicated(pages, least), folder), folder)
    return read(stored(normalise(raw, folder), folder), folder)
