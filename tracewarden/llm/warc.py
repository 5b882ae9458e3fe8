"""WARC archives as a chunked record table.

An archive is a table of (record_id, chunk, whole, data) rows. The data of one record, in chunk order, are one
gzip member that holds a whole WARC record, so that the concatenation of records is a ``.warc.gz`` file.
``whole`` marks the only chunk of a record: such records are read where they lie, and only the chunks of longer
ones move, to come together.
Writer and reader go through a payload block by block: digest, length and (de)compressor carry their
state from block to block, chunks leave as they fill, and no record is assembled in memory.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common

CHUNK = 1 << 18
_BLOCK = 1 << 16
_BATCH = 4 << 20
RECORDS_SCHEMA = "record_id long, chunk int, whole boolean, data binary"
_PREFIX = "urn:page:"
#: Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is not what its headers say."""


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def record_head(record_id: int | None, digest: str, payload_bytes: int, refers_to: int | None, uri: str | None) -> bytes:
    """The WARC headers of a page and the HTTP headers that open its block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PREFIX}{'' if record_id is None else record_id}>", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload_bytes if refers_to is None else 0)}"]
    if uri:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_PREFIX}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _blocks(view: memoryview):
    for k in range(0, len(view), _BLOCK):
        yield view[k : k + _BLOCK]


def record_chunks(record_id: int | None, payload: memoryview, refers_to: int | None, uri: str | None, chunk: int = CHUNK):
    """The compressed chunks of one record; the payload is only ever sliced."""
    state = hashlib.sha1()
    for block in _blocks(payload):
        state.update(block)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    held = bytearray(packer.compress(record_head(record_id, base32_sha1(state), len(payload), refers_to, uri)))
    if refers_to is None:
        for block in _blocks(payload):
            held += packer.compress(block)
            while len(held) >= chunk:
                yield bytes(held[:chunk])
                del held[:chunk]
    held += packer.compress(b"\r\n\r\n") + packer.flush()
    for k in range(0, len(held), chunk):
        yield bytes(held[k : k + chunk])


class RecordReader:
    """Reads one record from its chunks: ``feed`` each, then ``result``."""

    def __init__(self):
        self.unpacker = zlib.decompressobj(31)
        self.head, self.fields, self.http = bytearray(), None, None
        self.state, self.size, self.left = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> None:
        while data:
            self._take(self.unpacker.decompress(data, _BLOCK))
            data = self.unpacker.unconsumed_tail

    def _take(self, data: bytes) -> None:
        if self.http is None:
            self.head += data
            if self.fields is None:
                if (end := self.head.find(b"\r\n\r\n")) < 0:
                    return
                if not self.head.startswith(_VERSION):
                    raise WarcError("no WARC record")
                pairs = (x.split(": ", 1) for x in self.head[len(_VERSION) : end].decode().split("\r\n"))
                self.fields = {k.lower(): v for k, v in pairs}
                self.left = int(self.fields["content-length"])
                del self.head[: end + 4]
            if (end := self.head.find(b"\r\n\r\n")) < 0:
                return
            self.http = dict(x.lower().split(b": ", 1) for x in bytes(self.head[:end]).split(b"\r\n")[1:])
            self.left -= end + 4
            data = bytes(self.head[end + 4 :])
            self.head.clear()
        block = data[: self.left]
        self.state.update(block)
        self.size += len(block)
        self.left -= len(block)

    def result(self) -> tuple[int | None, int, str, str, int | None]:
        """(record_id, payload_bytes, payload_digest, record_type, refers_to); WarcError where the payload and the headers disagree."""
        self._take(self.unpacker.flush())
        if self.http is None or self.left or not self.unpacker.eof:
            raise WarcError("a record ends early")
        said = self.fields["warc-payload-digest"].removeprefix("sha1:")

        def number(name: str) -> int | None:
            digits = self.fields.get(name, "").strip("<>").removeprefix(_PREFIX)
            return int(digits) if digits else None

        length = int(self.http[b"content-length"])
        if self.fields["warc-type"] == "response" and (said != base32_sha1(self.state) or length != self.size):
            raise WarcError(f"record {self.fields['warc-record-id']}: the payload is not what the headers say")
        return number("warc-record-id"), length, said, self.fields["warc-type"], number("warc-refers-to")


def with_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): for each page with a payload of at least ``at_least`` bytes that a page with a larger id also has, that largest id.

    Payloads meet as digests, grouped before the shuffle. What is known of a digest goes back to its pages by digest and salt (a hash
    of the page's id, as many as there are shuffle partitions), so that the pages of a payload that a third of all pages share are
    no single join key, whether or not the session splits skewed joins; the pages themselves move once, by id and digest.
    """
    cells = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary")).alias("digest")
    salt = F.expr(f"cast(pmod(xxhash64(page_id), {common.shuffle_width(pages.sparkSession)}) as int)").alias("salt")
    marks = cells.select("page_id", digest, F.octet_length("html").alias("size"), salt).filter(f"size >= {int(at_least)} and page_id is not null")
    salted = marks.groupBy("digest", "size", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k"))
    last = salted.groupBy("digest", "size").agg(F.max("top").alias("refers_to"), F.sum("k").alias("n")).filter("n > 1").drop("n")
    told = salted.select("digest", "size", "salt").join(last, ["digest", "size"])
    revisits = marks.join(told, ["digest", "size", "salt"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return cells.select("*", digest).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_records(pages: DataFrame, path: str, at_least: int = 0, chunk: int = CHUNK) -> None:
    """Write the pages as a chunked record table below ``path`` (any path that Spark can write)."""

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            ids, urls, refers, numbers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k, (page, url, other, number) in enumerate(zip(ids, urls, refers, numbers, strict=True)):
                payload = batch.column(2)[k].as_buffer()
                for n, whole, data in _numbered(record_chunks(page, memoryview(payload) if payload.size else memoryview(b""), other, url, chunk)):
                    rows.append((number, n, whole, data))
                    size += len(data)
                    if size >= _BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    # the number is fixed once it is written; a task that runs again writes its whole file again
    with_revisits(pages, at_least).withColumn("record_id", F.monotonically_increasing_id()).mapInArrow(run, RECORDS_SCHEMA).write.parquet(path)


def _numbered(chunks):
    """(number, whether it is the record's only one, data) of a record's chunks; one waits for the next."""
    waiting, n = next(chunks), 0
    for data in chunks:
        yield n, False, waiting
        waiting, n = data, n + 1
    yield n, n == 0, waiting


def _batch(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "chunk", "whole", "data"])


def read_records(records: DataFrame) -> DataFrame:
    """Read a chunked record table: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Records of one chunk are read without an exchange. The chunks of longer ones are brought together by record and
    sorted, then streamed: a task holds one batch of chunks and the state of one record. Responses are tested
    against their digest and length.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        current, reader, expected = None, None, 0
        for batch in batches:
            out = []
            for record, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if record != current:
                    if reader:
                        out.append(reader.result())
                    current, reader, expected = record, RecordReader(), 0
                if chunk != expected:
                    raise WarcError(f"record {record}: chunk {expected} is missing")
                reader.feed(data.as_py())
                expected += 1
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if reader:
            yield pa.record_batch([pa.array([c], k) for c, k in zip(reader.result(), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    whole = records.filter("whole").select("record_id", "chunk", "data")
    longer = records.filter("not whole").select("record_id", "chunk", "data")
    together = longer.repartition(common.shuffle_width(records.sparkSession), "record_id").sortWithinPartitions("record_id", "chunk")
    return whole.mapInArrow(run, schema).unionByName(together.mapInArrow(run, schema))


def archived(pages: DataFrame, at_least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write pages into a chunked record table in the shared folder and read the archive back.

    One row a page: (page_id, payload_bytes, payload_digest, record_type, refers_to). Of pages with
    equal payloads of at least ``at_least`` bytes, the one with the largest id is a response and the others
    are revisits of it; smaller payloads are responses. A null html is an empty payload; a null url is
    left out of the headers; a page without an id is a response without a number in its name, and nothing
    refers to it. Repeated rows give a record each (two with the largest id are both responses). Further
    columns are ignored; an empty table gives an empty table.
    """
    path = common.shared_folder(pages.sparkSession, "warc")
    write_records(pages, path, at_least, chunk)
    return read_records(pages.sparkSession.read.schema(RECORDS_SCHEMA).parquet(path))
