"""WARC archives of pages: written, normalised to one gzip member a record with an offset index, read back.

* `write_archives` streams pages into archives as crawlers often leave them: one gzip stream over a
  whole file, which nothing but a reader from its first byte can use.
* `normalise_archives` is the monolithic gzip normaliser: it inflates such a file once, in pieces, rewrites every
  record as a gzip member of its own, and writes a sidecar index, a line a record: offset, length, type, record id.
* `read_archives` seeks to members by the index and checks every payload's digest; a large archive
  is read by many tasks, in ranges of members. `read_record` fetches one record.

Pages with equal payloads are stored once: the one with the largest `page_id` is a response, the others are
revisits that refer to it. Payloads are compared by SHA-1. Only digests that occur more than once are
looked up: broadcast up to `MAX_BROADCAST` of them, else joined, where a digest of very many pages
is split by Spark's skew join (rows of it need only the one looked-up row).

Files are named after the task attempt that writes them, and later steps read only those the finished attempts name,
so a task that runs again or twice harms nothing. A new file begins after `FILE_BYTES` of records; a page
is held in memory one at a time, compressed records and index lines go out as they come.

Defined results: pages without a `page_id` take no part; null html is an empty payload, null urls get a `urn:`;
every row gets its own record, so of a repeated row all copies are responses or all are revisits;
other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.blocks import shuffle_partitions
from tidewatch.llm.token_files import Folder
from tidewatch.session import checkpointed, small_enough

FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
PIECE = 1 << 20
MAX_BROADCAST = 100_000
GZIP = 31  # zlib's window bits for the gzip format
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGES = "file string, first long, last long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int, url: bytes | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The bytes of one record: a response with the payload, or a revisit of another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = payload if refers_to is None else b""
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
        "",
        "",
    ]
    yield "\r\n".join(lines).encode() + http
    yield body
    yield b"\r\n\r\n"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def with_holders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hexadecimal) and, for revisits, refers_to."""
    known = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("binary").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    known = known.withColumn("digest", F.sha1("payload"))
    counted = known.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
    holders = counted.agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    holders = checkpointed(holders)
    if small_enough(holders, MAX_BROADCAST):
        holders = F.broadcast(holders)
    return known.join(holders, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("holder") != F.col("page_id"), F.col("holder")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes records of `with_holders` rows below `folder`, each file one gzip stream; the names (file)."""
    Folder(folder).create()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, context = Folder(folder), TaskContext.get()
        rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(5)]))
        ended = False

        def stream() -> Iterator[bytes]:
            """The next file: records until it is full or no row is left."""
            nonlocal ended
            packer, size = zlib.compressobj(1, zlib.DEFLATED, GZIP), 0
            for page_id, url, payload, digest, refers_to in rows:
                for part in record(page_id, url, payload, base32_sha1(digest), refers_to):
                    size += len(part)
                    yield packer.compress(part)
                if size >= FILE_BYTES:
                    break
            else:
                ended = True
            yield packer.flush()

        number = 0
        while not ended:
            name = f"crawl-{context.partitionId():05d}-{number:04d}-{context.taskAttemptId()}.warc.gz"
            place.write(name, stream(), context.taskAttemptId())
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return checkpointed(pages.mapInArrow(write, "file string"))


class Inflated:
    """The bytes of a gzip file, one member or many, inflated as they are read."""

    def __init__(self, source):
        self.source, self.open_, self.held, self.at = source, zlib.decompressobj(GZIP), b"", 0

    def _more(self) -> bool:
        """Whether more bytes are held now; drops those that were read."""
        while True:
            if self.open_.eof:
                rest = self.open_.unused_data or self.source.read(PIECE)
                if not rest:
                    return False
                self.open_ = zlib.decompressobj(GZIP)
            else:
                rest = self.open_.unconsumed_tail or self.source.read(PIECE)
                if not rest:
                    raise EOFError("the archive ends within a gzip member")
            got = self.open_.decompress(rest, PIECE)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with `mark`; None if there is nothing left."""
        while (end := self.held.find(mark, self.at)) < 0:
            if not self._more():
                if self.at < len(self.held):
                    raise EOFError("the archive ends within a record's head")
                return None
        out, self.at = self.held[self.at : end + len(mark)], end + len(mark)
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next `n` bytes, in pieces."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("the archive ends within a record")
            out = self.held[self.at : self.at + n]
            self.at, n = self.at + len(out), n - len(out)
            yield out


def head_fields(head: bytes) -> dict[str, str]:
    """Fields of a record's or a response's head by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def members(source) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Each record of an open archive: its fields, and its bytes as pieces of one gzip member."""
    text = Inflated(source)
    while (head := text.until(b"\r\n\r\n")) is not None:
        fields = head_fields(head)

        def member() -> Iterator[bytes]:
            packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            yield packer.compress(head)
            for piece in text.pieces(int(fields["content-length"]) + 4):
                yield packer.compress(piece)
            yield packer.flush()

        yield fields, member()


def normalise_archives(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites the archives named in `files` below `target`, with indexes; ranges of their members (file, first, last)."""
    Folder(target).create()

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came, place, attempt = Folder(source), Folder(target), TaskContext.get().taskAttemptId()
        for name in (n for batch in batches for n in batch.column("file").to_pylist()):
            made = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz"
            lines, ranges = [], []

            def rewritten() -> Iterator[bytes]:
                offset = 0
                with came.open(name) as archive:
                    for fields, parts in members(archive):
                        begun = offset
                        for part in parts:
                            offset += len(part)
                            yield part
                        lines.append(f"{begun} {offset - begun} {fields['warc-type']} {fields['warc-record-id']}\n")
                        if not ranges or begun - ranges[-1][2] >= RANGE_BYTES:
                            ranges.append([len(lines) - 1, 0, begun])
                        ranges[-1][1] = len(lines)

            place.write(made, rewritten(), attempt)
            place.write(f"{made}.idx", (line.encode() for line in lines), attempt)
            if ranges:
                first, last, _ = zip(*ranges)
                yield pa.RecordBatch.from_pydict(
                    {"file": [made] * len(ranges), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())}
                )

    return checkpointed(files.repartition(shuffle_partitions(files), "file").mapInArrow(normalise, RANGES))


def index_of(place: Folder, name: str) -> list[list[str]]:
    """The sidecar of an archive: [offset, length, type, record id] of each record."""
    with place.open(f"{name}.idx") as source:
        return [line.split(" ", 3) for line in source.read().decode().splitlines()]


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record, fields of its response, payload."""
    opened = zlib.decompressobj(GZIP)
    text = opened.decompress(member)
    if not opened.eof or opened.unused_data:
        raise ValueError("the index does not frame a gzip member")
    head, _, block = text.partition(b"\r\n\r\n")
    fields = head_fields(head)
    if block[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']} is not as long as it says")
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    return fields, head_fields(http), payload


def read_record(folder: str, name: str, wanted: str) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record of an archive, by its id."""
    place = Folder(folder)
    for offset, length, _, found in index_of(place, name):
        if found == wanted:
            with place.open(name) as archive:
                archive.seek(int(offset))
                fields, _, payload = parse(archive.read(int(length)))
            return fields, payload
    raise KeyError(wanted)


def _page(fields: dict[str, str], http: dict[str, str], payload: bytes, with_payloads: bool) -> tuple:
    number = lambda urn: int(urn.removeprefix("<urn:page:").removesuffix(">"))
    digest, refers_to = fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to")
    size = int(http["content-length"])
    if refers_to is None:
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{fields['warc-record-id']} does not hold the payload it names")
        refers = None
    else:
        refers = number(refers_to)
    held = payload if with_payloads and refers is None else None
    return number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], refers, held


def read_archives(ranges: DataFrame, folder: str, with_payloads: bool = False) -> DataFrame:
    """Per record of normalised archives: page_id, url, payload_bytes, payload_digest (base32 of SHA-1),
    record_type, refers_to (the page whose response a revisit refers to) and, if wanted, responses' payloads."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Folder(folder)
        for batch in batches:
            for name, first, last in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                out = []
                with place.open(name) as archive:
                    entries = index_of(place, name)[first:last]
                    archive.seek(int(entries[0][0]))
                    for _, length, _, _ in entries:
                        out.append(_page(*parse(archive.read(int(length))), with_payloads))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ranges.repartition(shuffle_partitions(ranges), "file", "first").mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of `pages` below `folder`, normalised: the ranges of their members, for `read_archives`.

    The files as first written are deleted once all are normalised.
    """
    drafts = f"{folder}/monolithic"
    files = write_archives(with_holders(pages, min_bytes), drafts)
    ranges = normalise_archives(files, drafts, f"{folder}/members")
    _delete(pages.sparkSession, drafts)
    return ranges


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: The rows of `archive` and `read_archives`; base32 goes by groups of ten hexadecimal digits, eight letters each.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS holder FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(digest, 10 * (k // 8)::INT + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM h
"""
