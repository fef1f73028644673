"""WARC archives compressed with Zstandard: a writer and a reader.

An archive is a .warc.zst file: a leading skippable frame that holds the dictionary, then one frame for each record. Pages are
written by the tasks that hold them, each task to archives of its own in the folder given (shared by all executors;
any filesystem that pyarrow knows). An archive gets its final name when it is complete, and only archives that finished tasks report
are read: one left by a lost executor is not among them. The dictionary of an archive is trained on a bounded
number of its first records.

Pages with equal payloads of at least 100 bytes are one `response`, that of the smallest page_id, and `revisit` records of it
for the rest, which name its page and keep the digest and the length of the payload but not the payload.

The reader loads the dictionary from the leading skippable frame (an archive may do without), decodes one frame per record, and validates the record: version line,
the mandatory headers, block length against Content-Length, an HTTP length if one is told, and digests of block and payload by the algorithms that it knows (MD5, SHA-1,
SHA-256 and SHA-512, in hexadecimal or base 32). It takes any record type and record id. It yields
a row per record and never holds more than one record's bytes and a batch of rows. A record that breaks the format is a row with `error`; a frame that does
ends its archive with such a row.

Defined cases: null html is an empty payload; null urls are written without a target; a null page_id is written as such and never serves
as the response of others; rows that repeat a page_id get a record each (equal payloads: one of them response, by order of page_id only, so all rows with the smallest
page_id are responses); a payload of any length is one record, which its task holds whole; empty tables give no archives and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, scratch

#: Magic number of the skippable frame that holds a dictionary, of Zstandard frames and of a bare dictionary: fixed values.
DICT_MAGIC, FRAME_MAGIC, RAW_DICT_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: The first of the sixteen magic numbers of skippable frames, a fixed value of the format.
SKIPPABLE = 0x184D2A50
#: A dictionary and the bytes of records that it is trained on, at most.
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 16_384, 2_000_000, 200
#: Uncompressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64_000_000
LEVEL = 3
#: Archives are read by a task each, up to so many tasks.
MOST_TASKS = 20_000
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One date for all records, so that archives are the same on every run.
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """An archive or a record that breaks the format."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Digests that are checked, by the name in front of the colon.
DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512}


def _headers(lines: list[str]) -> dict[str, str]:
    """Names (lower case) and values; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"not a header: {line[:80]}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _check(told: str | None, data: bytes, what: str) -> None:
    """Compare a digest that a header tells with that of data; algorithms that are not known are not checked."""
    algorithm, _, value = (told or "").partition(":")
    make = DIGESTS.get(algorithm.strip().lower())
    if not make:
        return
    own, value = make(data), value.strip()
    same = value.lower() == own.hexdigest()
    if not same:
        try:
            same = base64.b32decode(value.upper() + "=" * (-len(value) % 8)) == own.digest()
        except (binascii.Error, ValueError):
            same = False
    if not same:
        raise BadRecord(f"{what} digest differs")


def parse(data: bytes) -> dict:
    """Headers and payload of a record, validated; payload_digest is SHA-256: that of the payload, or, where a revisit leaves it out, the one told."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/(0\.1[78]|1\.[01])", lines[0]):
        raise BadRecord("no WARC version line or no end of headers")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadRecord(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:-4]
    _check(headers.get("warc-block-digest"), block, "block")
    kind, payload, told = headers["warc-type"].lower(), block, None
    if block.startswith(b"HTTP/") and headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap and kind != "revisit":
            raise BadRecord("no end of the HTTP headers in the block")
        fields = _headers([x for x in http.decode("latin-1").split("\r\n")[1:] if ":" in x])
        told = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
    elif kind == "response" and headers.get("content-type", "").startswith("application/http"):
        raise BadRecord("no HTTP headers in the block")
    if kind == "revisit":
        if payload and told is not None and len(payload) != told:
            raise BadRecord(f"payload of {len(payload)} bytes, told {told}")
        algorithm, _, value = headers.get("warc-payload-digest", "").partition(":")
        digest = value.strip().lower() if algorithm.strip().lower() in ("sha256", "sha-256") else None
        return {"headers": headers, "payload": payload, "payload_bytes": told, "payload_digest": digest}
    if told is not None and len(payload) != told:
        raise BadRecord(f"payload of {len(payload)} bytes, told {told}")
    _check(headers.get("warc-payload-digest"), payload, "payload")
    return {"headers": headers, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; an empty one where they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Writes records to a stream, the dictionary in front."""

    def __init__(self, out: BinaryIO, samples: list[bytes]):
        self.out, self.n, self.written = out, 0, 0
        dictionary = train(samples) if len(samples) >= 8 else b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            out.write(DICT_MAGIC + struct.pack("<I", len(packed)) + packed)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL)

    def write(self, data: bytes) -> None:
        self.out.write(self.zstd.compress(data))
        self.n += 1
        self.written += len(data)


class _Input:
    """A stream of which some bytes are read ahead."""

    def __init__(self, stream: BinaryIO, chunk: int):
        self.stream, self.chunk, self.held = stream, chunk, b""

    def ahead(self, n: int) -> bytes:
        """The next n bytes, fewer at the end; they stay."""
        while len(self.held) < n and (more := self.stream.read(max(self.chunk, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.ahead(n)
        self.held = self.held[n:]
        return out

    def skip(self, n: int) -> int:
        done = min(n, len(self.held))
        self.held = self.held[done:]
        while done < n and (more := self.stream.read(min(self.chunk, n - done))):
            done += len(more)
        return done


def _dictionary(raw: bytes) -> zstandard.ZstdDecompressor:
    try:
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        elif raw[:4] != RAW_DICT_MAGIC:
            raise BadRecord("the leading skippable frame holds no dictionary")
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        one.decompressobj()  # what is wrong with a dictionary shows when it is used
        return one
    except zstandard.ZstdError as e:
        raise BadRecord(f"the dictionary is damaged: {e}") from e


def frames(stream: BinaryIO, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, a frame at a time. Skippable frames after the leading one are skipped, as the format has it."""
    given = _Input(stream, chunk)
    zstd, first = zstandard.ZstdDecompressor(), True
    while head := given.ahead(8):
        if len(head) < 4:
            raise BadRecord("a frame is cut short")
        if SKIPPABLE <= struct.unpack("<I", head[:4])[0] < SKIPPABLE + 16:
            if len(head) < 8:
                raise BadRecord("a skippable frame is cut short")
            given.take(8)
            (size,) = struct.unpack("<I", head[4:])
            if first and head[:4] == DICT_MAGIC:
                if len(raw := given.take(size)) != size:
                    raise BadRecord("the dictionary's frame is cut short")
                zstd = _dictionary(raw)
            elif given.skip(size) != size:
                raise BadRecord("a skippable frame is cut short")
            first = False
            continue
        first = False
        one, parts = zstd.decompressobj(), []
        while True:
            held = given.held or given.stream.read(chunk)
            given.held = b""
            if not held:
                raise BadRecord("a record's frame is cut short")
            try:
                parts.append(one.decompress(held))
            except zstandard.ZstdError as e:
                raise BadRecord(f"not a frame: {e}") from e
            if one.eof:
                given.held = one.unused_data
                break
        yield b"".join(parts)


def uri(folder: str) -> str:
    """The name of a folder for pyarrow, which calls S3 by one name where Hadoop has three."""
    return re.sub("^s3[an]://", "s3://", folder)


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    folder = uri(folder)
    fs, path = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
    return fs, path


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html, digest, refers_to) in folder; a row per archive: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(*(b.column(k) for k in range(5)), strict=True))
        done: list[tuple[str, int, int]] = []
        ahead: list[bytes] = []

        def records() -> Iterator[bytes]:
            for page_id, url, html, digest, refers_to in rows:
                yield record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), digest.as_py(), refers_to.as_py())

        todo = records()
        while True:
            size = 0
            for data in todo:  # the first records train the dictionary
                ahead.append(data)
                size += len(data)
                if len(ahead) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                    break
            if not ahead:
                break
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{name}.part", compression=None) as out:
                writer = Writer(out, ahead)
                for data in ahead:
                    writer.write(data)
                ahead.clear()
                if writer.written < ARCHIVE_BYTES:
                    for data in todo:
                        writer.write(data)
                        if writer.written >= ARCHIVE_BYTES:
                            break
            fs.move(f"{name}.part", name)
            done.append((name, writer.n, writer.written))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def _page(name: str | None) -> int | None:
    """The page of a record id that this writer gave; other ids have none."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", name or "")
    return int(found[1]) if found else None


def _row(data: bytes) -> tuple:
    try:
        r = parse(data)
    except BadRecord as e:
        return (None, None, None, None, None, None, None, str(e), None)
    h = r["headers"]
    return (_page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"].lower(), r["payload_bytes"], r["payload_digest"], _page(h.get("warc-refers-to")), h["warc-record-id"].strip("<>"), None, r["payload"])


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives (path) in a folder: page_id, url, record_type, payload_bytes, payload_digest (SHA-256), refers_to, record_id,
    error (of a record that breaks the format, else null) and, if asked for, payload."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "error", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(stream: BinaryIO) -> Iterator[tuple[tuple, int]]:
        try:
            for data in frames(stream):
                yield _row(data), len(data)
        except BadRecord as e:
            yield (None, None, None, None, None, None, None, str(e), None), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], types[k]) for k in range(len(names))], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    for row, long in rows(stream):
                        held.append(row if payloads else row[:-1])
                        size += long if payloads else 200
                        if size >= 8_000_000:
                            yield out()
                            held.clear()
                            size = 0
        if held:
            yield out()

    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, error string"
    # a given number of partitions, which adaptive execution does not merge: a path is few bytes, an archive many
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.select("path").repartition(tasks).mapInArrow(run, kinds + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html); the table of archives and their folder."""
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("digest"), (F.octet_length(html) >= LEAST_REVISIT).alias("long"))
    firsts = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    firsts = cut(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    linked = rows.join(firsts, "digest", "left")
    marked = linked.withColumn("refers_to", F.when(F.col("long") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return cut(write(marked, folder), "archives"), folder


#: Up to so many digests of repeated payloads (100 bytes each) are broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 200_000
