import hashlib
import io

import pytest

from tribune.llm import warc


def made(n=30):
    out = io.BytesIO()
    records = [warc.record(k, f"http://h/{k}", (b"<html>common head and foot %d" % k) * (k + 1), hashlib.sha256((b"<html>common head and foot %d" % k) * (k + 1)).hexdigest(), None) for k in range(n)]
    writer = warc.Writer(out, records)
    for r in records:
        writer.write(r)
    return out.getvalue(), records


def test_dictionary_and_one_frame_per_record():
    data, records = made()
    assert data[:4] == warc.DICT_MAGIC
    for chunk in (1, 7, 1 << 18):
        assert list(warc.frames(io.BytesIO(data), chunk)) == records
    assert list(warc.frames(io.BytesIO(b""))) == []
    plain = io.BytesIO()
    w = warc.Writer(plain, [])
    w.write(records[0])
    assert list(warc.frames(io.BytesIO(plain.getvalue()))) == records[:1]


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d[:6], lambda d: d[:40] + b"x" + d[41:], lambda d: d + b"tail"])
def test_broken_archives(spoil):
    with pytest.raises((warc.BadRecord, Exception)):
        for r in warc.frames(io.BytesIO(spoil(made()[0]))):
            warc.parse(r)


@pytest.mark.parametrize(("old", "new"), [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"Other"), (b"common", b"COMMON"), (b"sha256:", b"sha256:0"), (b"Content-Length: 2", b"Content-Length: 3")])
def test_broken_records(old, new):
    good = made()[1][5]
    warc.parse(good)
    with pytest.raises(warc.BadRecord):
        warc.parse(good.replace(old, new))


def test_pages(spark):
    long = "ä" * 60
    rows = [(5, "u", long), (2, "u", long), (9, None, long), (1, "v", "short"), (3, "v", "short"), (4, "w", None), (7, "x", ""), (8, "y", "z" * 3_000_000), (None, "n", long), (2, "u", long)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    archives, folder = warc.archive(pages)
    got = warc.read(archives, folder).collect()
    expect = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = 2 if h == long and i != 2 else None
        expect.append((i, u, "revisit" if first else "response", len(b), hashlib.sha256(b).hexdigest(), first, b"" if first else b))
    key = lambda r: str(r[:3])
    assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload)) for r in got), key=key) == sorted(expect, key=key)
    assert all(r.error is None for r in got)
    archives, folder = warc.archive(pages.limit(0))
    assert warc.read(archives, folder).count() == 0


def other(kind, ident, block, *more, content="application/http;msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:<{ident}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *more, f"Content-Length:{len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import base64

    import zstandard

    body = b"<p>hello</p>"
    block = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n" + body  # no length told
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [
        other("warcinfo", "urn:uuid:1", b"software: x\r\n", content="application/warc-fields"),
        other("response", "urn:uuid:2", block, f"WARC-Block-Digest: sha1:{b32(block)}", f"WARC-Payload-Digest: sha1:{b32(body)}", "WARC-Target-URI: http://a/"),
        other("response", "urn:uuid:3", block, "WARC-Block-Digest: crc9:zz"),
        other("response", "urn:uuid:4", block, f"WARC-Payload-Digest: sha1:{b32(b'x')}"),
        other("revisit", "urn:uuid:5", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
        b"nonsense",
        other("resource", "urn:uuid:6", b"plain", content="text/plain"),
    ]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(zstandard.compress(r) for r in records) + b"tail")
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.zst"),)], "path string")
    got = warc.read(archives, str(tmp_path)).collect()
    assert [(r.record_type, r.record_id) for r in got if not r.error] == [("warcinfo", "urn:uuid:1"), ("response", "urn:uuid:2"), ("response", "urn:uuid:3"), ("revisit", "urn:uuid:5"), ("resource", "urn:uuid:6")]
    assert [r.error.split(":")[0] for r in got if r.error] == ["payload digest differs", "no WARC version line or no end of headers", "not a frame"]
    assert [bytes(r.payload) for r in got if r.record_type in ("response", "resource")] == [body, body, b"plain"]
    assert [warc.uri(x) for x in ("s3a://b/x", "s3n://b/x", "s3://b/x", "/s3a://", "hdfs://n/x")] == ["s3://b/x", "s3://b/x", "s3://b/x", "/s3a://", "hdfs://n/x"]


def test_damaged_dictionaries_are_rows(spark, tmp_path):
    """An archive that is broken in any part gives a row that says so, and the others are read."""
    import random
    import struct

    data, records = made()
    (size,) = struct.unpack("<I", data[4:8])
    rng = random.Random(6)
    broken = [data[:k] for k in (1, 3, 4, 7, 8, 9, 8 + size - 1)] + [data[:8] + bytes(rng.randrange(256) for _ in range(size)) + data[8 + size :]]
    broken += [data[:8] + data[8:12] + bytes(size - 4) + data[8 + size :], data[:4] + struct.pack("<I", 2**32 - 1) + data[8:], data[:12] + bytes(b ^ 0x55 for b in data[12 : 8 + size]) + data[8 + size :]]
    for k, own in enumerate(broken):
        (tmp_path / f"{k}.warc.zst").write_bytes(own)
    (tmp_path / "good.warc.zst").write_bytes(data)
    archives = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.iterdir())], "path string")
    got = warc.read(archives, str(tmp_path)).collect()
    assert {r.page_id for r in got if not r.error} == set(range(len(records)))
    assert sum(bool(r.error) for r in got) >= len(broken)


def test_skippable_frames_between_records():
    import struct

    data, records = made(5)
    (size,) = struct.unpack("<I", data[4:8])
    at = 8 + size
    for magic in (0x184D2A50, 0x184D2A5D, 0x184D2A5F):
        frame = struct.pack("<II", magic, 700) + b"q" * 700
        for chunk in (3, 1 << 18):
            assert list(warc.frames(io.BytesIO(data[:at] + frame + data[at:] + frame), chunk)) == records
    plain = io.BytesIO()
    w = warc.Writer(plain, [])
    w.write(records[0])
    assert list(warc.frames(io.BytesIO(struct.pack("<II", 0x184D2A50, 3) + b"abc" + plain.getvalue()))) == records[:1]
    with pytest.raises(warc.BadRecord):
        list(warc.frames(io.BytesIO(data + frame[:100])))
