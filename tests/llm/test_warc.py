"""WARC archives: round trips, and archives of others."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from dustpan.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string"
NESTED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99:0>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"


def expected(rows, least=1000):
    out, top = [], {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            top[data] = max(top.get(data, i), i)
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = top.get(data) if top.get(data) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if first is not None else "response", first))
    return sorted(out, key=repr)


@pytest.fixture(scope="session")
def rows():
    long = "".join(f"<p>{i} é中</p>" for i in range(9_000))
    texts = [None, "", "a", "x" * 999, "x" * 1000, "x" * 1000, "é" * 500, "é" * 500, long, long, long + "!", "y" * 16_384, "y" * 16_385,
             "\r\n\r\n" * 300, "0\r\n\r\n", NESTED, "\r\n\r\n" + NESTED * 40, "\r\n\r\n" + NESTED * 40, "\x00\x01" * 600, "z" * 4096, "w" * 4095]
    return [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, t, "clash") for i, t in enumerate(texts)] + [
        (4, None, "x" * 1000, None), (5, None, "x" * 1000, None), (0, None, None, None), (None, None, "x" * 1000, None),
        (None, None, "q" * 2000, None), (-7, "u", "é" * 500, None)]


def test_odd_pages_come_back(spark, rows):
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_payloads_survive(spark, rows, tmp_path, compression):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path / "with blank" / compression)
    warc.write_archives(warc.warc_records(pages, chunk=100, segment=1000), path, compression, rows_per_file=20)
    got = warc.read_archives(spark, path).where("type = 'response'").select(warc.page_of(F.col("record_id")), "payload").collect()
    want = [(i, (h or "").encode()) for (i, _, h, *_) in rows]
    first = {(r[0], r[2]) for r in expected(rows) if r[3] == "response"}
    assert sorted(((i, bytes(p)) for i, p in got), key=repr) == sorted(
        ((i, p) for i, p in want if (i, hashlib.sha1(p).hexdigest()) in first), key=repr)


def test_archives_are_well_formed(spark, rows, tmp_path):
    """Read as an archive is read: record after record by declared length."""
    warc.write_archives(warc.warc_records(spark.createDataFrame(rows, SCHEMA).coalesce(1), segment=700), str(tmp_path / "a"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert data.startswith(b"WARC/1.1\r\n")
    records = list(warc._of_archive(data, "f"))
    assert all(r[9] for r in records)
    kinds = [r[0] for r in records]
    assert {"response", "revisit", "continuation"} == set(kinds)
    whole = {r["record_id"]: r["block"] for r in warc.reassembled(
        spark.createDataFrame([tuple(r) for r in records], warc._PARSED)).collect()}
    assert len(whole) == len(rows) and all(b is not None and b.startswith(b"HTTP/1.1 200 OK\r\n") for b in whole.values())


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def _foreign(kind, name, block, **fields):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + name.encode() + b">"]
    lines += [k.replace("_", "-").encode() + b": " + str(v).encode() for k, v in fields.items()]
    return b"\r\n".join([*lines, b"content-length: %d" % len(block), b"", block, b"", b""])


def test_foreign_archives(spark, tmp_path):
    """Other versions, gzip members, bare bodies, base-32 digests, scattered and damaged segments."""
    payload = b"\xff\xfe binary \r\n\r\nWARC/1.0\r\n" * 90
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding:\r\n chunked\r\n\r\n5;a=b\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: t\r\n\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http + payload
    segments = [block[at:at + 500] for at in range(0, len(block), 500)]
    parts = [_foreign("response", "seg", segments[0], WARC_Segment_Number=1)]
    parts += [_foreign("continuation", f"seg{k}", s, WARC_Segment_Number=k, WARC_Segment_Origin_ID="<seg>",
                       **({"WARC_Segment_Total_Length": len(block)} if k == len(segments) else {}))
              for k, s in enumerate(segments[1:], 2)]
    lost = [_foreign("response", "lost", b"abc", WARC_Segment_Number=1),
            _foreign("continuation", "lost3", b"def", WARC_Segment_Number=3, WARC_Segment_Origin_ID="<lost>", WARC_Segment_Total_Length=6)]
    short = [_foreign("response", "short", b"abc", WARC_Segment_Number=1),
             _foreign("continuation", "short2", b"def", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<short>", WARC_Segment_Total_Length=7)]
    orphan = [_foreign("continuation", "orphan2", b"def", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<orphan>", WARC_Segment_Total_Length=6)]
    info = _foreign("warcinfo", "info", b"software: x\r\n")
    a = [info, _foreign("response", "plain", block), *parts[1::2], lost[0], short[1], _foreign("revisit", "again", b"", WARC_Payload_Digest=digest)]
    b = [info, _foreign("response", "chunked", chunked), *parts[::2][::-1], lost[1], short[0], *orphan, _foreign("response", "bad", http[:10])]
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(a))
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in b))
    (tmp_path / "w" / "c.warc").write_bytes(b"".join([info, _foreign("response", "cut", b"HTTP/1.1 200 OK\r\n\r\nwhole")])[:-8])
    (tmp_path / "w" / "d.warc").write_bytes(b"")
    got = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {k: r["payload"] and bytes(r["payload"]) for k, r in got.items()} == {
        "<plain>": payload, "<seg>": payload, "<chunked>": b"hello world", "<lost>": None, "<short>": None, "<again>": None, "<bad>": None}
    assert got["<again>"]["digest"] == hashlib.sha1(payload).hexdigest()


@pytest.mark.parametrize("body", [b"5\r\nhel", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b""])
def test_damaged_chunks(body):
    with pytest.raises(ValueError):
        warc.dechunk(body)
