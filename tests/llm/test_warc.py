import base64
import gzip
import hashlib
import zlib

import pytest

from quire.llm import warc
from quire.llm.common import fresh_path
from quire.llm.store import filesystem, open_range
from tests.llm import corpus

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "<p>é😀</p>"), (4, "http://a b\r\nX: y", None), (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "x" * 300_000), (8, "u", "ab\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "u", "y" * warc.CHUNK)]


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, id string, digest string").repartition(3)


def test_round_trip_with_revisits(spark):
    got = warc.archive_round_trip(pages(spark)).collect()
    assert len(got) == len(PAGES)
    tops = {}
    for i, _, h in PAGES:
        if i is not None:
            tops[h or ""] = max(i, tops.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        revisit = i is not None and i < tops[h or ""]
        want.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", tops[h or ""] if revisit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)


def test_chunks_are_bounded_ordered_and_carry_running_digests(spark):
    chunks = warc.read_warc(warc.write_warc(pages(spark), least=10**9), chunk=1000).collect()
    for i, _, h in PAGES:
        if i in (6, 3, 9):
            own = sorted((c for c in chunks if c.page_id == i), key=lambda c: c.chunk)
            assert [c.chunk for c in own] == list(range(len(own))) and all(len(c.data) <= 1000 for c in own)
            whole = b""
            for c in own:
                whole += bytes(c.data)
                assert c.payload_digest == base64.b32encode(hashlib.sha1(whole).digest()).decode() and c.payload_bytes == len(whole)
            assert whole == h.encode() and [c.last for c in own] == [False] * (len(own) - 1) + [True]
    assert all(c.record_type == "response" for c in chunks)


def test_archives_are_gzipped_warc_members(spark):
    folder = fresh_path(spark, "test-warc")
    manifest = warc.write_warc(pages(spark), folder).collect()
    n = 0
    for m in manifest:
        fs, path = filesystem(m.uri)
        raw = fs.open_input_file(path).read()
        text = gzip.decompress(raw[m.offset : m.offset + m.bytes])
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
        n += m.records
        assert b"\nX: y\r\n" not in text
    assert n == len(PAGES)


def test_a_damaged_payload_is_found(spark):
    m = warc.write_warc(pages(spark, [(1, "u", "payload of the page")])).collect()[0]
    fs, path = filesystem(m.uri)
    text = gzip.decompress(fs.open_input_file(path).read()).replace(b"payload of the page", b"payload of the Page")
    bad = zlib.compressobj(3, zlib.DEFLATED, 31)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(bad.compress(text) + bad.flush())
    size = fs.get_file_info(path).size
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark.createDataFrame([(m.uri, 0, size, 1)], "uri string, offset bigint, bytes bigint, records bigint")).collect()
    assert open_range(m.uri, 0).read(2) == b"\x1f\x8b"


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [PAGES[0]]).limit(0)).count() == 0
    assert corpus.empty(spark).count() == 0
