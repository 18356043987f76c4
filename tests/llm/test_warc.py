import base64
import gzip
import hashlib
from collections import Counter

import pytest

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.warc import archive_and_read_back, look_up, parse_record, record, surt, write_archive
from tests.llm.helpers import FOLDER, needs_tables, table


def brute(pages):
    last = {}
    for i, html in pages:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, html in pages:
        data = (html or "").encode()
        target = last.get(html or "")
        first = i == target
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first or target is None else "revisit", None if first else target))
    return Counter(out)


def rows(frame):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect())


@needs_tables
def test_whole_table(spark):
    assert rows(JOBS["op8_warc"](spark, FOLDER)) == brute(table("pages", "page_id, html"))


PAGES = [
    (1, "http://www.B.example/x?q=1#f", "<p>same</p>"),
    (2, "https://b.example:443/x?q=1", "<p>same</p>"),
    (3, "https://a.b.example/ü \"quoted\"", None),
    (4, None, ""),
    (5, "", "é\U0001f600" * 50_000),
    (5, "", "é\U0001f600" * 50_000),
    (None, "http://c.example/", "no id"),
    (None, "http://[bad", "<p>same</p>"),
    (7, "ftp://user@b.example:21/x", "one\r\n\r\nWARC/1.1\r\n\r\n"),
]


def test_awkward_rows_and_lookups(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS shard", "'x' AS payload")
    assert rows(archive_and_read_back(pages)) == brute([(i, h) for i, _, h in PAGES])
    assert archive_and_read_back(pages.limit(0)).count() == 0
    archive = write_archive(pages.repartition(3), str(tmp_path / "a"), block_lines=2, shard_lines=2)
    wanted = spark.createDataFrame([("https://b.example/x?q=1",), ("http://www2.b.example/x?q=1",), ("http://none.example/",)], "url string")
    found = look_up(archive, wanted, payload=True).collect()
    assert sorted(r.page_id for r in found) == [1, 2]
    assert {r.record_type: bytes(r.payload or b"") for r in found} == {"revisit": b"", "response": b"<p>same</p>"}


def test_many_captures_of_one_url(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://hot.example/" if i % 3 else f"http://h{i}.example/", f"t{i % 50}") for i in range(400)], "page_id long, url string, html string")
    archive = write_archive(pages.repartition(5), str(tmp_path / "b"), block_lines=7, shard_lines=60)
    assert archive.directory.count() > 3
    got = look_up(archive, pages)
    assert rows(got) == brute([(r.page_id, r.html) for r in pages.collect()])
    files = list((tmp_path / "b").glob("*.warc.gz"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 400


def test_damaged_records_are_noticed():
    good = record(3, "http://x/", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, 3)
    assert parse_record(good)["payload"] == b"abc"
    bad = gzip.compress(gzip.decompress(good).replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        parse_record(bad)


def test_sort_keys():
    assert surt("HTTP://www.Example.com:80/A?b#c") == "com,example)/A?b"
    assert surt("https://sub.example.com:8080") == "com,example,sub:8080)/"
