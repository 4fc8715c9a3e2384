import base64
import hashlib
import re

import pytest

from tidegate.llm.archive import read_archive, warc_bytes, write_archive


def test_archive_and_bytes(spark, tmp_path):
    rows = [(5, "http://a/", "<p>é</p>", 1), (3, None, "<p>é</p>", 1), (9, "http://b/\r\nX: y", None, 1), (7, "c", "", 1), (None, "d", "x", 1), (8, "e", "x" * 70000, 1)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, sha256 INT")
    target = str(tmp_path / "a")
    write_archive(pages, target)
    got = {r.page_id: tuple(r)[1:] for r in read_archive(spark, target).collect()}
    first = {}
    for key, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", key)
    for key, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = first[html or ""]
        assert got[key] == (len(data), digest, "response" if other == key else "revisit", None if other == key else other)
    records = [bytes(r.record) for r in warc_bytes(spark, target).collect()]
    assert len(records) == len(rows)
    for record in records:
        head, block = record.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(block) == size + 4 and block.endswith(b"\r\n\r\n") and b"\nX: y" not in head
    assert spark.read.parquet(f"{target}/payloads").count() == 4


def test_repeated_rows_have_one_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "b"), (None, "u", "b")], "page_id LONG, url STRING, html STRING")
    write_archive(pages, str(tmp_path / "r"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in read_archive(spark, str(tmp_path / "r")).collect())
    assert got[2:] == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert sorted(r[1] for r in got[:2]) == ["response", "revisit"]


def test_small_payloads_are_responses_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "abc"), (4, "u", "abc")], "page_id LONG, url STRING, html STRING")
    write_archive(pages, str(tmp_path / "s"), at_least=2)
    assert {r.page_id: r.refers_to for r in read_archive(spark, str(tmp_path / "s")).collect()} == {1: None, 2: None, 3: None, 4: 3}
    write_archive(pages.limit(0), str(tmp_path / "e"))
    assert read_archive(spark, str(tmp_path / "e")).count() == 0


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    target = str(tmp_path / "d")
    write_archive(spark.createDataFrame([(1, "u", "a")], "page_id LONG, url STRING, html STRING"), target)
    spark.read.parquet(f"{target}/payloads").selectExpr("sha256", "CAST('b' AS BINARY) AS payload").write.parquet(f"{target}2/payloads")
    spark.read.parquet(f"{target}/records").write.parquet(f"{target}2/records")
    with pytest.raises(Exception, match="damaged"):
        read_archive(spark, f"{target}2").collect()
