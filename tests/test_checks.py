import hashlib

import pytest
from pyspark.sql import functions as F

from tidegate.results import GateError
from tidegate.sources.checks import checksums, file_checksum, file_heads, first_bad_bytes
from tidegate.sources.readers import file_inventory, raw_lines, storage_footprint

BYTES = bytes((i * 31) & 0xFF for i in range(256 * 1024 + 7))


def test_checksum(spark, write):
    path = write("data.bin", BYTES)
    want = hashlib.sha256(BYTES).hexdigest()
    result = file_checksum(spark, path)
    assert result.metrics == {"bytes": str(len(BYTES)), "sha256": want}
    assert result.message == f"SHA-256 {want} for {len(BYTES)} bytes in {path}"
    assert file_checksum(spark, path, f" {want.upper()} ").ok
    other = file_checksum(spark, path, "0" * 64)
    assert other.message == f"Expected SHA-256 {'0' * 64} but found {want}"
    assert file_checksum(spark, write("empty.bin", b"")).metrics["sha256"].startswith("e3b0c442")
    for bad in ("", "g" * 64, "0" * 63):
        with pytest.raises(GateError, match="^expectedSha256 must be 64 hexadecimal characters$"):
            file_checksum(spark, path, bad)


def test_large_files_are_hashed_in_pieces(spark, write, tmp_path):
    write("many/a b.bin", BYTES)
    write("many/deep/small.bin", b"x")
    rows = {row["path"].rsplit("/", 1)[1]: (row["bytes"], row["sha256"]) for row in checksums(spark, str(tmp_path / "many")).collect()}
    assert rows == {"a b.bin": (len(BYTES), hashlib.sha256(BYTES).hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_many_files_are_spread(spark, write, tmp_path):
    for i in range(60):
        write(f"spread/{i}.txt", b"\xef\xbb\xbfx" if i % 2 else b"xyz")
    heads = file_heads(spark, str(tmp_path / "spread"))
    assert sum(bytes(row["head"]) == b"\xef\xbb\xbf" for row in heads.collect()) == 30
    for df in (heads, checksums(spark, str(tmp_path / "spread"))):
        tasks = df.select(F.spark_partition_id().alias("task")).groupBy("task").count()
        assert tasks.count() > 5


def test_inventory(spark, write, tmp_path):
    write("inv/b.txt", "12345")
    write("inv/a/c.txt", "1")
    folder = str(tmp_path / "inv")
    rows = [(row["path"].rsplit("/", 1)[1], row["length"]) for row in file_inventory(spark, folder).collect()]
    assert rows == [("c.txt", 1), ("b.txt", 5)]
    assert [row["length"] for row in file_inventory(spark, folder, recursive=False).collect()] == [5]
    assert storage_footprint(file_inventory(spark, folder)).first().asDict() == {"files": 2, "bytes": 6}


def test_first_bad_byte_over_pieces(spark, write, monkeypatch):
    good = ("é" * 1000).encode()
    path = write("u.txt", good + b"ab\xc3")
    assert [row["offset"] for row in first_bad_bytes(spark, path).collect()] == [len(good) + 2]
    assert first_bad_bytes(spark, write("ok.txt", good)).count() == 0


def test_raw_lines(spark, write):
    rows = raw_lines(spark, write("r.txt", b"a\xff\r\nb\rc")).collect()
    assert [bytes(row["bytes"]) for row in rows] == [b"a\xff", b"b", b"c"]
    assert rows[0]["file"].endswith("r.txt")
