import gzip
import os

import pytest

from tidegate.results import GateError
from tidegate.sources.checks import require_decodable
from tidegate.sources.publish import convert_and_verify, csv_to_parquet, log_result, publish, read_results, row_count
from tidegate.sources.readers import read_csv_strict, read_dataset, require_data_files

AMOUNTS = "id INT, amount DECIMAL(10,2)"


@pytest.fixture
def output(tmp_path):
    return str(tmp_path / "out")


def keep(spark, output):
    """An older good output that must survive."""
    spark.range(1).selectExpr("'sentinel' AS id").write.parquet(output)


def kept(spark, output):
    return [row[0] for row in spark.read.parquet(output).collect()] == ["sentinel"]


def test_precision(spark, write, output):
    path = write("p.csv", 'id;amount;note\n001;9007199254740993.1234;"first\nsecond"\n002;0.0001;ok\n')
    schema = "id STRING, amount DECIMAL(22,4), note STRING"
    result = csv_to_parquet(spark, path, output, schema=schema, delimiter=";")
    assert result.message == f"Wrote 2 rows to {output}"
    assert result.metrics == {"rows": "2", "input": path, "output": output, "skipped": "false"}
    rows = {row["id"]: (str(row["amount"]), row["note"]) for row in spark.read.parquet(output).collect()}
    assert rows == {"001": ("9007199254740993.1234", "first\nsecond"), "002": ("0.0001", "ok")}
    short = row_count(spark, output, expected_rows=3)
    assert (short.status, short.message) == ("FAILED", "Expected 3 rows but found 2")
    assert row_count(spark, path, "csv", 2, delimiter=";").ok


def test_malformed_input_keeps_the_old_output(spark, write, output, tmp_path):
    keep(spark, output)
    path = write("m.csv", "id,amount\n1,not-a-number\n")
    for mode in ("overwrite", "append"):
        assert csv_to_parquet(spark, path, output, schema=AMOUNTS, mode=mode).status == "FAILED"
        assert kept(spark, output)
    assert [name for name in os.listdir(tmp_path) if "staged" in name or "old-" in name] == []


def test_no_data_files(spark, write, output, tmp_path):
    keep(spark, output)
    hidden = write("_export.csv", "id,amount\n1,2\n")
    write("none/_SUCCESS", "")
    write("none/.part-0.csv.crc", "x")
    for path in (hidden, str(tmp_path / "none")):
        result = csv_to_parquet(spark, path, output, schema=AMOUNTS)
        assert result.message.startswith("input contains no data files"), result.message
        assert kept(spark, output)
    header_only = write("h.csv", "id,amount\n")
    assert csv_to_parquet(spark, header_only, output, schema=AMOUNTS).metrics["rows"] == "0"
    with pytest.raises(GateError, match="contains no data files"):
        require_data_files(spark.read.schema("a INT").csv(str(tmp_path / "none")))


def test_output_exists(spark, output):
    keep(spark, output)
    for mode in ("error", " ErrorIfExists "):
        result = csv_to_parquet(spark, "/missing/input.csv", output, mode=mode)
        assert result.message == f"Output already exists: {output}"
    with pytest.raises(GateError, match="^Invalid write mode$"):
        csv_to_parquet(spark, "/missing/input.csv", output, mode="replace")


def test_paths(spark, write, tmp_path):
    path = write("in/data.csv", "id\n1\n")
    folder = str(tmp_path / "in")
    os.symlink(folder, tmp_path / "alias")
    for source, target in [(path, path), (path, folder), (folder, folder + "/out"), (path, folder + "/../in/data.csv"),
                           (path, str(tmp_path / "alias")), (folder, f"file:{tmp_path}/alias/deep/out")]:
        with pytest.raises(GateError, match="must not overlap"):
            csv_to_parquet(spark, source, target)
    for glob in ("dir/*", "{a,b}", "?", "[ab]"):
        with pytest.raises(GateError, match="literal file or directory path"):
            csv_to_parquet(spark, glob, str(tmp_path / "o"))
    assert csv_to_parquet(spark, path, str(tmp_path / "in-2"), data_root=str(tmp_path)).ok
    for source, target in [(path, "/elsewhere"), ("/elsewhere", path + "x"), (str(tmp_path), path + "x")]:
        with pytest.raises(GateError, match="must be inside the configured data root"):
            csv_to_parquet(spark, source, target, data_root=str(tmp_path))
    with pytest.raises(GateError, match="absolute"):
        csv_to_parquet(spark, path, path + "x", data_root="relative")


def test_counts_parse_whole_records(spark, write):
    assert row_count(spark, write("a.csv", "id,amount\n1,x\n"), "csv", schema=AMOUNTS).status == "FAILED"
    assert row_count(spark, write("b.csv", "id\n1\nabc\n"), "csv", schema="id INT").status == "FAILED"
    assert row_count(spark, write("c.csv", "id,amount\n1,2.50\n2,3\n"), "CSV", schema=AMOUNTS).metrics["rows"] == "2"
    schema = "id INT, name STRING"
    good = '{"id":1,"name":"a"}\n'
    assert row_count(spark, write("t.json", good + '{"id":3,"na'), "json", schema=schema).status == "FAILED"
    assert row_count(spark, write("m.json", good + '{"id":"oops","name":"b"}\n'), "json", schema=schema).status == "FAILED"
    assert row_count(spark, write("g.json", good * 2), "json", 2, schema=schema).ok
    with pytest.raises(GateError, match="inputFormat must not be blank"):
        row_count(spark, "x", " ")


LATIN = b"id,name\n1,caf\xe9\n2,na\xefve\n"


def test_wrong_charset(spark, write, output, tmp_path):
    path = write("latin.csv", LATIN)
    zipped = write("latin.csv.gz", gzip.compress(LATIN))
    for source in (path, zipped):
        for encoding in (None, "UTF-8"):
            result = csv_to_parquet(spark, source, output, encoding=encoding)
            assert result.message.startswith("input is not valid UTF-8: 2 line(s) cannot be decoded, the first in file:")
        assert csv_to_parquet(spark, source, output, encoding=" iso-8859-1 ").ok
        assert [row["name"] for row in spark.read.parquet(output).orderBy("id").collect()] == ["café", "naïve"]
        with pytest.raises(GateError, match=r"not valid GBK: 1 line\(s\)"):
            require_decodable(spark, source, "GBK")
    write("batch/a-valid.csv", "id,name\n1,ok\n")
    write("batch/b-latin1.csv", LATIN)
    write("batch/c-latin1.csv", LATIN)
    with pytest.raises(GateError, match=r"4 line\(s\) cannot be decoded, the first in .*b-latin1.csv;"):
        require_decodable(spark, str(tmp_path / "batch"))


def test_gbk(spark, write, output):
    for name, content in (("g.csv", "id,name\n1,中文\n".encode("gbk")), ("g.csv.gz", gzip.compress("id,name\n1,中文\n".encode("gbk")))):
        for multi_line in (True, False):
            assert csv_to_parquet(spark, write(name, content), output, encoding="GBK", multi_line=multi_line).ok
            assert spark.read.parquet(output).first()["name"] == "中文"


def test_partition_directories_do_not_hide_the_lines(spark, write, tmp_path):
    for partition in ("value=abc", "line0=abc", "VALUE=abc"):
        folder = tmp_path / partition.replace("=", "-")
        write(f"{folder.name}/{partition}/latin1.csv", LATIN)
        write(f"{folder.name}/{partition[:-3]}200/ok.csv", "id,name\n1,a\n")
        with pytest.raises(GateError, match=r"2 line\(s\)"):
            require_decodable(spark, str(folder))


def test_foreign_mark(spark, write, output):
    content = b"\xef\xbb\xbfid,name\n1,ok\n"
    for path in (write("bom.csv", content), write("bom.csv.gz", gzip.compress(content))):
        for encoding in ("US-ASCII", "ISO-8859-1", "GBK", "Shift_JIS"):
            with pytest.raises(GateError, match=r"1 file\(s\) start with the UTF-8 byte order mark, the first is file:.*; set encoding"):
                require_decodable(spark, path, encoding)
        assert csv_to_parquet(spark, path, output).ok
        assert spark.read.parquet(output).columns == ["id", "name"]


def test_long_lines(spark, write):
    long = ("中" * 60000).encode("gbk")
    require_decodable(spark, write("ok.txt", long + b"\n"), "GBK")
    for bad in (long[:60000] + b"\xff" + long[60001:], long[:-1]):
        with pytest.raises(GateError, match=r"1 line\(s\)"):
            require_decodable(spark, write("bad.txt", bad + b"\n"), "GBK")


def test_quoted_line_ends_and_headers(spark, write):
    rows = read_csv_strict(spark, write("q.csv", 'id,note\r\n1,"a\r\nb"\r\n')).collect()
    assert [row["note"] for row in rows] == ["a\nb"]
    assert read_csv_strict(spark, write("h.csv", "1,a\n2,b\n"), header="false").count() == 2
    wrong = read_csv_strict(spark, write("w.csv", "a,b\n1,2\n"), schema="x STRING, y STRING")
    with pytest.raises(Exception, match="(?i)header"):
        wrong.collect()
    inferred = read_csv_strict(spark, write("i.csv", "a,b\n1,x\n"), infer_schema=True)
    assert inferred.dtypes == [("a", "int"), ("b", "string")]


def test_write_modes(spark, write, output):
    path = write("w.csv", "id\n1\n2\n")
    assert csv_to_parquet(spark, path, output, mode="Overwrite").metrics["rows"] == "2"
    skipped = csv_to_parquet(spark, "/missing.csv", output, mode="ignore")
    assert (skipped.metrics["rows"], skipped.metrics["skipped"]) == ("0", "true")
    assert skipped.message == f"Skipped: {output} already exists (mode=ignore)"
    assert csv_to_parquet(spark, path, output, mode="errorifexists").status == "FAILED"
    assert csv_to_parquet(spark, path, output, mode="append").metrics["rows"] == "2"
    assert spark.read.parquet(output).count() == 4
    assert publish(spark.range(3), output, "overwrite") == {"rows": 3, "skipped": False}
    assert publish(spark.range(0), output, "overwrite")["rows"] == 0


@pytest.mark.parametrize("delimiter", ["", "\n", "a\r", '"', "\0"])
def test_bad_delimiters(spark, delimiter):
    with pytest.raises(GateError, match="delimiter must be nonempty"):
        read_csv_strict(spark, "x", delimiter=delimiter)


def test_bad_options(spark):
    for encoding in ("UTF-16", "UTF-32", "IBM037", "no-such-charset", " ", "ISO-2022-CN"):
        with pytest.raises(GateError, match="^encoding must name a charset") as caught:
            read_csv_strict(spark, "x", encoding=encoding)
        assert "no-such" not in str(caught.value)
    with pytest.raises(GateError, match="^header must be true or false$"):
        read_csv_strict(spark, "x", header="typo")
    with pytest.raises(GateError, match="escape must contain exactly one character"):
        read_csv_strict(spark, "x", escape="ab")
    with pytest.raises(GateError, match="^expectedRows must be a 64-bit integer >= 0$"):
        row_count(spark, "x", expected_rows="-1")


def test_two_character_delimiter(spark, write):
    assert read_csv_strict(spark, write("d.csv", "a||b\n1||2\n"), delimiter="||").first().asDict() == {"a": "1", "b": "2"}


def test_convert_and_verify_twice(spark, write, output):
    for encoding in ("UTF-8", "GBK"):
        path = write(f"{encoding}.csv", 'id,note\n001,"hello\nworld"\n002,中文\n'.encode(encoding))
        for _ in range(2):
            result = convert_and_verify(spark, path, output, schema="id STRING, note STRING", encoding=encoding)
            assert result.message == f"2 rows in {output}"
            assert [row["note"] for row in spark.read.parquet(output).orderBy("id").collect()] == ["hello\nworld", "中文"]


def test_run_log(spark, write, output, tmp_path):
    log = str(tmp_path / "log")
    result = csv_to_parquet(spark, write("l.csv", "id\n1\n"), output)
    log_result(spark, result, log)
    log_result(spark, row_count(spark, output, expected_rows=2), log)
    rows = {row["jobName"]: row for row in read_results(spark, log).collect()}
    assert rows["csv-to-parquet"]["metrics"]["rows"] == "1"
    assert rows["row-count"]["status"] == "FAILED"
    assert int(rows["row-count"]["metrics"]["durationMillis"]) >= 0
    assert result.to_json().startswith('{"jobName":"csv-to-parquet","status":"SUCCEEDED","message":"Wrote 1 rows to ')


def test_other_formats(spark, tmp_path):
    for fmt in ("orc", "json", "parquet"):
        path = str(tmp_path / fmt)
        spark.range(5).write.format(fmt).save(path)
        assert row_count(spark, path, fmt, 5).ok
        assert read_dataset(spark, fmt, path).count() == 5
