import csv
import hashlib
import os
import random

import pytest

from tidegate.functions.sql import register_strict_csv
from tidegate.operators.quality import profile, quality_csv
from tidegate.results import GateError
from tidegate.sources.checks import first_bad_bytes
from tidegate.sources.publish import csv_text, write_csv_rfc4180
from tidegate.sources.splits import split_lines
from tidegate.sources.strict_csv import pieces, pieces_of, read_csv_rfc4180, split_states


def parsed(spark, path, **options):
    rows = read_csv_rfc4180(spark, path, **options).orderBy("file", "record_no").collect()
    assert [row["record_no"] for row in rows] == list(range(1, len(rows) + 1))
    return [list(row["fields"]) for row in rows]


RECORDS = [
    ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    ("﻿id,note\r\n1,\"line one\nline two\"\r\n2,\"say \"\"hi\"\", then go\"\r\n",
     [["id", "note"], ["1", "line one\nline two"], ["2", 'say "hi", then go']]),
    ("a\rb\rc", [["a"], ["b"], ["c"]]),
    ("a\r\r\nb\n", [["a"], [""], ["b"]]),
    ('x,"a\rb"\ry,2\n', [["x", "a\rb"], ["y", "2"]]),
    ("value\n1\n\n2\n", [["value"], ["1"], [""], ["2"]]),
    ('"",""\n', [["", ""]]),
    ('""""\n"""a"""\n', [['"'], ['"a"']]),
    ('"a\r\nb",c\r\n', [["a\r\nb", "c"]]),
    ("a\x01b,\x01\n\"\x01b\x01c\",2\n", [["a\x01b", "\x01"], ["\x01b\x01c", "2"]]),
    ("", []),
    ("one", [["one"]]),
    (",\n", [["", ""]]),
]


def test_records(spark, write):
    for number, (content, expected) in enumerate(RECORDS):
        folder = write(f"all/{number:02d}.csv", content)
    rows = read_csv_rfc4180(spark, folder.rsplit("/", 1)[0]).orderBy("file", "record_no").collect()
    for number, (_, expected) in enumerate(RECORDS):
        mine = [row for row in rows if row["file"].endswith(f"{number:02d}.csv")]
        assert [list(row["fields"]) for row in mine] == expected
        assert [row["record_no"] for row in mine] == list(range(1, len(mine) + 1))


def test_other_delimiters(spark, write):
    assert parsed(spark, write("a.csv", "a;b;c\n1;2,5;3\n"), delimiter=";") == [["a", "b", "c"], ["1", "2,5", "3"]]
    assert parsed(spark, write("b.csv", "a\tb\n1\t2\n"), delimiter="\t") == [["a", "b"], ["1", "2"]]
    assert parsed(spark, write("c.csv", 'a|"x|y"\n'), delimiter="|") == [["a", "x|y"]]
    for bad in ('"', "\r", "\n", "\0", "", "ab"):
        with pytest.raises(GateError):
            read_csv_rfc4180(spark, "nowhere", delimiter=bad)


@pytest.mark.parametrize(
    "content, message",
    [
        ('"unterminated', "Unterminated quoted CSV field."),
        ('ok,1\n"open\nmore,"" \n', "Unterminated quoted CSV field."),
        ('a"b', "Unexpected quote at CSV offset 1"),
        ('"a"b', "Unexpected character after closing CSV quote at offset 3"),
        ('x,"a" ', "Unexpected character after closing CSV quote at offset 5"),
        ('ok,"1"\n😀,"2"\nx,y"z\n', "Unexpected quote at CSV offset 17"),
        ('﻿a"b', "Unexpected quote at CSV offset 2"),
        ('"a\nb" ,"c"\nd"\n', "Unexpected character after closing CSV quote at offset 5"),
    ],
)
def test_quoting_errors(spark, write, content, message):
    with pytest.raises(GateError, match="^" + message.replace(".", r"\.") + "$"):
        read_csv_rfc4180(spark, write("bad.csv", content))


def test_generated_files_over_many_splits(spark, write, tmp_path):
    rng = random.Random(7)
    alphabet = ["a", "b", ",", '"', "\n", "\r\n", "\r", "é", "中", "😀", " ", "", "\x01", "xyz" * 5]
    rows = [["".join(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(3)] for _ in range(1500)]
    path = tmp_path / "gen.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows(rows)
    with open(path, newline="", encoding="utf-8") as given:
        assert list(csv.reader(given)) == rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert parsed(spark, str(path)) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_writer_round_trip(spark, tmp_path):
    rows = [("a,b", 'q"q', None), ("", "﻿x", "a\r\nb"), ("plain", " pad ", "中"), ("l\rm", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    out = str(tmp_path / "out")
    assert write_csv_rfc4180(df, out) == {"rows": 4, "skipped": False}
    want = [[value or "" for value in row] for row in rows]
    assert sorted(parsed(spark, out)) == sorted(want)
    text = "".join(row.value + "\n" for row in csv_text(df).collect())
    assert text.startswith('"a,b","q""q",\n,"﻿x","a\r\nb"\n')
    lone = spark.createDataFrame([("",), (None,), ("x",)], "a string")
    assert [row.value for row in csv_text(lone).collect()] == ['""', '""', "x"]
    with pytest.raises(GateError, match="at least one field"):
        csv_text(spark.range(1).select())


def sha(content):
    return hashlib.sha256(content.encode()).hexdigest()


def test_profile(spark, write):
    content = "id,name\n1,Ada\n2,Grace\n"
    result = profile(spark, write("p.csv", content))
    assert result.metrics == {"rows": "2", "columns": "2", "bytes": str(len(content)), "sha256": sha(content)}
    assert result.message.startswith("2 rows, 2 columns in ")
    assert profile(spark, write("h.csv", "1,Ada\n2,Grace\n3,Linus\n"), header=False).metrics["rows"] == "3"
    short = profile(spark, write("p.csv", content), expected_rows=3)
    assert (short.status, short.message) == ("FAILED", "Expected 3 rows but found 2")
    assert short.metrics["rows"] == "2"


@pytest.mark.parametrize(
    "content, header, message",
    [
        ('a,b\n"x\ny",1\n2\n', True, "CSV record 3 has 1 field but the header has 2 fields"),
        ("1,2\n3,4,5\n", False, "CSV record 2 has 3 fields but record 1 has 2 fields"),
        ("a,b\n1,2\n\n", True, "CSV record 3 has 1 field but the header has 2 fields"),
        ("a\rb,c\n", True, "CSV record 2 has 2 fields but the header has 1 field"),
    ],
)
def test_ragged(spark, write, content, header, message):
    for gate in (profile, quality_csv):
        with pytest.raises(GateError, match=message):
            gate(spark, write("r.csv", content), header=header)


def test_states_of_splits(spark, write):
    """Quotes, records and errors chain over splits that start inside and outside of quotes; both joins give the same."""
    content = "".join(f'{i},"line {i}\n{"x" * (i % 97)}""\r{i}"\r' + ("\n" if i % 2 else "") for i in range(3000))
    path = write("s/a.csv", content)
    write("s/b.csv", content + '7,"open\n' + content)
    write("s/c.csv", "é😀" + content + 'a,é😀b\nx"\n' + content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        states = split_states(spark, path.rsplit("/", 1)[0])
        assert states.filter("inside = 1").count() > 10 and states.count() > 60
        odd = {row["file"][-5:]: (row["odd"], row["malformed"]) for row in states.collect()}
        assert odd["a.csv"] == (False, False) and odd["b.csv"][1] and odd["c.csv"][1]
        sent, sorted_ = (pieces_of(spark, path.rsplit("/", 1)[0], states, sent).collect() for sent in (10**6, 1))
        assert sorted(sent) == sorted(sorted_)
        mine = sorted((row["chunk"], row["text"].rstrip("\r")) for row in sent if row["file"].endswith("a.csv"))
        assert mine == [(i + 1, f'{i},"line {i}\n{"x" * (i % 97)}""\r{i}"') for i in range(3000)]
        with pytest.raises(GateError, match=f"Unexpected quote at CSV offset {3 + len(content) + 8}$"):
            read_csv_rfc4180(spark, path.replace("a.csv", "c.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_bad_byte_over_splits(spark, write):
    good = "".join(f"line {i} é😀\n" for i in range(2000)).encode()
    cases = {"a": good + b"ab\xe4\n" + good, "b": b"\xef\xbb\xbf" + good + b"x\xff", "c": good, "d": b"\x80\n" + good, "e x+%": good + b"\xed\xa0\x80\n\xff"}
    for name, content in cases.items():
        path = write(f"bytes/{name}.txt", content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        folder = path.rsplit("/", 1)[0]
        assert split_lines(spark, folder).rdd.getNumPartitions() > 20
        found = {os.path.basename(row["path"])[:-4]: row["offset"] for row in first_bad_bytes(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for name, content in cases.items():
        try:
            content.decode()
        except UnicodeDecodeError as error:
            want[name] = error.start
    assert found == want and len(want) == 4


def test_from_sql(spark, write):
    one = write("sql/one.csv", 'id;name\n1;"a\nb"\n2;c\n')
    register_strict_csv(spark, {"one": one, "it's": write("sql/two.csv", 'x;"y""z"\n'), "bad": write("sql/bad.csv", 'x;"y"z\n')}, delimiter=";")
    rows = spark.sql("SELECT record_no, fields[1] AS name FROM strict_csv('one') WHERE record_no > 1 ORDER BY 1").collect()
    assert [tuple(row) for row in rows] == [(2, "a\nb"), (3, "c")]
    joined = spark.sql("SELECT a.fields FROM strict_csv('it''s') a JOIN strict_csv('one') b ON a.record_no = b.record_no").collect()
    assert [row["fields"] for row in joined] == [["x", 'y"z']]
    with pytest.raises(Exception, match="Unexpected character after closing CSV quote at offset 5"):
        spark.sql("SELECT * FROM strict_csv('bad')").collect()
    with pytest.raises(Exception, match="no strict CSV source"):
        spark.sql("SELECT * FROM strict_csv('other')").collect()


def test_invalid_utf8_offset(spark, write):
    with pytest.raises(GateError, match="is not valid UTF-8 at byte offset 9$"):
        profile(spark, write("l.csv", b"id,n\n1,ok\xe9\n"))
    with pytest.raises(GateError, match="Unexpected quote at CSV offset 6"):
        profile(spark, write("q.csv", 'id,n\n1"\n'))


def test_quality_gates(spark, write):
    clean = quality_csv(spark, write("c.csv", "id,name\n1,艾达\n2,Grace\n"))
    assert clean.message == "CSV quality passed: 2 rows, 0 blank cells, 0 duplicate rows"
    path = write("v.csv", "id,name\n1,private-content\n1,private-content\n ,\t\n")
    bad = quality_csv(spark, path, min_rows=4)
    assert bad.message == (
        "CSV quality failed: rows=3 is below minRows=4; blankCells=2 exceeds maxBlankCells=0; "
        "duplicateRows=1 exceeds maxDuplicateRows=0"
    )
    assert {k: bad.metrics[k] for k in ("rows", "columns", "blankCells", "blankRows", "duplicateRows")} == {
        "rows": "3", "columns": "2", "blankCells": "2", "blankRows": "1", "duplicateRows": "1"}
    exact = write("e.csv", "a,b\nx,\nx,\n")
    assert quality_csv(spark, exact, min_rows=2, max_blank_cells=2, max_duplicate_rows=1).ok
    assert not quality_csv(spark, exact, min_rows=2, max_blank_cells=1, max_duplicate_rows=1).ok
    assert not quality_csv(spark, exact, min_rows=2, max_blank_cells=2, max_duplicate_rows=0).ok


@pytest.mark.parametrize(
    "content, metrics",
    [
        ("a,b\na,b\na,b\na,b\n", {"rows": "3", "duplicateRows": "2"}),
        ('value\n"\u2003"\nnull\n"\t"\n', {"blankCells": "2", "rows": "3"}),
    ("value\n\u00a0\n\u200b\n\u001c\n\u0085\n", {"blankCells": "1", "rows": "4"}),
        ('a,b\n"x,y",z\nx,"y,z"\nA,b\na,b\n a,b\nAa,b\nBB,b\n', {"rows": "7", "duplicateRows": "0"}),
        ("id\n", {"rows": "0", "columns": "1", "duplicateRows": "0"}),
        ("", {"rows": "0", "columns": "0"}),
    ],
)
def test_quality_counts(spark, write, content, metrics):
    result = quality_csv(spark, write("q.csv", content), min_rows=0, max_blank_cells=9, max_duplicate_rows=9)
    assert {key: result.metrics[key] for key in metrics} == metrics
    if metrics["rows"] == "0":
        empty = quality_csv(spark, write("q.csv", content))
        assert empty.message == "CSV quality failed: rows=0 is below minRows=1"


@pytest.mark.parametrize("value", ["-1", "", "1.5", str(2**63), "text"])
def test_bad_gates(spark, value):
    with pytest.raises(GateError, match="^minRows must be a 64-bit integer >= 0$"):
        quality_csv(spark, "nowhere", min_rows=value)


def test_a_malformed_file_gathers_nothing(spark, write):
    lines = "a,b\n" * 500
    for content in ('"never closed\n' + lines, 'x"y\n' + lines + '"z"\n', lines + 'a,"b" \n' + lines):
        rows = pieces(spark, write("m/bad.csv", content)).collect()
        assert [(row["chunk"], row["text"]) for row in rows] == [(0, None)]
