"""Queries of the ingest, publish and quality operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.operators import quality as gates
from tidegate.plans.registry import query, table
from tidegate.scale import scratch_path
from tidegate.results import JOB_ERRORS, GateError
from tidegate.sources.checks import checksums, file_heads, first_bad_bytes, undecodable
from tidegate.sources.publish import (
    complete_count, convert_and_verify, csv_to_parquet, log_result, publish, read_results, row_count, write_csv_rfc4180, write_dataset, write_lines,
)
from tidegate.sources.options import allow_charset
from tidegate.sources.readers import file_inventory, raw_lines, read_csv_strict, read_dataset, storage_footprint
from tidegate.functions.sql import register_strict_csv
from tidegate.sources.strict_csv import read_csv_rfc4180, records, rectangular
from tidegate.sources.versions import commit, read_version, upsert

# The given tables and how many columns they have.
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
          "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}
COUNTED_TABLES = list(WIDTHS)
CSV_WRITE = {"header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}


def quality_sql(source: str, columns: list[str]) -> str:
    blank = [f"regexp_full_match(coalesce(CAST({name} AS VARCHAR), ''), '\\s*')" for name in columns]
    cells = " + ".join(f"CAST({test} AS BIGINT)" for test in blank)
    return f"""
        SELECT count(*) AS "rows", CAST({len(columns)} AS BIGINT) AS "columns",
               CAST(coalesce(sum({cells}), 0) AS BIGINT) AS "blankCells",
               CAST(coalesce(sum(CAST({' AND '.join(blank)} AS BIGINT)), 0) AS BIGINT) AS "blankRows",
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {source})) AS "duplicateRows"
        FROM {source}"""


@query(quality_sql("documents", ["text", "lang", "source"]))
def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.quality_counts(table(spark, sf_dir, "documents").select("text", "lang", "source"))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(quality_sql("customer", CUSTOMER))
def quality_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.quality_counts(table(spark, sf_dir, "customer").select(*CUSTOMER))


@query("""
    WITH c AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (
        SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem)) AS d FROM lineitem)
    SELECT n AS "rows", CAST(4 AS BIGINT) AS "columns", CAST(0 AS BIGINT) AS "blankCells",
           CAST(0 AS BIGINT) AS "blankRows", d AS "duplicateRows",
           CASE WHEN n < 100000000000 OR d > 5 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
           CASE WHEN n < 100000000000 OR d > 5 THEN 'CSV quality failed: ' || concat_ws('; ',
                CASE WHEN n < 100000000000 THEN 'rows=' || n || ' is below minRows=100000000000' END,
                CASE WHEN d > 5 THEN 'duplicateRows=' || d || ' exceeds maxDuplicateRows=5' END)
           ELSE 'CSV quality passed: ' || n || ' rows, 0 blank cells, ' || d || ' duplicate rows' END AS message
    FROM c""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return gates.verdict(gates.quality_counts(rows), min_rows=100_000_000_000, max_duplicate_rows=5)


@query("""
    SELECT CAST(sum(CAST(role = 'system' AS BIGINT) + CAST(turn = 0 AS BIGINT)) AS BIGINT) AS "blankCells",
           CAST(count(*) FILTER (role = 'system' AND turn = 0) AS BIGINT) AS "blankRows" FROM conversations""")
def blank_cells_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(
        F.when(F.col("role") == "system", " \t").otherwise(F.col("role")).alias("role"),
        F.when(F.col("turn") == 0, None).otherwise(F.col("text")).alias("text"),
    )
    return gates.blank_counts(said)


@query("""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS "duplicateRows" FROM documents""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query("""
    SELECT brand, floor, executed, executed IS NOT NULL AND executed >= floor AS ok,
           CASE WHEN executed IS NULL THEN brand || ': no reports'
                WHEN executed < floor THEN brand || ' executed ' || executed || ' tests, expected at least ' || floor END AS message
    FROM (SELECT brand, CAST(floor AS BIGINT) AS floor FROM (VALUES ('Brand#1', 10), ('Brand#2', 1000000000), ('Brand#none', 1)) v(brand, floor))
    LEFT JOIN (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS executed FROM part GROUP BY p_brand) ON p_brand = brand""")
def floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("executed"))
    floors = spark.createDataFrame([("Brand#1", 10), ("Brand#2", 1_000_000_000), ("Brand#none", 1)], "brand string, floor long")
    return gates.floor_gate(measured, floors, "brand")


@query("""
    WITH cases AS (SELECT l_orderkey AS orderkey, l_linenumber // 4 AS part, count(*) AS tests, count(*) FILTER (l_returnflag = 'R') AS marked
                   FROM lineitem GROUP BY 1, 2)
    SELECT orderkey, CAST(sum(tests - greatest(marked, (orderkey + part) % 2)) AS BIGINT) AS executed,
           CAST(sum(greatest(marked, (orderkey + part) % 2)) AS BIGINT) AS skipped,
           CASE WHEN orderkey % 11 = 0 THEN 'cannot parse' END AS problem FROM cases GROUP BY orderkey""")
def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.concat(
        F.lit('<testcase name="'), F.col("l_linenumber").cast("string"), F.lit('">'),
        F.when(F.col("l_returnflag") == "R", "<skipped/>").otherwise(""), F.lit("</testcase>"),
    )
    # A report holds four lines at most, so an order of any size is many small reports; some have one that is cut short.
    part = F.floor(F.col("l_linenumber") / 4)
    suites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey"), part.alias("part")).agg(
        F.count(F.lit(1)).alias("tests"), F.array_join(F.collect_list(case), "").alias("cases")
    )
    suite = F.concat(
        F.lit('<testsuite tests="'), F.col("tests").cast("string"), F.lit('" skipped="'),
        ((F.col("orderkey") + F.col("part")) % 2).cast("string"), F.lit('">'), F.col("cases"), F.lit("</testsuite>"),
    )
    nested = F.concat(F.lit("<testsuites>"), suite, F.lit("</testsuites>"))
    reports = suites.select("orderkey", F.when(F.col("orderkey") % 3 == 0, nested).otherwise(suite).alias("document"))
    cut = suites.filter("orderkey % 11 = 0").select("orderkey", F.expr("substring(cases, 1, length(cases) - 3)").alias("document"))
    return gates.suite_totals(reports.unionByName(cut.withColumn("document", F.concat(F.lit("<testsuite>"), "document"))), "orderkey")


def _csv(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{**CSV_WRITE, **options}).csv(path)
    return path


def _converted(spark: SparkSession, source: str, schema: str, **options) -> DataFrame:
    output = scratch_path(spark, "parquet")
    result = convert_and_verify(spark, source, output, schema=schema, **options)
    if not result.ok:
        raise ValueError(result.message)
    return read_dataset(spark, "parquet", output)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
          FROM orders""")
def csv_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    schema = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE, "
              "o_orderpriority STRING")
    return _converted(spark, _csv(orders, "orders"), schema, multi_line=False)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _csv(table(spark, sf_dir, "documents"), "documents")
    return _converted(spark, source, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("SELECT c_custkey, c_name, '中文' || c_mktsegment AS note FROM customer")
def csv_gbk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow_charset(spark, "GBK")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("中文"), "c_mktsegment").alias("note"))
    source = _csv(customers, "gbk", encoding="GBK")
    return _converted(spark, source, "c_custkey BIGINT, c_name STRING, note STRING", encoding="GBK")


@query("""
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id, l_linenumber,
           CAST(CAST(l_extendedprice AS DECIMAL(22,4)) AS VARCHAR) AS amount FROM lineitem""")
def decimal_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("id"), "l_linenumber",
        F.col("l_extendedprice").cast("decimal(22,4)").alias("amount"),
    )
    back = _converted(spark, _csv(lines, "decimals"), "id STRING, l_linenumber INT, amount DECIMAL(22,4)", multi_line=False)
    return back.withColumn("amount", F.col("amount").cast("string"))


@query("""SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer""")
def csv_inferred_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    back = read_csv_strict(spark, _csv(customers, "inferred"), infer_schema=True, multi_line=False)
    return back.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_failfast_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "props")
    write_lines(table(spark, sf_dir, "events").select("props"), path)
    counted = row_count(spark, path, "json", schema="k INT")
    if not counted.ok:
        raise ValueError(counted.message)
    return read_dataset(spark, "json", path, schema="k INT").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(substr(o_orderdate::VARCHAR, 1, 4) AS INTEGER) AS year, count(*) AS n,
                 CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "partitioned")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    orders.write.partitionBy("year").orc(path)
    return read_dataset(spark, "orc", path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query("""SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def compressed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _csv(table(spark, sf_dir, "documents"), "gzip", compression="gzip")
    back = read_csv_strict(
        spark, source, schema="doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    )
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.char_length("text")).alias("chars"))


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, 'SUCCEEDED' AS status, count(*) AS \"rows\" FROM {name}" for name in COUNTED_TABLES
) + " UNION ALL SELECT 'orders vs customer', CASE WHEN (SELECT count(*) FROM customer) = count(*) THEN 'SUCCEEDED' ELSE 'FAILED' END, count(*) FROM orders")
def row_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = [(name, row_count(spark, f"{sf_dir}/{name}.parquet")) for name in COUNTED_TABLES]
    customers = next(result.metrics["rows"] for name, result in results if name == "customer")
    results.append(("orders vs customer", row_count(spark, f"{sf_dir}/orders.parquet", expected_rows=customers)))
    rows = [(name, result.status, int(result.metrics["rows"])) for name, result in results]
    return spark.createDataFrame(rows, "name string, status string, rows long")


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS \"rows\", CAST({width} AS BIGINT) AS \"columns\" FROM {name}"
    for name, width in WIDTHS.items()))
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
        )

    return reduce(lambda a, b: a.unionByName(b), map(one, WIDTHS))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def nation_files(spark: SparkSession, sf_dir: str, *, broken: bool = False) -> str:
    """A folder with a file for each nation: its suppliers' names, one in a line, in their order.

    With ``broken``, files of even nations begin with a character cut short.
    """
    path = scratch_path(spark, "nations")
    suppliers = table(spark, sf_dir, "supplier")
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) == 1
    cut = F.when(F.lit(broken) & (F.col("s_nationkey") % 2 == 0) & F.col("first"), F.lit(b"ab\xe2\x82")).otherwise(F.lit(b""))
    lines = suppliers.withColumn("first", first).select(
        F.concat(cut, F.col("s_name").cast("binary")).cast("string").alias("line"), F.col("s_nationkey").alias("nation"), "s_suppkey"
    )
    sorted_lines = lines.repartition("nation").sortWithinPartitions("nation", "s_suppkey").drop("s_suppkey")
    sorted_lines.write.partitionBy("nation").text(path)
    return path


def nation_of(path: Column) -> Column:
    return F.regexp_extract(path, "/nation=([0-9]+)/", 1).cast("long").alias("nation")


NATION_SQL = """(SELECT s_nationkey AS nation, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) AS content FROM supplier GROUP BY s_nationkey)"""


@query(f"SELECT nation, strlen(content) AS bytes, sha256(content) AS sha256 FROM {NATION_SQL}")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(spark, nation_files(spark, sf_dir)).filter(F.col("path").contains("/part-")).select(nation_of(F.col("path")), "bytes", "sha256")


@query(f"SELECT nation, strlen(content) AS length FROM {NATION_SQL}")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_inventory(spark, nation_files(spark, sf_dir)).select(nation_of(F.col("path")), "length")


@query(f"SELECT count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM {NATION_SQL}")
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_footprint(file_inventory(spark, nation_files(spark, sf_dir)))


@query(f"SELECT nation, hex(encode(left(content, 4))) AS head FROM {NATION_SQL}")
def first_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = file_heads(spark, nation_files(spark, sf_dir), 4)
    return heads.select(nation_of(F.col("path")), F.hex("head").alias("head"))


@query(f"SELECT nation, CAST(2 AS BIGINT) AS \"offset\" FROM {NATION_SQL} WHERE nation % 2 = 0")
def first_bad_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_bad_bytes(spark, nation_files(spark, sf_dir, broken=True))
    return found.select(nation_of(F.col("path")), "offset")


@query("""SELECT count(*) AS "rows", (SELECT count(*) FROM customer) AS expected, false AS skipped FROM customer""")
def write_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, path, other = table(spark, sf_dir, "customer"), scratch_path(spark, "written"), scratch_path(spark, "copied")
    done = publish(customers, path, "error", "json")
    try:
        publish(customers.limit(1), path, "errorifexists", "json")
        raise ValueError("a second write replaced the first")
    except GateError:
        write_dataset(read_dataset(spark, "json", path, schema=customers.schema), "json", other)
    rows = complete_count(read_dataset(spark, "json", other, schema=customers.schema))
    return customers.agg(F.lit(rows).alias("rows"), F.count(F.lit(1)).alias("expected")).withColumn("skipped", F.lit(done["skipped"]))


@query("""SELECT CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines,
                 CAST(sum(strlen(replace(text, chr(10), ''))) AS BIGINT) AS bytes FROM conversations""")
def raw_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    write_lines(table(spark, sf_dir, "conversations").select("text"), path)
    return raw_lines(spark, path).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("bytes")).cast("long").alias("bytes")
    )


@query("SELECT lang, count(*) FILTER (doc_id % 3 = 0) AS bad, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def undecodable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every third text gets a lead byte without what must follow it.
    value = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xe2\x82")).otherwise(F.lit(b"")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(undecodable(value, "UTF-8")).alias("bad"), F.sum(F.octet_length("text")).cast("long").alias("bytes")
    )


@query(quality_sql("documents", ["text", "lang", "source"]))
def strict_csv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "strict")
    write_csv_rfc4180(table(spark, sf_dir, "documents").select("text", "lang", "source"), path)
    counts = gates.strict_quality_counts(records(spark, path), header=False)
    return counts.withColumn("columns", F.col("columns").cast("long")).drop("widest", "malformed")


@query("SELECT conv_id, turn, role, text FROM conversations")
def strict_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "strict")
    write_csv_rfc4180(table(spark, sf_dir, "conversations"), path, ";")
    rows = read_csv_rfc4180(spark, path, delimiter=";")
    field = F.col("fields")
    return rows.select(
        field[0].cast("long").alias("conv_id"), field[1].cast("long").alias("turn"), field[2].alias("role"), field[3].alias("text")
    )


@query("""
    WITH numbered AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS record, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END AS width FROM orders),
    first AS (SELECT width AS expected FROM numbered WHERE record = 1)
    SELECT record AS record_no, CAST(width AS INTEGER) AS width, CAST(expected AS INTEGER) AS expected FROM numbered, first
    WHERE width <> expected ORDER BY record LIMIT 1""")
def ragged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ragged")
    line = F.concat_ws(",", F.col("o_orderkey"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", "extra"))
    # One file, so that records are numbered as the orders are.
    write_lines(table(spark, sf_dir, "orders").orderBy("o_orderkey").select(line.alias("line")).coalesce(1), path)
    return rectangular(read_csv_rfc4180(spark, path)).select("record_no", "width", "expected")


@query("SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")
def appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    write_lines(table(spark, sf_dir, "customer").select("c_name"), path)
    write_lines(table(spark, sf_dir, "supplier").select("s_name"), path, append=True)
    return spark.read.text(path)


@query("""
    SELECT * FROM (VALUES ('overwrite', (SELECT count(*) FROM customer), false), ('ignore', 0, true),
        ('append', (SELECT count(*) FROM customer), false), ('again', (SELECT count(*) FROM supplier), false))
        v(mode, "rows", skipped)""")
def write_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "modes")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    others = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    steps = [("overwrite", names, "overwrite"), ("ignore", names, "ignore"), ("append", names, "append"),
             ("again", others, "overwrite")]
    rows = []
    for label, df, mode in steps:
        done = publish(df, path, mode)
        rows.append((label, done["rows"], done["skipped"]))
    if read_dataset(spark, "parquet", path).count() != rows[-1][1]:
        raise ValueError("overwrite left other rows behind")
    return spark.createDataFrame(rows, "mode string, rows long, skipped boolean")


@query("""SELECT 'row-count' AS "jobName", 'SUCCEEDED' AS status, CAST(count(*) AS VARCHAR) AS "rows" FROM events
          UNION ALL SELECT 'csv-to-parquet', 'SUCCEEDED', CAST(count(*) AS VARCHAR) FROM part""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scratch_path(spark, "runlog")
    log_result(spark, row_count(spark, f"{sf_dir}/events.parquet"), log)
    parts = _csv(table(spark, sf_dir, "part"), "part")
    schema = ("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE")
    log_result(spark, csv_to_parquet(spark, parts, scratch_path(spark, "part"), schema=schema), log)
    return read_results(spark, log).select("jobName", "status", F.col("metrics")["rows"].alias("rows"))



@query("""
    SELECT c.c_mktsegment AS segment, count(*) AS customers, sum(length(c.c_name))::BIGINT AS letters, min(n.n_name) AS first_nation
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def strict_csv_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "strict-sql")
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.concat("c_name", F.lit(' "\n"')).alias("c_name"))
    write_csv_rfc4180(customers, f"{base}/customer")
    write_csv_rfc4180(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{base}/nation")
    register_strict_csv(spark, {"customer": f"{base}/customer", "nation": f"{base}/nation"})
    return spark.sql("""
        SELECT c.fields[1] AS segment, count(*) AS customers, sum(char_length(c.fields[2]) - 4) AS letters, min(n.fields[1]) AS first_nation
        FROM strict_csv('customer') c JOIN strict_csv('nation') n ON c.fields[0] = n.fields[0] GROUP BY 1""")


CUSTOMER_LINES = """
    SELECT string_agg(c_custkey || ',"' || c_name || '",' || coalesce(c_mktsegment, '') || chr(10), '' ORDER BY c_custkey) AS body,
        count(*) AS n FROM customer"""


def customer_file(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The customers as one strict CSV file in the order of their keys, names always quoted."""
    path = scratch_path(spark, name)
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), F.coalesce("c_mktsegment", F.lit("")))
    write_lines(table(spark, sf_dir, "customer").orderBy("c_custkey").select(line.alias("line")).coalesce(1), path)
    return path


@query(f"""
    SELECT 'SUCCEEDED' AS status, CAST(n AS VARCHAR) AS "rows", '3' AS columns, CAST(strlen(body) AS VARCHAR) AS bytes, sha256(body) AS sha256
    FROM ({CUSTOMER_LINES})""")
def strict_csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = gates.profile(spark, customer_file(spark, sf_dir, "profile"), header=False).to_df(spark)
    return result.select("status", *[F.col("metrics")[name].alias(name) for name in ("rows", "columns", "bytes", "sha256")])


@query(f"""
    SELECT 'FAILED' AS status, 'CSV quality failed: rows=' || n - 1 || ' is below minRows=' || n AS message, CAST(n - 1 AS VARCHAR) AS "rows",
        CAST(strlen(body) AS VARCHAR) AS bytes, sha256(body) AS sha256, '0' AS duplicates FROM ({CUSTOMER_LINES})""")
def strict_csv_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first record counts as the header, so one row is missing.
    path, count = customer_file(spark, sf_dir, "gate"), table(spark, sf_dir, "customer").count()
    result = gates.quality_csv(spark, path, min_rows=count).to_df(spark)
    metric = F.col("metrics")
    return result.select("status", "message", metric["rows"].alias("rows"), metric["bytes"].alias("bytes"), metric["sha256"].alias("sha256"),
                         metric["duplicateRows"].alias("duplicates"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def headerless_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = _csv(parts, "headerless", header="false")
    return read_csv_strict(spark, path, header=False, schema="p_partkey BIGINT, p_name STRING, p_size INT", multi_line=False)


@query("""
    SELECT 'no files' AS case, 'FAILED' AS status, 'input contains no data files (Spark skips names starting with _ or .)' AS message
    UNION ALL SELECT 'foreign mark', 'FAILED', 'input is not valid GBK: 1 file(s) start with the UTF-8 byte order mark, the first is a file; '
        || 'set encoding to UTF-8'
    UNION ALL SELECT 'undecodable', 'FAILED', 'input is not valid UTF-8: ' || (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0)
        || ' line(s) cannot be decoded, the first in a file; set encoding to the charset the data was written in'
    UNION ALL SELECT 'other count', 'FAILED', 'Expected 3 rows but found ' || (SELECT count(*) FROM customer)""")
def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    hidden, marked = scratch_path(spark, "hidden"), scratch_path(spark, "marked")
    write_lines(customers.select("c_name"), f"{hidden}/_part")
    first = F.when(F.col("c_custkey") == customers.agg(F.min("c_custkey")).first()[0], F.lit("\ufeff")).otherwise("")
    write_lines(customers.orderBy("c_custkey").select(F.concat(first, "c_name").alias("line")).coalesce(1), marked)
    accents = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("\u00e9"))).otherwise(F.col("c_name"))
    latin = _csv(customers.select(accents.alias("name")), "latin", encoding="ISO-8859-1")
    plain = _csv(customers.select("c_name"), "plain")
    cases = {
        "no files": row_count(spark, hidden, "csv", schema="name STRING"),
        "foreign mark": row_count(spark, marked, "csv", schema="name STRING", header=False, encoding="GBK"),
        "undecodable": row_count(spark, latin, "csv", schema="name STRING"),
        "other count": row_count(spark, plain, "csv", 3, schema="c_name STRING"),
    }
    message = F.regexp_replace("message", "the first (is|in) [^;]+", "the first $1 a file")
    return reduce(DataFrame.unionByName, [
        result.to_df(spark).select(F.lit(case).alias("case"), "status", message.alias("message")) for case, result in cases.items()])


@query("SELECT s_name AS name FROM supplier")
def failed_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after an overwrite and an append that broke on some rows: the output before."""
    path = scratch_path(spark, "survivor")
    publish(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), path)
    broken = F.when(F.col("c_custkey") % 100 == 7, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("c_name"))
    for mode in ("overwrite", "append"):
        try:
            publish(table(spark, sf_dir, "customer").select(broken.alias("name")), path, mode)
        except JOB_ERRORS:
            continue
        raise ValueError("a broken table was published")
    return read_dataset(spark, "parquet", path)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 100 IN (7, 9) THEN 'X' ELSE o_orderstatus END AS status,
           o_totalprice + CASE WHEN o_orderkey % 100 IN (7, 9) THEN 1 ELSE 0 END AS price
    FROM orders WHERE o_orderkey % 50 <> 7 OR o_orderkey % 100 = 7""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table committed without some orders; one upsert adds half of them, changes others and brings stale rows."""
    root, key = scratch_path(spark, "orders-versions"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    dated = orders.withColumn("written", F.lit(1))
    commit(dated.filter(key % 50 != 7), root, ["o_orderkey"])
    new = dated.filter((key % 100).isin(7, 9)).withColumns({"status": F.lit("X"), "price": F.col("price") + 1, "written": F.lit(2)})
    stale = dated.filter(key % 100 == 11).withColumns({"status": F.lit("stale"), "written": F.lit(0)})
    upsert(new.unionByName(stale), root, ["written"])
    return read_version(spark, root).drop("written")
