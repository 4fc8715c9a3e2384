"""Runs registered queries on Spark and their SQL on DuckDB and compares the values.

    python tests/compare.py [sf_dir] [query ...]
"""

import datetime
import decimal
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, name, run, sql, sf_dir):
    """(problem or None, row count)."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return (None if got else "no rows"), len(got)
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {[r for r in got if r not in want][:3]} / {[r for r in want if r not in got][:3]}", len(got)
    for mine, other in zip(got, want):
        if mine != other:
            return f"{mine} against {other}", len(got)
        if [type(v) for v in mine] != [type(v) for v in other] and None not in mine + other:
            return f"types {[type(v) for v in mine]} against {[type(v) for v in other]}", len(got)
    return None, len(got)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.time()
        try:
            problem, count = compare(spark, connection, name, run, oracle.get(name), sf_dir)
        except Exception as error:
            problem, count = f"{type(error).__name__}: {str(error)[:700]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {kind} {count} {time.time() - started:.1f}s {problem or ''}"[:1500], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
