"""Runs queries on Spark and their SQL on DuckDB and compares the rows.

    python tests/compare.py [sf] [name ...]
"""

import datetime
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("n", str(value.normalize() + 0))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return ("n", str(decimal.Decimal(value).normalize() + 0))
    if isinstance(value, float):
        return ("f", round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def duck_types(relation):
    return dict(zip(relation.columns, [str(d) for d in relation.types]))


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


def compare(spark, connection, function, sql, sf_dir):
    """List of differences; empty when rows, columns and types agree."""
    df = function(spark, sf_dir)
    got = bag([tuple(r) for r in df.collect()], df.columns)
    relation = connection.sql(sql)
    want = bag(relation.fetchall(), relation.columns)
    problems = []
    if sorted(df.columns) != sorted(relation.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(relation.columns)}")
    theirs = duck_types(connection.sql(sql))
    for name, dtype in df.dtypes:
        mine = _TYPES.get(dtype, dtype.upper())
        if theirs.get(name) not in (mine, None):
            problems.append(f"type of {name}: {mine} != {theirs.get(name)}")
    if got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"rows {sum(got.values())} != {sum(want.values())}; only spark {extra}; only sql {lost}")
    if not got:
        problems.append("no rows")
    return problems, sum(got.values())


def main():
    import __spark_entry__ as entry
    from tradewind.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                count = entry.queries()[name](spark, sf_dir).count()
                problems = [] if count else ["no rows"]
                note = f"{count} rows, no SQL"
            else:
                problems, count = compare(spark, connection, entry.queries()[name], sql, sf_dir)
                note = f"{count} rows"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {note} {time.time() - started:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
