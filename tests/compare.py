"""Run registered queries in Spark and their SQL in DuckDB and compare columns and rows, whatever their order.

    python -m tests.compare [-d SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _shown(rows) -> list[str]:
    def one(value):
        return f"{value:.9g}" if isinstance(value, float) else repr(value)

    return sorted("|".join(map(one, row)) for row in rows)


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    columns = sorted(result.columns)
    rows = _shown(result.select(*columns).collect())
    expected = connection.execute(sql)
    names = [column[0] for column in expected.description]
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    order = [names.index(column) for column in columns]
    wanted = _shown([row[n] for n in order] for row in expected.fetchall())
    if rows == wanted:
        return [] if rows else ["no rows"]
    more, less = sorted(set(rows) - set(wanted)), sorted(set(wanted) - set(rows))
    return [f"{len(rows)} rows != {len(wanted)}", *(f"+ {r[:600]}" for r in more[:2]), *(f"- {r[:600]}" for r in less[:2])]


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, oracles = connect(options.d), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in options.names or queries:
        started = time.time()
        try:
            found = differences(queries[name](spark, options.d), connection, oracles[name]) if name in oracles else ["no oracle"]
        except Exception as error:
            found = [str(error)[:1500]]
        bad += bool(found) and found != ["no oracle"]
        print(f"{'ok ' if not found else '-- '} {name:30} {time.time() - started:6.1f} s", *found, sep="\n      ", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
