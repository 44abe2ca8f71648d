"""Run registered queries in Spark and their SQL in DuckDB, and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from catalog import ORACLES, QUERIES
from catalog.views import TABLES

TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, sf_dir: str, name: str, connection=None) -> list[str]:
    frame = QUERIES[name](spark, sf_dir)
    got = frame.collect()
    if name not in ORACLES:
        return [] if got else ["no rows"]
    result = (connection or duck(sf_dir)).execute(ORACLES[name])
    columns = [(d[0], str(d[1])) for d in result.description]
    wanted = result.fetchall()
    found = []
    spark_types = sorted((f.name, f.dataType.simpleString()) for f in frame.schema.fields)
    duck_types = sorted((n, TYPES.get(t, t)) for n, t in columns)
    if spark_types != duck_types:
        found.append(f"schema {set(spark_types) ^ set(duck_types)}")
    if [n for n, _ in spark_types] == [n for n, _ in duck_types]:
        a, b = _rows(frame.columns, got), _rows([n for n, _ in columns], wanted)
        if len(a) != len(b):
            found.append(f"rows {len(a)} != {len(b)}")
        elif a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            found.append(f"{len(bad)} of {len(a)} rows differ, first {str(bad[0])[:600]}")
        if not a:
            found.append("no rows")
    return found


def main(argv: list[str]) -> int:
    from sievelight.session import local_session

    sf_dir = argv[0]
    names = argv[1:] or sorted(QUERIES)
    spark, connection, failed = local_session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, sf_dir, name, connection)
        except Exception as error:  # report and go on with the other queries
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {'; '.join(found)}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
