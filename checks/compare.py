"""Run registered queries against their SQL in DuckDB: python -m checks.compare FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
            )
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def difference(spark_frame, connection, sql: str) -> str | None:
    """What differs between a query's rows and its SQL's rows, or nothing."""
    ours = spark_frame.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    left, right = _rows(spark_frame.columns, ours), _rows(names, theirs)
    unequal = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    if unequal:
        return f"{len(unequal)} rows differ, first {unequal[0][0]} / {unequal[0][1]}"[:900]
    return None


def main(folder: str, names: list[str]) -> int:
    from checks import audits, explore, learn, retrieve, scans  # noqa: F401
    from checks.registry import ORACLES, QUERIES
    from meterlight.session import local_session

    spark = local_session()
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = difference(frame, database(folder), ORACLES[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # report every failing query, then go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{name:30} {kind} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{failures} failing")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
