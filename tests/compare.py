"""Runs registered queries against their SQL checks and reports the differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple(map(repr, r)))


def differences(frame, connection, sql: str) -> list[str]:
    """Empty if names, rows and values are equal."""
    got_names, got = _ordered(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    names, want = _ordered([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != names:
        return [f"columns differ: {sorted(set(got_names) ^ set(names))}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    found = [
        f"{[(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]}"
        for a, b in zip(got, want)
        if a != b or [type(x) for x in a] != [type(y) for y in b]
    ]
    return [f"{len(found)} rows differ", *found[:3]] if found else []


def main(folder: str, only: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls = duck(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            if name in sqls:
                found = differences(frame, connection, sqls[name])
                rows = "checked"
            else:
                found, rows = [], f"{len(frame.collect())} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            found, rows = [str(error)[:600]], ""
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name:32s} {time.time() - start:6.2f}s {rows}",
              *found, sep="\n      " if found else " ", flush=True)
    print("unmatched SQL:", sorted(set(sqls) - set(entry.queries())), "bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
