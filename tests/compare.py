"""Run registered queries in Spark and in DuckDB and compare rows.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def compare(spark, db, folder: str, query, sql: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    got = frame.select(*columns).toArrow()
    cursor = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
    want = cursor.to_arrow_table() if hasattr(cursor, "to_arrow_table") else cursor.fetch_arrow_table()
    kind = lambda t: str(t).replace("large_", "")
    for a, b in zip(got.schema, want.schema):
        if kind(a.type) != kind(b.type):
            return f"type of {a.name}: {a.type} and {b.type}"
    left = Counter(zip(*[c.to_pylist() for c in got.columns]))
    right = Counter(zip(*[c.to_pylist() for c in want.columns]))
    if left == right:
        return None
    return (
        f"{got.num_rows} and {want.num_rows} rows; "
        f"only Spark: {list((left - right).elements())[:2]}; "
        f"only SQL: {list((right - left).elements())[:2]}"
    )


def main() -> None:
    from sheaf.plans.oracles import ORACLES
    from sheaf.plans.queries import QUERIES
    from sheaf.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, db, folder, QUERIES[name], ORACLES[name])
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {'ok' if result is None else result} ({time.time() - start:.1f}s)", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
