"""Run registered queries on Spark and their oracles on DuckDB, and compare the rows.

    python -m checks.compare [--sf 0.01] [--only prefix ...]
"""

from __future__ import annotations

import argparse
import math
import signal
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks import ORACLES, QUERIES
from feedframe import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, float]:
    """Whether a query matches its oracle, a note, and the seconds Spark took."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in ORACLES:
        return True, f"{len(rows)} rows, no oracle", seconds
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} but oracle {sorted(columns)}", seconds
    ours, theirs = _bag(df.columns, rows), _bag(columns, expected)
    if ours != theirs:
        extra, missing = list((ours - theirs).items()), list((theirs - ours).items())
        return False, f"{len(rows)} vs {len(expected)} rows; ours only {str(extra[:2])[:400]}; oracle only {str(missing[:2])[:400]}", seconds
    return True, f"{len(rows)} rows", seconds


def _late(*_):
    raise TimeoutError


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--only", nargs="*", default=[])
    args.add_argument("--limit", type=int, default=60, help="seconds per query")
    options = args.parse_args()
    sf_dir = f"{Path('/root/testdata')}/sf{options.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    signal.signal(signal.SIGALRM, _late)
    for name in QUERIES:
        if options.only and not name.startswith(tuple(options.only)):
            continue
        signal.alarm(options.limit)
        try:
            good, note, seconds = compare(spark, con, name, sf_dir)
        except TimeoutError:
            spark.sparkContext.cancelAllJobs()
            good, note, seconds = False, f"over {options.limit} s", float(options.limit)
        except Exception as error:  # report and go on
            good, note, seconds = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        signal.alarm(0)
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:34s} {seconds:6.2f}s {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
