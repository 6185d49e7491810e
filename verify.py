"""Run registered queries on Spark and their SQL twins on DuckDB and compare all rows.

usage: python verify.py [-s SF_DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass

import duckdb

from checks import ENTRIES
from revlens.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass
class Outcome:
    rows: int
    seconds: float
    problem: str | None
    compared: bool = True


def open_duck(folder: str):
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for table in TABLES.split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return duck


def _by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr), [columns[i] for i in order]


def check(spark, duck, name: str, folder: str) -> Outcome:
    began = time.time()
    frame = ENTRIES[name].run(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - began
    if ENTRIES[name].sql is None:
        return Outcome(len(got), seconds, None if got else "no rows", compared=False)
    result = duck.execute(ENTRIES[name].sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want, want_columns = _by_name(list(types), result.fetchall())
    have, have_columns = _by_name(frame.columns, got)
    problems = []
    if have_columns != want_columns:
        problems.append(f"columns {have_columns} against {want_columns}")
    odd = [(c, t, types.get(c)) for c, t in frame.dtypes if KINDS.get(t) != types.get(c)]
    if odd:
        problems.append(f"types {odd}")
    if have != want:
        extra, lacking = (sorted(set(a) - set(b), key=repr)[:3] for a, b in ((have, want), (want, have)))
        problems.append(f"{len(have)} rows against {len(want)}; only here {extra}; only there {lacking}"[:1500])
    if not got and not want:
        problems.append("no rows to compare")
    return Outcome(len(got), seconds, "; ".join(problems) or None)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", **quiet})
    spark.sparkContext.setLogLevel("OFF")
    duck = open_duck(args.sf_dir)
    failed = []
    for name in ENTRIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            outcome = check(spark, duck, name, args.sf_dir)
        except Exception as error:  # noqa: BLE001
            outcome = Outcome(0, 0.0, f"{type(error).__name__} {str(error)[:900]}")
        mark = "FAIL" if outcome.problem else "ok  " if outcome.compared else "rows"
        print(f"{mark} {name}: {outcome.rows} rows, {outcome.seconds:.2f}s {outcome.problem or ''}", flush=True)
        if outcome.problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
