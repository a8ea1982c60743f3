"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bitledger import catalog  # noqa: E402
from bitledger.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def sort_key(row):
    return tuple((v is not None, str(v)) for v in row)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when both sides agree."""
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=sort_key)
    if name not in catalog.ORACLE:
        return "" if got else "no rows"
    result = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in order) for r in result.fetchall()), key=sort_key)
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in columns if TYPES.get(types[c], types[c]) != spark_types[c]}
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference\n   spark  {str(a)[:600]}\n   oracle {str(b)[:600]}"
    if odd:
        return f"types {odd}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = []
    for name in args.names or catalog.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:6.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    raise SystemExit(main())
