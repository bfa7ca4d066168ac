"""Run registered queries on Spark and DuckDB and compare the results.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f'create view "{name}" as select * from read_parquet(\'{path}\')')
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql) -> list[str]:
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    theirs = _table(theirs_names, found.fetchall())
    ours = _table(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} <> {theirs[0]}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: {kind} <> {kinds[name]}")
    if len(ours[1]) != len(theirs[1]):
        out.append(f"rows {len(ours[1])} <> {len(theirs[1])}")
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if wrong:
        a, b = wrong[0]
        out.append(f"{len(wrong)} rows differ, e.g. {[(n, x[:80], y[:80]) for n, x, y in zip(ours[0], a, b) if x != y]}")
    return out


def main(argv):
    import __spark_entry__ as entry
    from answerscope.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        t = time.time()
        try:
            problems = differences(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ':4}{name:24}{time.time() - t:6.1f}s", *problems, sep="  ", flush=True)
    print(f"{bad} of {len(argv[1:] or queries)} differ; without SQL: {sorted(set(queries) - set(oracles))}")


if __name__ == "__main__":
    main(sys.argv[1:])
