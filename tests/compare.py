"""Run queries and their SQL side by side: ``python -m tests.compare [sf_dir] [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when names, types and all values agree, else what does not."""
    rel = con.sql(sql)
    types = {c: KINDS.get(t, t) for c, t in df.dtypes}
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if set(types) != set(theirs):
        return f"columns {sorted(set(types) ^ set(theirs))}"
    ours, other = _rows(df.columns, df.collect()), _rows(rel.columns, rel.fetchall())
    if not ours:
        return "no rows"
    wrong = {c: (types[c], theirs[c]) for c in types if types[c] != theirs[c]}
    if len(ours) != len(other):
        return f"rows {len(ours)} against {len(other)}; types {wrong}"
    bad = [(a, b) for a, b in zip(ours, other) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}; types {wrong}; {sorted(types)}"
    return f"types {wrong}" if wrong else None


def main() -> int:
    from cohortlens.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions=os.environ.get("PARTITIONS", "8"), spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                note = difference(df, con, sqls[name])
            else:
                note = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:600]}"
        failed += note is not None
        mark = "ok  " if note is None else "FAIL"
        kind = "sql " if name in sqls else "rows"
        print(f"{mark} {kind} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
