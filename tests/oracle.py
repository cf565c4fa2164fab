"""Run registered queries next to their check SQL and compare every value."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    return repr(value)


def compare(spark, con, name: str, sf_dir: str, queries, checks) -> str:
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if name not in checks:
        return f"rows-only rows={len(got)} {t1 - t0:.1f}s"
    cur = con.execute(checks[name])
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    cols = sorted(df.columns)
    if cols != sorted(types):
        return f"COLUMNS {cols} vs {sorted(types)}"
    bad_types = [f"{c}:{t}" for c, t in types.items()
                 if t not in ("BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "BOOLEAN", "NUMBER", "STRING", "bool")]
    spark_types = dict(df.dtypes)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    bad_types += [f"{c}:{types[c]}!={spark_types[c]}" for c in cols if kinds.get(types[c], spark_types[c]) != spark_types[c]]
    order = [list(types).index(c) for c in cols]
    a = sorted(tuple(_cell(r[c]) for c in cols) for r in got)
    b = sorted(tuple(_cell(r[i]) for i in order) for r in want)
    times = f"spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if bad_types:
        return f"TYPES {bad_types} rows {len(a)}/{len(b)} {times}"
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)} {times} only-spark={[x for x in a[:2000] if x not in set(b)][:2]}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(diff)} differ {cols} e.g. {diff[0]} {times}"
    empty = " EMPTY" if not a else ""
    return f"ok rows={len(a)}{empty} {times}"


def main(argv):
    from cuespan.plans.catalog import CHECKS, QUERIES
    from cuespan.session import local_session

    sf_dir = "/root/testdata/" + (argv[0] if argv else "sf0.001")
    picks = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    failed = 0
    for name in QUERIES:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            result = compare(spark, con, name, sf_dir, QUERIES, CHECKS)
        except Exception as exc:  # noqa: BLE001 - report and go on
            result = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += not result.startswith(("ok", "rows-only"))
        print(f"{name:28s} {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
