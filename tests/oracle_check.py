"""Compares registered queries with their oracle SQL. Usage: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when columns, rows and values agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    got_names = df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} vs {sorted(names)}"
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=_key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(r[i] for i in at) for r in want_rows), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {order}: {bad[:2]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tallymart.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="12g",
                          spark_ui_showConsoleProgress="false")
    # results must not depend on the zone of the session that runs the query
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = oracle_connection(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else None
            note = "ok" if name in oracles else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - reported below
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += problem is not None
        print(f"{name:28s} {time.time() - t0:6.2f}s {note if problem is None else 'FAIL ' + problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
