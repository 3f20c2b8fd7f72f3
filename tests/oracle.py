"""Compare registered queries with their SQL on the same tables. `python tests/oracle.py [sf] [names...]`."""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(con, spark_df, sql: str) -> tuple[bool, str]:
    got_cols = spark_df.columns
    got = canonical([tuple(r) for r in spark_df.collect()], got_cols)
    ran = con.execute(sql)
    want_cols = [d[0] for d in ran.description]
    want = canonical(ran.fetchall(), want_cols)
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; {sorted(got_cols)}; first: {bad[0]}"
    return True, f"{len(got)} rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tapeline.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(sf), oracle_sql(), []
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf)
            if name in sqls:
                mid = time.time()
                ok, note = compare(con, df, sqls[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as error:   # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:<32} {time.time() - start:6.1f}s  {note}", flush=True)
        failed += [] if ok else [name]
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
