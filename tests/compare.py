"""Run named queries against their SQL in DuckDB and compare whole results.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def as_rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {df.columns} against {relation.columns}"
    ours, theirs = as_rows(df.columns, df.collect()), as_rows(relation.columns, relation.fetchall())
    if ours == theirs:
        return None
    extra, lacking = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; extra {str(extra[:3])[:300]}, lacking {str(lacking[:3])[:300]}"


def main() -> None:
    import __spark_entry__ as contract
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    sql = contract.oracle_sql()
    wanted = sys.argv[2:] or list(contract.queries())
    bad = 0
    for name in wanted:
        start = time.time()
        df = contract.queries()[name](spark, sf_dir)
        rows = df.cache().count()
        seconds = time.time() - start
        verdict = (difference(df, con, sql[name]) or "equal") if name in sql else "no SQL"
        df.unpersist()
        bad += verdict != "equal" and name in sql
        print(f"{name:28s} {seconds:6.2f}s {rows:8d} rows  {verdict}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
