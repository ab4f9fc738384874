"""Compare registered queries with their SQL counterparts.

``python tests/oracle_check.py [sf] [name …]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/sf{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if hasattr(v, "tolist"):
            return repr(v.tolist())
        return None if v is None or v is pd.NA or v is pd.NaT else v

    rows = [tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark, con, sf: str, run, sql: str) -> str:
    got = run(spark, f"{ROOT}/sf{sf}").toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {str(bad[0])[:600]}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype]
    return f"ok {len(got)} rows" + (f" TYPES {kinds}" if kinds else "")


def main(argv: list[str]) -> None:
    from corpusdeck.session import build_session
    from workload.catalog import ORACLES, QUERIES

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        "oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                said = compare(spark, con, sf, QUERIES[name], ORACLES[name])
            else:
                said = f"rows only: {QUERIES[name](spark, f'{ROOT}/sf{sf}').count()}"
        except Exception as e:  # report and go on with the next query
            said = f"FAILED {type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {said} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
