"""Run registered queries on Spark and their DuckDB oracle SQL side by side.

usage: python scripts/oracle_check.py [sf_dir] [name-substring ...]
Compares column names, row counts and row multisets (floats to 9 significant
digits, and exactly) and prints one line per query.
"""

import math
import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

import duckdb  # noqa: E402

from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v, exact):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if exact else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, exact) for x in v)
    if hasattr(v, "item"):
        return norm(v.item(), exact)
    return v


def rows_of(records, cols, exact):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], exact) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, q in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.oracle is None:
            print(f"ROWS-ONLY  {name}: rows={len(s_rows)} ({ts:.1f}s)")
            continue
        try:
            res = con.execute(q.oracle)
            d_cols = [c[0] for c in res.description]
            d_rows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {name}: {str(e)[:400]}")
            bad += 1
            continue
        dtypes = {c: t for c, t in df.dtypes}
        d_types = {c[0]: str(c[1]) for c in res.description}
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
        tdiff = [(c, dtypes[c], d_types.get(c)) for c in s_cols
                 if c in d_types and tmap.get(dtypes[c], dtypes[c]).upper() != d_types[c].upper()]
        if tdiff:
            print(f"TYPES      {name}: {tdiff}")
        if sorted(s_cols) != sorted(d_cols):
            print(f"COLS       {name}: spark={s_cols} duck={d_cols}")
            bad += 1
            continue
        a, b = rows_of(s_rows, s_cols, True), rows_of(d_rows, d_cols, True)
        if a == b:
            print(f"OK         {name}: rows={len(a)} ({ts:.1f}s)")
            continue
        a2, b2 = rows_of(s_rows, s_cols, False), rows_of(d_rows, d_cols, False)
        tag = "APPROX" if a2 == b2 else "DIFF"
        bad += tag == "DIFF"
        print(f"{tag:10} {name}: spark_rows={len(a)} duck_rows={len(b)} cols={sorted(s_cols)}")
        if tag == "DIFF":
            sa, sb = set(a2), set(b2)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck: ", list(sb - sa)[:3])
    print("bad:", bad)


if __name__ == "__main__":
    main()
