"""Run every registered query and its DuckDB oracle side by side (as the driver does).

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from spanlab.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return norm(list(v.values()))
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = E.queries(), E.oracle_sql()
    results = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "spark_error", "err": str(e)[:600]}
            print(name, "SPARK ERROR", str(e)[:600], flush=True)
            continue
        ts = time.time() - t0
        if name not in ors:
            results[name] = {"status": "rows_only", "rows": len(srows), "sec": round(ts, 2)}
            print(f"{name}: rows-only {len(srows)} rows {ts:.1f}s", flush=True)
            continue
        t1 = time.time()
        try:
            rel = con.execute(ors[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "oracle_error", "err": str(e)[:600]}
            print(name, "ORACLE ERROR", str(e)[:600], flush=True)
            continue
        td = time.time() - t1
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = sorted(canon(scols, srows)), sorted(canon(dcols, drows))
        ok = ok_cols and a == b
        results[name] = {"status": "match" if ok else "MISMATCH", "rows": [len(srows), len(drows)]}
        print(f"{name}: {'match' if ok else 'MISMATCH'} rows spark={len(srows)} duck={len(drows)} cols_ok={ok_cols} {ts:.1f}s/{td:.1f}s", flush=True)
        if not ok:
            if not ok_cols:
                print("   spark cols", scols, "\n   duck cols", dcols)
            else:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:3])
                print("   only duck :", list(sb - sa)[:3])
    print(json.dumps({k: v["status"] for k, v in results.items()}))


if __name__ == "__main__":
    main()
