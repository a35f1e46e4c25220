"""Compare a registered Spark query with its DuckDB oracle (the driver's
correctness gate, reproduced for local runs and tests).

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True) -> dict:
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    st = time.time() - t
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(st, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    res["duck_rows"] = len(drows)
    sc, sr = rows_of(scols, srows)
    dc, dr = rows_of(dcols, drows)
    res["cols_match"] = sc == dc
    res["values_match"] = sr == dr
    res["status"] = "ok" if (sc == dc and sr == dr) else "MISMATCH"
    if verbose and res["status"] != "ok":
        print(name, "spark cols", sc, "duck cols", dc)
        ss, ds = set(sr), set(dr)
        print("  only spark:", list(ss - ds)[:3])
        print("  only duck:", list(ds - ss)[:3])
    return res


def main(argv):
    from webloom.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    names = argv[2:] or sorted(E.queries())
    spark = get_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": repr(e)[:500]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
