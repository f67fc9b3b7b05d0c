"""Run named queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH with a reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from deskflow.sources.tables import TABLES, table_path  # noqa: E402

def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (pd.Timestamp,)):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except Exception:
        pass
    return v


def _kind(dtype) -> str:
    s = str(dtype).lower()
    if "int" in s:
        return "int"
    if "float" in s or "double" in s:
        return "float"
    if "bool" in s:
        return "bool"
    if "datetime" in s:
        return "ts"
    return "obj"


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "float": "FLOAT"}


def schema_diff(spark_types: list[tuple[str, str]], duck_names: list[str], duck_types: list[str]) -> list[str]:
    d = dict(zip(duck_names, duck_types))
    out = []
    for n, t in spark_types:
        want = SPARK_TO_DUCK.get(t)
        got = d.get(n)
        if want is not None and got is not None and want != got:
            out.append(f"{n}: spark {t} vs duck {got}")
    return out


def compare(sdf: pd.DataFrame, odf: pd.DataFrame) -> str | None:
    if sorted(sdf.columns) != sorted(odf.columns):
        return f"columns differ: spark={sorted(sdf.columns)} oracle={sorted(odf.columns)}"
    cols = sorted(sdf.columns)
    if len(sdf) != len(odf):
        return f"row count spark={len(sdf)} oracle={len(odf)}"
    kinds = []
    for c in cols:
        ks, ko = _kind(sdf[c].dtype), _kind(odf[c].dtype)
        if {ks, ko} == {"int", "float"} and (sdf[c].isna().any() or odf[c].isna().any()):
            continue  # whole numbers with nulls: pandas has them as floats from one side only
        if ks != ko and not (len(sdf) and (sdf[c].isna().all() or odf[c].isna().all())):
            kinds.append(f"{c}: {sdf[c].dtype} vs {odf[c].dtype}")
    rs = sorted((tuple(_norm(v) for v in r) for r in sdf[cols].itertuples(index=False)), key=repr)
    ro = sorted((tuple(_norm(v) for v in r) for r in odf[cols].itertuples(index=False)), key=repr)
    for a, b in zip(rs, ro):
        if a != b:
            return f"row differs:\n  spark ={a}\n  oracle={b}\n  cols={cols}" + (f"\n  types: {kinds}" if kinds else "")
    if kinds:
        return "types differ: " + "; ".join(kinds)
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from deskflow.plans import oracle_sql, queries
    from deskflow.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, os_ = queries(), oracle_sql()
    con = duck_connect(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        if name not in os_:
            print(f"{name:32s} (no oracle)")
            continue
        t0 = time.time()
        try:
            sq = qs[name](spark, sf_dir)
            sdf = sq.toPandas()
            t1 = time.time()
            rel = con.sql(os_[name])
            odf = rel.df()
            t2 = time.time()
            err = compare(sdf, odf)
            sd = schema_diff(sq.dtypes, rel.columns, [str(t) for t in rel.types])
            if sd and not err:
                err = "schema: " + "; ".join(sd)
        except Exception as e:  # noqa: BLE001
            err, t1, t2 = f"ERROR {type(e).__name__}: {str(e)[:600]}", time.time(), time.time()
        if err:
            bad += 1
        print(f"{name:32s} {'OK' if not err else 'MISMATCH'} rows={len(sdf) if not err or 'row' in err else '?'} "
              f"spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s" + (f"\n   {err}" if err else ""), flush=True)
    print(f"{bad} mismatches")


if __name__ == "__main__":
    main(sys.argv)
