"""Run registered queries against their oracle SQL: python check_oracle.py [name-prefix ...]"""
import datetime
import sys
import time

import duckdb
import pandas as pd

from panelyard.registry import load_all
from panelyard.session import get_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and df[c].map(lambda v: isinstance(v, datetime.date)).any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        if str(df[c].dtype) in ("Int32", "Int64") and df[c].isna().any():
            df[c] = df[c].astype("float64")
        if str(df[c].dtype).startswith(("datetime", "timestamp")):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v))
    keys = [df[c].map(lambda v: "" if v is None or v != v else (f"{v:.6g}" if isinstance(v, float) else str(v))) for c in df.columns]
    order = pd.concat(keys, axis=1).apply(lambda r: "\x01".join(r), axis=1).argsort(kind="stable") if len(df) else []
    return df.iloc[order].reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"COLUMNS {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}"
    if len(a) == 0:
        return "EMPTY"
    a, b = normal(a), normal(b)
    notes = []
    for c in a.columns:
        x, y = a[c], b[c]
        if str(x.dtype) != str(y.dtype):
            notes.append(f"dtype {c}: {x.dtype} vs {y.dtype}")
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            n = int((~same).sum())
            if pd.api.types.is_float_dtype(x) and pd.api.types.is_float_dtype(y):
                close = ((x - y).abs() <= 2e-8 * y.abs().clip(lower=1)) | (x.isna() & y.isna())
                notes.append(f"{'VALUES' if not close.all() else 'ulps'} {c}: {n} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}")
            else:
                notes.append(f"VALUES {c}: {n} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}")
    return "; ".join(notes)[:900] or "ok"


def main(prefixes: list[str], path: str = "/root/testdata/sf0.01") -> int:
    spark = get_spark("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = q(spark, path).toPandas()
        except Exception as e:
            print(f"{name:36s} SPARK ERROR {str(e)[:700]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if q.oracle is None:
            print(f"{name:36s} rows-only {len(got)} {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(q.oracle).df()
        except Exception as e:
            print(f"{name:36s} SQL ERROR {str(e)[:700]}", flush=True)
            bad += 1
            continue
        verdict = compare(got, want)
        bad += verdict != "ok"
        print(f"{name:36s} {verdict} [{len(got)} rows, spark {t1 - t0:.1f}s, duck {time.time() - t1:.1f}s]", flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
