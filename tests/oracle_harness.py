"""Spark result versus DuckDB oracle, the way the driver compares them.

Row count, column names and types, and an order-insensitive hash of the
values (floats rounded to 6 decimals).  Usable from pytest and as a script:

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if v is None:
        return "null"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    digests = sorted(hashlib.md5("|".join(_norm(r[i]) for i in order).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(digests).encode()).hexdigest()


def same_type(spark_type: str, duck_type: str) -> bool:
    """The same kind of value on both sides; DuckDB's sums of integers are wider."""
    kinds = {"string": "VARCHAR", "boolean": "BOOLEAN"}
    whole = ("tinyint", "smallint", "int", "bigint")
    if spark_type in kinds:
        return duck_type == kinds[spark_type]
    if spark_type in whole:
        return duck_type in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UBIGINT", "UINTEGER")
    if spark_type in ("float", "double"):
        return duck_type in ("FLOAT", "DOUBLE") or duck_type.startswith("DECIMAL")
    if spark_type.startswith("array<"):
        return duck_type.endswith("[]") and same_type(spark_type[6:-1], duck_type[:-2])
    return True


def compare(spark, name: str, sf_dir: str) -> dict:
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        out["oracle"] = "none"
        return out
    res = duck(sf_dir).sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    out["duck_sec"] = round(time.time() - t1, 2)
    out["duck_rows"] = len(drows)
    scols = df.columns
    out["cols_match"] = sorted(scols) == sorted(dcols)
    if not out["cols_match"]:
        out["cols"] = (sorted(scols), sorted(dcols))
    out["types"] = ({c: t for c, t in df.dtypes}, dict(zip(dcols, [str(t) for t in res.types])))
    out["types_match"] = out["cols_match"] and all(same_type(t, out["types"][1][c]) for c, t in out["types"][0].items())
    out["hash_match"] = out["cols_match"] and _hash(rows, scols) == _hash(drows, dcols)
    if not out["hash_match"] and out["cols_match"]:
        sset = {"|".join(_norm(r[i]) for i in sorted(range(len(scols)), key=lambda i: scols[i])) for r in rows}
        dset = {"|".join(_norm(r[i]) for i in sorted(range(len(dcols)), key=lambda i: dcols[i])) for r in drows}
        out["only_spark"] = [x[:300] for x in list(sset - dset)[:3]]
        out["only_duck"] = [x[:300] for x in list(dset - sset)[:3]]
    return out


if __name__ == "__main__":
    from glossa.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("HARNESS_PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session(shuffle_partitions=8)
    from __spark_entry__ import queries

    for n in names or list(queries()):
        try:
            r = compare(spark, n, sf)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:800]}
        ok = r.get("hash_match") and r.get("types_match") or r.get("oracle") == "none"
        print(("OK  " if ok else "BAD ") + str({k: v for k, v in r.items() if k != "types" or not ok}), flush=True)
