"""Local stand-in for the correctness gate: Spark query vs DuckDB oracle.

Compares row count, column names and the order-insensitive multiset of rows
(columns sorted by name, as the driver does).
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

from contactlake.sources.tables import TABLES, table_path


def run_oracle(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con.execute(sql).df()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):            # numpy scalar
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, Counter(tuple(_norm(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark_pdf, oracle_pdf, show: int = 5) -> dict:
    sc, sr = _rows(spark_pdf)
    oc, orows = _rows(oracle_pdf)
    res = {"rows_spark": int(sum(sr.values())), "rows_oracle": int(sum(orows.values())),
           "cols_match": sc == oc, "values_match": sr == orows and sc == oc}
    if not res["values_match"]:
        res["only_spark"] = list((sr - orows).elements())[:show]
        res["only_oracle"] = list((orows - sr).elements())[:show]
        res["spark_cols"], res["oracle_cols"] = sc, oc
    return res


def check(spark, names=None, sf_dir: str = "/root/testdata/sf0.01", verbose: bool = True) -> dict:
    from contactlake.plans.oracle import ORACLE
    from contactlake.plans.queries import REGISTRY
    out = {}
    for name in names or sorted(REGISTRY):
        t0 = time.time()
        try:
            spdf = REGISTRY[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in ORACLE:
                res = compare(spdf, run_oracle(ORACLE[name], sf_dir))
            else:
                res = {"rows_spark": len(spdf), "oracle": "none"}
            res["spark_sec"] = round(t1 - t0, 2)
        except Exception as e:  # report and go on with the next query
            res = {"error": f"{type(e).__name__}: {str(e)[:800]}"}
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


if __name__ == "__main__":
    from contactlake import get_spark
    spark = get_spark("local[8]", 8)
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    r = check(spark, args or None, sf)
    bad = [k for k, v in r.items() if not v.get("values_match", v.get("oracle") == "none")]
    print("FAILED:", bad)
