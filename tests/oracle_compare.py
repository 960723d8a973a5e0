"""Spark result vs DuckDB oracle: row count, column names and types,
order-insensitive values (the driver's gate, reproduced strictly)."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import types as T

from tally.sources.tables import FIXTURE_TABLES

_SPARK_KIND = {
    T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int32", T.LongType: "int64",
    T.FloatType: "float", T.DoubleType: "float", T.StringType: "str", T.BooleanType: "bool",
}
_DUCK_KIND = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int32", "BIGINT": "int64",
    "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in FIXTURE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    return str(v) if not isinstance(v, (str,)) else v


def compare(df, sql: str, con) -> list[str]:
    problems = []
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = [str(t) for t in rel.types]
    drows = rel.fetchall()
    scols = df.columns
    skinds = {f.name: _SPARK_KIND.get(type(f.dataType), type(f.dataType).__name__) for f in df.schema.fields}
    if sorted(scols) != sorted(dcols):
        return [f"columns differ: spark={sorted(scols)} oracle={sorted(dcols)}"]
    for n, t in zip(dcols, dtypes):
        dk = _DUCK_KIND.get(t, t)
        if skinds[n] != dk:
            problems.append(f"type of {n}: spark={skinds[n]} oracle={t}")
    srows = [tuple(_norm(r[c]) for c in sorted(scols)) for r in df.collect()]
    idx = [dcols.index(c) for c in sorted(dcols)]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows]
    if len(srows) != len(drows):
        problems.append(f"row count: spark={len(srows)} oracle={len(drows)}")
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
    if s_sorted != d_sorted:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
        sset, dset = set(srows), set(drows)
        problems.append(
            f"values differ ({len(sset - dset)} spark-only, {len(dset - sset)} oracle-only); first: {diff}; "
            f"spark-only sample {list(sset - dset)[:2]} oracle-only sample {list(dset - sset)[:2]}"
        )
    return problems
