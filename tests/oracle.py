"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tolist"):
        return tuple(map(plain, v.tolist()))
    if hasattr(v, "is_integer") or v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def as_numbers(rows):
    """1 and 1.0 alike."""
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    (n1, r1), (n2, r2) = spark_rows(df), duck_rows(sql, sf_dir)
    if n1 != n2:
        return f"columns {n1} and {n2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows and {len(r2)}; first {r1[:2]} and {r2[:2]}"
    r1, r2 = as_numbers(r1), as_numbers(r2)
    for a, b in zip(r1, r2):
        for x, y in zip(a, b):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)):
                return f"{a} and {b}"
    return None
