"""Compare a Spark result with the DuckDB result of its SQL equivalent."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return v + 0.0 if v else 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def kind(v):
    return {bool: "b", int: "i", float: "f", str: "s"}.get(type(v), type(v).__name__)


def difference(spark_df, con, sql):
    """None if equal, else a short description."""
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {got_cols}: spark {str(bad[0][0])[:400]} sql {str(bad[0][1])[:400]}"
    for i, c in enumerate(got_cols):
        ka = {kind(r[i]) for r in got if r[i] is not None}
        kb = {kind(r[i]) for r in want if r[i] is not None}
        if ka != kb:
            return f"type of {c}: {ka} != {kb}"
    return None
