"""Runs a registered query on Spark and its SQL on DuckDB and compares rows."""

import datetime
import decimal
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, float) and v != v:
        return None
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    plain = [tuple(_plain(row[j]) for j in order) for row in rows]
    return [columns[j] for j in order], sorted(plain, key=repr)


def compare(spark, con, name, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    ocols, want = normal([d[0] for d in res.description], res.fetchall())
    assert cols == ocols, (name, set(cols) ^ set(ocols))
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = {c: (a, b) for c, a, b in zip(cols, g, w) if a != b}
        raise AssertionError(f"{name}: {len(bad)} of {len(got)} rows differ, first {diff}")
    return len(got)
