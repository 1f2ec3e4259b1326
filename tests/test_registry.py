"""Every query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry

QUICK = [
    "trades_window", "parse_side", "parse_trade", "tape_validation", "ohlcv_15m", "order_bubbles", "vp_value_area", "vp_regions", "watch_zones", "balance_state", "event_rolling", "event_features", "sequence_labels", "regime_transition",
    "audit_dups", "audit_segments", "gap_stats", "fwd_returns", "iqr_outliers", "order_flow", "ohlcv_stream", "perf_metrics", "bt_vectorized", "p1_found", "p3_found", "p3_grid", "p5_found",
]


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    for n in range(1, 7):
        assert any(k.startswith(f"p{n}_") for k in q)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    key = lambda r: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in r)
    a = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    b = sorted((tuple(r[cols.index(c)] for c in order) for r in cur.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9))
