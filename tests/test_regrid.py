import random

from tapewright.operators.regrid import regular_grid

SCHEMA = "symbol string, timeframe string, session_id string, timestamp_ms long, volume double, bucket_ms string"
SERIES = ["symbol", "timeframe", "session_id"]


def grid(spark, rows, **kw):
    return {(r["symbol"], r["bucket_ms"]): r for r in regular_grid(spark.createDataFrame(rows, SCHEMA), SERIES, "timeframe", "timestamp_ms", "volume", **kw).collect()}


def row(bar, v, sym="A", tf="1m", off=0, unit=1):
    ms = bar * 60_000 + off + 1_454_284_800_000
    return (sym, tf, "d", int(ms * unit) if unit >= 1 else ms // int(1 / unit), v, "clash")


def test_monotone_fill_gap_and_duplicates(spark):
    base = 1_454_284_800_000
    rows = [row(0, 1.0), row(1, 2.0), row(1, 2.0), row(1, 3.0, off=5), row(4, 8.0), row(5, 9.0), row(40, 1.0), row(41, None), row(42, float("nan"))]
    g = grid(spark, rows)
    at = lambda b: g["A", base + b * 60_000]
    assert len(g) == 41
    assert at(1)["value"] == 5.0 and at(1)["n_readings"] == 2
    assert 5.0 < at(2)["value"] < at(3)["value"] < 8.0 and at(2)["status"] == "filled"
    assert at(20)["status"] == "gap" and at(20)["value"] is None
    assert at(40)["status"] == "observed"


def test_units_and_shards_agree(spark):
    r = random.Random(2)
    rows = []
    for _ in range(500):
        b = r.randrange(0, 900)
        unit = r.choice([1, 1000, 1_000_000, 0.001])
        rows.append(row(b, r.random() * 10, sym=r.choice(["A", None]), off=0 if unit == 0.001 else r.randrange(0, 60_000), unit=unit))
    one, many = grid(spark, rows, shard_bars=100_000), grid(spark, rows, shard_bars=3)
    assert one.keys() == many.keys()
    for k in one:
        assert one[k]["status"] == many[k]["status"]
        a, b = one[k]["value"], many[k]["value"]
        assert (a is None and b is None) or abs(a - b) < 1e-9
    # Fills lie between their knots.
    for sym in ("A", None):
        seq = [one[k] for k in sorted((k for k in one if k[0] == sym), key=lambda k: k[1])]
        for i, x in enumerate(seq):
            if x["status"] == "filled":
                lo = next(y for y in reversed(seq[:i]) if y["status"] == "observed")["value"]
                hi = next(y for y in seq[i:] if y["status"] == "observed")["value"]
                assert min(lo, hi) - 1e-9 <= x["value"] <= max(lo, hi) + 1e-9


def test_empty_and_unreadable(spark):
    assert grid(spark, []) == {}
    assert grid(spark, [row(0, 1.0, tf="week"), row(0, 1.0, tf="0m"), ("A", "1m", "d", None, 1.0, "")]) == {}
