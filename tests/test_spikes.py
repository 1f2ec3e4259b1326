import numpy as np
import pandas as pd

from tapewright.operators.spikes import find_implausible

COLS = ["reading_id", "source", "ts", "price", "delta", "pressure", "buy_volume", "sell_volume", "arrived_at", "volume"]


def readings(n=3000, seed=3):
    r = np.random.default_rng(seed)
    p = 100 + np.cumsum(r.normal(0, 0.05, n))
    p[1500:] += 8  # a move that lasts
    d = pd.DataFrame({"reading_id": np.arange(n), "source": "a", "ts": 1_700_000_000_000 + np.cumsum(r.integers(1, 60_000, n)), "price": p, "delta": r.normal(0, 1, n), "pressure": np.clip(r.normal(0, 0.1, n), -1, 1), "buy_volume": 500.0, "sell_volume": 500.0})
    d["arrived_at"] = pd.to_datetime(d["ts"], unit="ms")
    d["volume"] = "clash"
    return d


def found(spark, d, **kw):
    rows = find_implausible(spark.createDataFrame(d[COLS]), **kw).collect()
    return {(r["reading_id"], r["field"], r["kind"]) for r in rows}


def planted():
    d = readings()
    truth = set()
    for i, (f, v, k) in {100: ("price", 130.0, "spike"), 700: ("price", -3.0, "impossible"), 900: ("delta", 400.0, "spike"), 1000: ("delta", 5000.0, "impossible"), 1100: ("pressure", 1.5, "impossible"), 1200: ("price", np.inf, "impossible"), 1300: ("delta", np.nan, "impossible")}.items():
        d.loc[i, f] = v
        truth.add((i, f, k))
    d.loc[2000:2030, "price"] = d.loc[2000, "price"]
    truth |= {(i, "price", "stuck") for i in range(2001, 2031)}
    return d, truth


def test_planted_cases_whatever_the_shards(spark):
    d, truth = planted()
    d = pd.concat([d, d.iloc[[100, 5]].assign(arrived_at=d["arrived_at"].max())])
    # pandas' NaN arrives as NaN here, not as null: createDataFrame keeps it for doubles.
    whole = found(spark, d)
    assert whole == truth
    assert found(spark, d, shard_readings=400) == truth


def test_lasting_move_null_and_empty(spark):
    d = readings()
    assert found(spark, d) == set()
    df = spark.createDataFrame(d[COLS])
    from pyspark.sql import functions as F

    blank = df.withColumns({"price": F.lit(None).cast("double"), "delta": F.lit(None).cast("double"), "pressure": F.lit(None).cast("double"), "source": F.lit(None).cast("string")})
    assert find_implausible(blank).count() == 0
    assert find_implausible(df.limit(0)).count() == 0


def test_thresholds_follow_the_source(spark):
    """Other seeds, sources of other scale and tail: all planted spikes, and next to nothing else."""
    frames, truth = [], set()
    for k, seed in enumerate((11, 12, 13, 14, 15, 16)):
        r = np.random.default_rng(seed)
        d = readings(4000, seed)
        d["delta"] = (r.standard_t(5, 4000) * 10.0**k).clip(-13 * 10.0**k, 13 * 10.0**k)
        d["pressure"] /= 5
        d["price"] = np.round(d["price"] * 3.0**k, 2 - k // 2)
        d[["buy_volume", "sell_volume"]] = 1e9
        for i in r.choice(np.arange(100, 3900, 40), 12, replace=False):
            f = r.choice(["price", "delta", "pressure"])
            d.loc[i, f] += {"price": 8.0 * 3.0**k, "delta": 60 * 10.0**k, "pressure": -2.0 * d.loc[i, "pressure"] + 0.95}[f]
            if f != "pressure" or abs(d.loc[i, f]) <= 1:
                truth.add((int(i + 10**5 * k), f, "spike"))
        d["reading_id"] += 10**5 * k
        d["source"] = f"s{k}"
        frames.append(d)
    got = {x for x in found(spark, pd.concat(frames)) if x[2] == "spike"}
    assert truth <= got
    assert len(got - truth) <= 1
