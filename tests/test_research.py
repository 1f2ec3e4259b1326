import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapewright.functions.common import with_positions
from tapewright.functions.expanding import expanding_quantiles, kth_of_prefixes
from tapewright.functions.halo import over_shards, running
from tapewright.operators import features as X
from tapewright.operators.regime import duration_stats, tag_regime, transitions
from tapewright.sources.tape import feature_tape, trades_from_events


def test_positions_and_weights(spark):
    d = pd.DataFrame({"k": [None, "a", "a", "b"] * 50, "t": np.arange(200) % 37, "i": np.arange(200), "w": np.arange(200) % 5})
    got = with_positions(spark.createDataFrame(d, "k string, t long, i long, w long"), ["k"], ["t", "i"], F.floor(F.col("t") / 4), F.col("w")).toPandas()
    for _, g in got.groupby("k", dropna=False):
        g = g.sort_values(["t", "i"])
        assert g["_pos"].tolist() == list(range(len(g)))
        assert g["_before"].tolist() == (g["w"].cumsum() - g["w"]).tolist()


def test_shards_do_not_change_frames(spark, sf):
    tape = feature_tape(trades_from_events(spark, sf))
    a = X.event_windows(tape, locations=(200,)).orderBy("event_idx").toPandas()
    b = X.event_windows(tape, locations=(200,), shard_rows=230).orderBy("event_idx").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])
    p = a["price"]
    assert np.allclose(a["range_50"], p.rolling(50).max() - p.rolling(50).min(), equal_nan=True)
    assert np.allclose(a["rolling_low_200"], p.shift(1).rolling(200).min(), equal_nan=True)
    assert np.allclose(a["delta_20"], a["delta"].rolling(20).sum(), equal_nan=True)


def test_expanding_quantiles_against_pandas(spark):
    r = np.random.default_rng(0)
    d = pd.DataFrame({"symbol": np.where(np.arange(1500) % 3 == 0, None, "B"), "x": np.round(r.normal(0, 3, 1500), 1), "y": np.cumsum(r.normal(0.1, 1, 1500))})
    d["event_idx"] = d.groupby("symbol", dropna=False).cumcount()
    d.loc[::17, "x"] = np.nan
    d.loc[600:1200, "x"] = np.nan  # whole shards without a value
    wanted = {"q": ("x", 1 / 3, 40), "h": ("x", 0.9, 10), "z": ("y", 0.0, 1), "t": ("y", 2 / 3, 100), "o": ("y", 1.0, 1)}
    df = spark.createDataFrame(d, "symbol string, x double, y double, event_idx long")
    for shard_rows, bucket_rows in ((10_000, None), (130, 50), (90, 2)):
        got = expanding_quantiles(df, wanted, shard_rows=shard_rows, bucket_rows=bucket_rows).toPandas()
        assert len(got) == len(d)
        for _, g in got.sort_values("event_idx").groupby("symbol", dropna=False):
            for name, (c, q, m) in wanted.items():
                assert np.allclose(g[c].shift(1).expanding(min_periods=m).quantile(q), g[name].astype(float), equal_nan=True), (name, shard_rows)
    assert expanding_quantiles(df.limit(0), wanted).count() == 0


def test_kth_of_prefixes():
    r = np.random.default_rng(5)
    a = r.integers(0, 70, 400)
    n = r.integers(1, 401, 900)
    k = (r.random(900) * n).astype(int)
    assert np.array_equal(kth_of_prefixes(a, n, k), [np.sort(a[:m])[j] for m, j in zip(n, k)])


def test_no_look_ahead(spark, sf):
    tape = feature_tape(trades_from_events(spark, sf))
    cut = tape.orderBy("timestamp", "seq").limit(600)
    cols = ["seq", "pressure_50", "speed_50", "range_50", "location_bin"]
    whole, part = (X.event_windows(t, targets=False).select(*cols).orderBy("seq").toPandas() for t in (tape, cut))
    pd.testing.assert_frame_equal(whole.head(600), part)


def test_runs_and_transitions(spark):
    rows = [("S", i, i, s) for i, s in enumerate("aabbbab")]
    d = spark.createDataFrame(rows, "symbol string, seq long, timestamp long, regime string")
    got = {r["regime"]: (r["count"], r["mean"], r["max"]) for r in duration_stats(d).collect()}
    assert got == {"a": (2, 1.5, 2), "b": (2, 2.0, 3)}
    assert {(r["from_state"], r["to_state"]): r["n"] for r in transitions(d).collect()} == {("a", "a"): 1, ("a", "b"): 2, ("b", "b"): 2, ("b", "a"): 1}


def test_tags_with_missing_bins(spark):
    d = spark.createDataFrame([("high", "fast", 0), (None, "fast", 0), ("low", "slow", 1)], "pressure_bin string, speed_bin string, absorption_flag int")
    assert [(r["direction"], r["regime"]) for r in tag_regime(d).collect()] == [("up", "trend"), ("none", "neutral"), ("down", "conflict")]


def test_over_shards_empty(spark):
    empty = spark.createDataFrame([], "symbol string, seq long, timestamp long")
    assert over_shards(empty, lambda d, w: d.withColumn("x", F.lag("seq").over(w)), 1, 1).count() == 0


def test_running_sums_and_maxima(spark):
    r = np.random.default_rng(8)
    d = pd.DataFrame({"symbol": np.where(np.arange(500) % 4 == 0, None, "B"), "t": np.arange(500), "x": r.integers(-5, 6, 500).astype(float)})
    d.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(d, "symbol string, t long, x double").withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = running(df, {"s": F.col("x")}, {"m": F.col("x")}, order=("t",), width=20, shard_rows=33).toPandas()
    for _, g in got.sort_values("t").groupby("symbol", dropna=False):
        assert np.allclose(g["x"].fillna(0).cumsum()[g["x"].notna().cummax()], g["s"][g["x"].notna().cummax()])
        assert np.allclose(g["x"].cummax().ffill(), g["m"], equal_nan=True)
