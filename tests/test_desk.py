import math

import pandas as pd

from tapewright.operators import audit as A
from tapewright.operators import backtest as B
from tapewright.operators.folds import Execution, RecentQuantile, SignalMachine, execution_trades, signal_stream, summarize_trades
from tapewright.operators.indicators import wilder_atr
from tapewright.streaming import live


def ev(i, price, pressure, side, regime="trend", location="high", absorbed=0, speed=1.0):
    return {"seq": i, "timestamp": i, "price": price, "speed_50": speed, "pressure_50": pressure, "pressure_bin": {"up": "high", "down": "low"}.get(side, "mid"), "absorption_flag": absorbed, "location_bin": location, "regime": regime}


def test_machine_visits_all_phases():
    m, got = SignalMachine(window=5), []
    feed = [ev(i, 100 + i, 0.1 + i / 100, "up", regime="neutral") for i in range(5)]  # warm: no context
    feed += [ev(5 + i, 110 + i, 0.3 + i / 100, "up") for i in range(4)]  # context, interaction, resolution, confirmed
    feed += [ev(9, 130.0, 0.9, "up", speed=50.0)]  # aggression
    feed += [ev(10, 131.0, 0.5, "up"), ev(11, 131.0, 0.5, "up", regime="neutral")]  # regime ends: exit
    for e in feed:
        got += m.step(e)
    assert [g["state"] for g in got[4:]] == ["IDLE", "CONTEXT", "INTERACTION", "RESOLUTION", "CONFIRMED", "IN_TRADE", "IN_TRADE", "IDLE"]
    assert got[9]["entry_signal"] == 1 and got[9]["entry_direction"] == "up" and got[11]["exit_signal"] == 1 and got[11]["in_trade"] == 0


def test_machine_loses_context():
    m = SignalMachine(window=5)
    m.step(ev(0, 1, 0.5, "up"))
    assert m.step(ev(1, 1, 0.5, "up", location="mid"))[0]["state"] == "IDLE"


def test_quantile_memory():
    q = RecentQuantile(3)
    for v in (5.0, 1.0, 2.0, 9.0):
        q.push(v)
    assert q.ready() and q.at(0.5) == 2.0 and math.isclose(q.at(0.75), 5.5)


def row(i, price, pressure=0.0, regime="trend", flow=0.0, before=None):
    return {"seq": i, "timestamp": i * 10, "price": price, "pressure_50": pressure, "regime": regime, "event_idx": i, "atr": 1.0, "atr_before": 1.0, "price_before": price if before is None else before, "delta_norm": flow, "threshold": 0.5}


def entered():
    x = Execution()
    for r in (row(0, 100.0, 0.9), row(1, 101.0), row(2, 99.4), row(3, 100.3, 0.9, flow=3.0, before=99.4)):
        assert x.step(r) == []
    assert x.pos and x.pos["level"] == 99.4 and x.pos["stop"] == 100.3 - 2.5
    return x


def test_entry_and_exit_reasons():
    assert entered().step(row(4, 99.0))[0]["exit_reason"] == "structure"
    assert entered().step(row(4, 97.0))[0]["exit_reason"] == "hard_stop"
    x = entered()
    assert x.step(row(4, 100.4, flow=-1.5)) == x.step(row(5, 100.4, flow=-1.5)) == []
    done = x.step(row(6, 97.0, flow=-1.5))[0]
    assert done["exit_reason"] == "flow" and math.isclose(done["pnl"], -3.3) and math.isclose(done["fee"], (100.3 + 97.0) * 0.0004)
    x = entered()
    x.step(row(4, 103.0))
    assert x.step(row(5, 100.9))[0]["exit_reason"] == "trailing"
    x = entered()
    for i in range(4, 9):
        assert x.step(row(i, 100.3)) == []
    assert x.step(row(9, 100.3))[0]["exit_reason"] == "no_follow_through"
    x = entered()
    end = x.finish()[0]
    assert end["exit_reason"] == "data_end" and end["exit_idx"] == 3


def test_folds_on_frames(spark):
    cols = "symbol string, seq long, timestamp long, price double, speed_50 double, pressure_50 double, pressure_bin string, absorption_flag int, location_bin string, regime string"
    rows = [(s, *[ev(i, 100.0 + i, 0.5, "up")[c] for c in ("seq", "timestamp", "price", "speed_50", "pressure_50", "pressure_bin", "absorption_flag", "location_bin", "regime")]) for s in ("A", "B", None) for i in range(30)]
    d = spark.createDataFrame(rows, cols)
    out = signal_stream(d, window=5).toPandas()
    assert len(out) == 90
    a, b = (out[out["symbol"] == s].drop(columns="symbol").reset_index(drop=True) for s in "AB")
    pd.testing.assert_frame_equal(a, b)
    assert signal_stream(d.limit(0)).count() == 0
    core = d.selectExpr("symbol", "seq", "timestamp", "price", "1.0D as delta", "pressure_50", "regime")
    none = execution_trades(core, atr_window=5, delta_window=5)
    assert none.count() == 0 and summarize_trades(none).first()["win_rate"] is None


def test_signal_machine_stream_equals_batch(spark, tmp_path):
    cols = "symbol string, seq long, timestamp long, price double, speed_50 double, pressure_50 double, pressure_bin string, absorption_flag int, location_bin string, regime string"
    import random

    r = random.Random(3)
    rows = [("A", i, i, 100 + r.random(), r.random(), r.uniform(-1, 1), r.choice(["high", "low", "mid"]), int(r.random() < 0.2), r.choice(["high", "low", "mid"]), r.choice(["trend", "trend", "neutral"])) for i in range(300)]
    d = spark.createDataFrame(rows, cols)
    path = str(tmp_path / "in")
    d.filter("seq < 150").coalesce(1).write.parquet(path)
    d.filter("seq >= 150").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_available(live.signal_machine_stream(stream, window=20), "sig").orderBy("seq").toPandas()
    want = signal_stream(d, window=20).orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_recorder_and_dispatch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    live.record(stream(), str(tmp_path / "out"), checkpoint=str(tmp_path / "c1")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    seen = []
    live.dispatch(stream(), [lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.count()))], checkpoint=str(tmp_path / "c2")).awaitTermination()
    assert seen == [("a", 10), ("b", 10)]


def bars(spark, closes):
    return spark.createDataFrame([("S", i, i, float(c)) for i, c in enumerate(closes)], "symbol string, seq long, timestamp long, close double")


def test_vectorized_backtest_and_metrics(spark):
    from pyspark.sql import functions as F

    closes = [100.0, 110.0, 99.0, 99.0, 120.0]
    c = B.vectorized_backtest(bars(spark, closes), F.lit(1.0)).orderBy("event_idx").toPandas()
    assert c["equity"].iloc[0] == 100_000 and math.isnan(c["equity"].iloc[1]) and math.isclose(c["equity"].iloc[4], 100_000 * 120 / 110)
    s = B.backtest_summary(B.vectorized_backtest(bars(spark, closes), F.lit(1.0))).first()
    assert s["total_trades"] == 0 and math.isclose(s["max_drawdown"], 99 / 110 - 1 if False else -0.1, rel_tol=1e-9)
    m = B.performance(bars(spark, closes).withColumn("event_idx", F.col("seq")), "close").first()
    assert math.isclose(m["total_return"], 0.2) and m["total_days"] == 5 and math.isclose(m["max_drawdown"], -0.1)
    up = B.performance(bars(spark, [1.0, 2.0, 3.0]).withColumn("event_idx", F.col("seq")), "close").first()
    assert up["profit_factor"] == math.inf and up["sortino_ratio"] == 0.0


def test_loop_backtest_flips(spark):
    d = spark.createDataFrame([("S", 0, 0, 100.0, 1), ("S", 1, 1, 110.0, 0), ("S", 2, 2, 110.0, -1), ("S", 3, 3, 100.0, -1)], "symbol string, seq long, timestamp long, close double, signal int")
    r = B.loop_backtest(d, commission=0.0, slippage=0.0).orderBy("seq").toPandas()
    assert r["actions"].tolist() == ["BUY", "", "CLOSE_LONG,SELL", ""]
    assert [round(x) for x in r["equity"]] == [100_000, 110_000, 110_000, 120_000]


def test_audit_rules(spark):
    import json

    flow = {"timestamp": 5, "price": 1.0, "delta": 0.5, "window_cum_delta": 0.5, "session_cum_delta": 1.0, "buy_volume": 1.0, "sell_volume": 0.5, "pressure": 0.333333, "volume_per_sec": 1.0, "delta_per_sec": 1.0, "trade_intensity": 1.0, "price_range": 0.1, "absorption": False, "warm": True}
    lines = ["", "{", "[1]", '{"flow":{}}', '{"ts":5}', '{"ts":5.5,"flow":{}}', '{"ts":5,"flow":[]}', json.dumps({"ts": 5, "flow": flow}), json.dumps({"ts": 6, "flow": flow | {"price": -1.0, "warm": False, "pressure": 0.9}}), json.dumps({"ts": 5, "flow": {k: v for k, v in flow.items() if k != "delta"}})]
    d = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line_text string")
    got = {r["rule"]: (r["count"], r["first_lines"]) for r in A.rule_violations(d).collect()}
    assert got == {
        "empty_line": (1, [1]), "json_parse_error": (1, [2]), "top_level_not_object": (1, [3]), "missing_top_ts": (1, [4]), "missing_top_flow": (1, [5]), "ts_not_int": (1, [6]), "flow_not_object": (1, [7]),
        "flow_timestamp_mismatch_top_ts": (1, [9]), "price_non_positive": (1, [9]), "warm_false_in_saved_file": (1, [9]), "pressure_formula_mismatch": (1, [9]), "missing_flow_delta": (1, [10]),
    }


def test_permutation_and_correlation(spark):
    rows = [(i % 2 == 0, float(i % 2) * 5 + (i % 7) / 10) for i in range(200)]
    d = spark.createDataFrame(rows, "g boolean, v double")
    assert A.permutation_pvalue(d, "g", "v", n_iter=200).first()["p_value"] < 0.02
    same = spark.createDataFrame([(i % 2 == 0, float(i // 2 % 9)) for i in range(200)], "g boolean, v double")
    assert A.permutation_pvalue(same, "g", "v", n_iter=200).first()["p_value"] > 0.5
    assert A.permutation_pvalue(d.limit(1), "g", "v", n_iter=10).first()["p_value"] is None
    assert A.correlation(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "a double, b double"), "a", "b").first()["corr"] is None


def test_wilder_atr(spark):
    d = spark.createDataFrame([("S", i, i, 10.0 + i, 8.0 + i, 9.0 + i) for i in range(6)], "symbol string, seq long, timestamp long, high double, low double, close double")
    assert [r["atr"] for r in wilder_atr(d, 3).orderBy("seq").collect()] == [None, None, 2.0, 2.0, 2.0, 2.0]


def test_order_flow_shards(spark):
    d = spark.createDataFrame([("S", i, i * 100_000, 1.0, 1.0 if i % 3 else -1.0) for i in range(40)], "symbol string, seq long, timestamp long, price double, delta double")
    got = live.order_flow(d, window_ms=250_000).orderBy("seq").toPandas()
    # Three trades within 250 s, this one included.
    x = d.toPandas()["delta"].rolling(3, min_periods=1).sum()
    assert got["window_cum_delta"].tolist() == x.tolist()


def test_flow_correlation_keeps_large_deltas(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i / 50 - 1, float((i * 7) % 11)) for i in range(100)] + [(0.9, 1_784_784.0), (-0.8, -1e6), (0.1, math.inf), (None, 5.0), (0.2, math.nan)]
    spark.createDataFrame(rows, "pressure double, delta double").write.parquet(str(tmp_path / "flow_readings.parquet"))
    good = [(x, y) for x, y in rows if x is not None and math.isfinite(y)]
    mx, my = (math.fsum(v) / len(good) for v in zip(*good))
    cov, vx, vy = (math.fsum(f(x - mx, y - my) for x, y in good) for f in (lambda a, b: a * b, lambda a, b: a * a, lambda a, b: b * b))
    got = entry.queries()["flow_correlation"](spark, str(tmp_path)).first()
    assert got["n"] == 102 and math.isclose(got["corr"], cov / math.sqrt(vx * vy), abs_tol=1e-7)


def test_field_histogram_against_python(spark, sf):
    import json

    from tapewright.operators.audit import field_histogram

    lines = spark.read.parquet(f"{sf}/raw_lines.parquet").filter("line_format <> 'trade_csv'")
    names = {int: "integer", float: "decimal", str: "text", bool: "boolean", list: "list", dict: "object", type(None): "null"}
    truth: dict = {}
    for r in lines.collect():
        try:
            v = json.loads(r["line_text"], parse_constant=lambda _: 1 / 0)
        except (ValueError, ZeroDivisionError):
            continue
        if isinstance(v, dict):
            body = v["flow"] if isinstance(v.get("flow"), dict) else v
            for k, x in body.items():
                truth[k, names[type(x)]] = truth.get((k, names[type(x)]), 0) + 1
    assert {(r["field"], r["type"]): r["n"] for r in field_histogram(lines).collect()} == truth
