import math

import pytest
from pyspark.sql import functions as F

from tapewright.operators import profile as P
from tapewright.operators.candles import candles, marker_sizes, order_bubbles, timeframe_to_ms
from tapewright.sources import tape as S
from tapewright.streaming.live import CandleAggregator

TRADES = "symbol string, seq long, timestamp long, price double, qty double, is_buyer_maker boolean"
DAY = 1_704_067_200_000  # 2024-01-01


def trades(spark, rows):
    return spark.createDataFrame([("S", i, *r) for i, r in enumerate(rows)], TRADES)


def test_tied_millisecond_and_largest(spark):
    c = candles(trades(spark, [(5, 101.0, 1.0, False), (5, 99.0, 3.0, True), (5, 100.0, 3.0, False), (60_000, 1.0, 2.0, True)]), "1m").orderBy("timestamp_ms").collect()
    assert (c[0]["open"], c[0]["close"], c[0]["high"], c[0]["low"]) == (99.0, 101.0, 101.0, 99.0)
    assert c[0]["largest_trade_side"] == "sell" and c[0]["delta"] == 1.0 and c[0]["trade_count"] == 3
    assert len(c) == 2 and c[1]["timestamp_ms"] == 60_000
    assert candles(trades(spark, [])).count() == 0
    with pytest.raises(ValueError):
        timeframe_to_ms("2m")
    with pytest.raises(ValueError):
        candles(spark.range(1).toDF("timestamp"))


def test_bubble_thresholds_and_tiers(spark):
    t = trades(spark, [(1, 10.0, 2.0, False), (2, 10.0, 1.99, False), (3, 10.0, 3.5, True), (4, 100.0, 6.0, True)])
    b = {r["seq"]: r for r in order_bubbles(t, min_qty=2.0).collect()}
    assert set(b) == {0, 2, 3}
    assert [b[k]["bubble_tier"] for k in (0, 2, 3)] == ["medium", "large", "extreme"]
    both = {r["seq"]: r for r in order_bubbles(t, 2.0, 100.0).collect()}
    assert both[3]["threshold_mode"] == "qty+notional" and both[3]["threshold_value"] == 100.0 and both[3]["bubble_size_score"] == 6.0
    assert {r["seq"]: r["marker_size"] for r in marker_sizes(order_bubbles(t, 2.0)).collect()} == {0: 16.0, 2: 22.0, 3: 32.0}
    for bad in ((None, None), (0.0, None)):
        with pytest.raises(ValueError):
            order_bubbles(t, *bad)


def greedy(vols, share=0.7, up=False):
    poc = max(range(len(vols)), key=lambda i: (vols[i], -i))
    lo = hi = poc
    cum, total = vols[poc], sum(vols)
    while cum < share * total and (lo > 0 or hi < len(vols) - 1):
        left = vols[lo - 1] if lo > 0 else -1
        right = vols[hi + 1] if hi < len(vols) - 1 else -1
        if (right >= left if up else right > left):
            hi += 1
            cum += vols[hi]
        else:
            lo -= 1
            cum += vols[lo]
    return lo, hi


def test_value_area_equals_greedy_loop(spark):
    import random

    r = random.Random(7)
    rows, want = [], {}
    for k in range(150):
        vols = [r.randrange(0, 6) for _ in range(r.randrange(1, 12))]
        if not sum(vols):
            continue
        s = f"d{k:03d}"
        rows += [("S", s, i, float(i), float(i + 1), float(v)) for i, v in enumerate(vols)]
        want[s] = vols
    bins = spark.createDataFrame(rows, "symbol string, session_id string, bin_index int, bin_low double, bin_high double, total_volume double")
    for up in (False, True):
        for x in P.value_area(bins, tie_up=up).collect():
            assert (x["val_bin"], x["vah_bin"]) == greedy(want[x["session_id"]], up=up), (want[x["session_id"]], up)


def test_profile_properties(spark):
    t = trades(spark, [(DAY + 50_000_000 + i * 1000, 100.0 + (i * 37 % 101) / 10, 1.0 + i % 3, i % 2 == 0) for i in range(300)])
    bins = P.profile_bins(t, 50).collect()
    assert len(bins) == 50 and math.isclose(sum(b["total_volume"] for b in bins), t.agg(F.sum("qty")).first()[0])
    area, poc = P.value_area(P.profile_bins(t)).first(), P.point_of_control(P.profile_bins(t)).first()
    assert area["val"] <= poc["poc_price"] <= area["vah"]
    one = P.profile_bins(trades(spark, [(DAY, 5.0, 2.0, True), (DAY, 5.0, 1.0, False)]), 10).collect()
    assert [b["total_volume"] for b in sorted(one, key=lambda b: b["bin_index"])] == [3.0] + [0.0] * 9
    with pytest.raises(ValueError):
        P.profile_bins(t, 0)


def test_session_boundary_and_previous_day(spark):
    edge = DAY + 48_600_000
    ids = [r[0] for r in trades(spark, [(edge, 1.0, 1.0, True), (edge - 1, 1.0, 1.0, True)]).orderBy("seq").select(S.session_id(F.col("timestamp"))).collect()]
    assert ids == ["2024-01-01", "2023-12-31"]
    t = trades(spark, [(edge - 10, 10.0, 1.0, True), (edge - 9, 12.0, 1.0, True), (edge + 5, 20.0, 1.0, False), (edge + 86_400_000, 15.0, 1.0, False), (edge + 3 * 86_400_000, 15.0, 1.0, False)])
    area = P.value_area(P.profile_bins(t, 2))
    inner = P.balance_state(candles(t, "15m"), area).collect()
    outer = P.balance_state(candles(t, "15m"), area, keep_unknown=True).collect()
    assert len(inner) == 2 and len(outer) == 4
    assert {(r["session_id"], r["location"]) for r in inner} == {("2024-01-01", "above_vah"), ("2024-01-02", "below_val")}
    assert sum(r["balance_state"] == "unknown" for r in outer) == 2


def test_scan_reaches_the_file(spark, sf, tmp_path):
    S.trades_from_events(spark, sf).write.parquet(str(tmp_path / "t"))
    w = S.trades_window(spark.read.parquet(str(tmp_path / "t")), "2024-01-05T00:00:00+00:00", "2024-01-06T00:00:00+00:00").select("price")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan and "ReadSchema: struct<timestamp:bigint,price:double>" in plan
    for a, b in (("2024-01-05T00:00:00", "2024-01-06T00:00:00+00:00"), ("2024-01-06T00:00:00+00:00", "2024-01-06T00:00:00+00:00")):
        with pytest.raises(ValueError):
            S.trades_window(w, a, b)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"T":1,"p":"2.5","q":"3","m":true}\n{"T":2,"p":"2","q":"1","m":false}\n')
    got = S.read_trades(spark, str(tmp_path / "a.jsonl"), "X").orderBy("seq").collect()
    assert [(r["timestamp"], r["price"], r["is_buyer_maker"]) for r in got] == [(1, 2.5, True), (2, 2.0, False)]
    (tmp_path / "b.csv").write_text("1,2.0,3.0,6.0,1000,True\n2,2.0,1.0,2.0,1001,what\n")
    assert [r["trade_id"] for r in S.read_trade_csv(spark, str(tmp_path / "b.csv")).collect()] == [1]
    (tmp_path / "c.csv").write_text("agg_trade_id;price;quantity;first;last;ts;m\n1;2.0;3.0;5;6;1000;0\n")
    assert S.read_trade_csv(spark, str(tmp_path / "c.csv")).first()["quote_qty"] == 6.0
    (tmp_path / "d.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        S.read_trade_csv(spark, str(tmp_path / "d.csv"))
    assert S.parse_session_date("2024-02-03") == S.parse_session_date("03022024")
    assert S.session_bounds("2024-01-01") == (DAY + 48_600_000, DAY + 135_000_000)


def event(ts, price, qty, side):
    return {"timestamp": ts, "price": price, "quantity": qty, "side": side}


def test_candle_aggregator_contract():
    with pytest.raises(ValueError):
        CandleAggregator("invalid_timeframe")
    a = CandleAggregator("1m")
    assert a.update(event(1_700_000_000_000, 100, 1.5, "buy")) is None and a.update(event(1_700_000_030_000, 105, 0.8, "sell")) is None
    c = a.get_current_candle()
    assert (c["open"], c["high"], c["low"], c["close"], c["trade_count"]) == (100, 105, 100, 105, 2) and math.isclose(c["delta"], 0.7)
    c["open"] = -1
    assert a.get_current_candle()["open"] == 100
    a.reset()
    assert a.get_current_candle() is None
    a.update(event(1_700_000_040_000, 100, 1, "buy"))
    closed = a.update(event(1_700_000_220_000, 105, 2, "buy"))
    assert (closed["start_time"], closed["end_time"], closed["volume"], closed["delta"]) == (1_700_000_040_000, 1_700_000_099_999, 1, 1)
    assert a.get_current_candle()["start_time"] == 1_700_000_220_000
