"""Sessions, streams, files and bar strategies: small cases with known results."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import audit as A
from tapewright.operators import backtest as B
from tapewright.operators import indicators as N
from tapewright.sources import tape as S
from tapewright.sources.export import write_csv, write_jsonl, write_partitions
from tapewright.streaming import live

BARS = "symbol string, seq long, timestamp long, open double, high double, low double, close double, volume double, session_id string"


def bars(spark, n=160, seed=1, symbol="A"):
    r = random.Random(seed)
    rows, p = [], 100.0
    for i in range(n):
        o, p = p, p + r.gauss(0, 1)
        rows.append((symbol, i, i * 60_000, o, max(o, p) + r.random(), min(o, p) - r.random(), p, float(r.randrange(1, 50)), f"s{i // 40}"))
    return spark.createDataFrame(rows, BARS), rows


def test_exchange_clock_follows_summer_time(spark):
    at = lambda s: S.to_utc_ms(s)
    times = ["2024-01-08T14:29:00+00:00", "2024-01-08T14:30:00+00:00", "2024-01-08T20:59:00+00:00", "2024-01-08T21:00:00+00:00", "2024-07-08T13:29:00+00:00", "2024-07-08T13:30:00+00:00", "2024-07-08T20:00:00+00:00"]
    df = spark.createDataFrame([("A", i, at(t)) for i, t in enumerate(times)], "symbol string, seq long, timestamp long")
    got = N.exchange_session(df).orderBy("seq").collect()
    assert [r["in_session"] for r in got] == [False, True, True, False, False, True, False]
    assert [r["session_change"] for r in got] == [False, True, False, False, False, True, False]


def test_rolling_profile_against_a_loop(spark):
    df, rows = bars(spark)
    got = {r["seq"]: r for r in N.rolling_profile(df, length=20, rows=8).collect()}
    for i in range(len(rows)):
        g = got[i]
        if i < 19:
            assert g["poc"] is None
            continue
        near = rows[i - 19 : i + 1]
        low, high = min(x[5] for x in near), max(x[4] for x in near)
        step, vol = (high - low) / 8, [0.0] * 8
        for x in near:
            k = int((x[6] - low) // step)
            if k < 8:
                vol[k] += x[7]
        poc = int(np.argmax(vol))
        lo = hi = poc
        while sum(vol[lo : hi + 1]) < 0.7 * sum(vol) and (hi < 7 or lo > 0):
            above, below = vol[hi + 1] if hi < 7 else -1.0, vol[lo - 1] if lo else -1.0
            lo, hi = (lo, hi + 1) if above >= below else (lo - 1, hi)
        assert (g["poc"], g["val"], g["vah"]) == pytest.approx((low + (poc + 0.5) * step, low + lo * step, low + (hi + 1) * step)), i


def test_strategy_stop_follows_only_after_the_move(spark):
    row = lambda i, high, low, close, signal=0, live=True, atr=1.0: ("A", i, i * 60_000, "d", float(high), float(low), float(close), atr, signal, live)
    schema = "symbol string, seq long, timestamp long, session_id string, high double, low double, close double, atr double, signal int, in_session boolean"
    trades = lambda rows: [(r["seq"], r["exit"], r["reason"]) for r in N.strategy_trades(spark.createDataFrame(rows, schema)).collect()]
    start = [row(0, 10, 9, 10, signal=1)]  # stop 8, target 14
    assert trades([*start, row(1, 11.4, 10.5, 11), row(2, 11, 10.2, 10.5), row(3, 10, 7.5, 8)]) == [(3, 8.0, "stop")]
    assert trades([*start, row(1, 11.6, 10.5, 11), row(2, 11, 11, 11)]) == [(2, 11.1, "trail")]
    assert trades([*start, row(1, 14.5, 10, 14)]) == [(1, 14.0, "target")]
    assert trades([row(0, 10, 9, 10, signal=1, live=False), row(1, 14.5, 7, 14)]) == []


def test_loop_trades(spark):
    rows = [("A", i, i, c, s) for i, (c, s) in enumerate([(100.0, 1), (110.0, 0), (120.0, -1), (90.0, 1)])]
    got = B.loop_trades(spark.createDataFrame(rows, "symbol string, seq long, timestamp long, close double, signal int"), 1000.0, 0.0, 0.0).orderBy("seq").collect()
    assert [r["action"] for r in got] == ["BUY", "CLOSE_LONG", "SELL", "CLOSE_SHORT", "BUY"]
    assert [round(r["equity"], 6) for r in got] == [0.0, 1200.0, 2400.0, 1500.0, 0.0]


TAPE = "symbol string, seq long, timestamp long, price double, quantity double, delta double, connection int"


def flow_rows(n=400):
    r, t, rows = random.Random(3), 0, []
    for i in range(n):
        t += 20_000 if i % 90 == 89 else r.randrange(1, 900)
        d = r.choice([-1, 1]) * r.randrange(1, 50) / 8
        rows.append(("A", i, t, 100 + r.random(), abs(d), d, i // 150))
    return rows


def test_flow_sessions(spark):
    rows = flow_rows()
    got = {r["seq"]: r for r in live.order_flow(spark.createDataFrame(rows, TAPE), 5000, gap_ms=10_000, connection="connection").collect()}
    window = live.FlowWindow(5000, 10_000)
    for k, (_, i, t, p, _, d, c) in enumerate(rows):
        if k and c != rows[k - 1][6]:
            window.reset()
        want = window.update(t, p, d)
        for name, v in want.items():
            assert got[i][name] == pytest.approx(v), (i, name)
    first = [r for r in rows if r[6] == 1][0]
    assert got[first[1]]["session_cum_delta"] == first[5] and not got[first[1]]["warm"]


def test_flow_stream_keeps_its_window_between_batches(spark, tmp_path):
    rows = flow_rows()
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], TAPE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    still = {r["seq"]: r for r in live.order_flow(spark.createDataFrame(rows, TAPE), 5000, gap_ms=10_000, connection="connection").collect()}
    stream = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    got = live.run_available(live.order_flow_stream(stream, 5000, 10_000, "connection"), "flow").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["window_cum_delta"] == pytest.approx(still[r["seq"]]["window_cum_delta"]) and r["session_cum_delta"] == pytest.approx(still[r["seq"]]["session_cum_delta"]) and r["warm"] == still[r["seq"]]["warm"]


def test_flow_stream_of_one_crowded_window(spark, tmp_path):
    """40,000 trades in one window: work that grows with the window takes minutes here."""
    n = 40_000
    spark.range(n).selectExpr("'A' as symbol", "id as seq", "id div 10 as timestamp", "100D + id % 1000 as price", "if(id % 3 = 0, -1D, 1D) * (1 + id % 7) as delta").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("symbol string, seq long, timestamp long, price double, delta double").parquet(f"{tmp_path}/in")
    began = time.time()
    got = live.run_available(live.order_flow_stream(stream, 5000), "flow").orderBy("seq").collect()
    assert time.time() - began < 60 and len(got) == n
    delta = [(-1.0 if i % 3 == 0 else 1.0) * (1 + i % 7) for i in range(n)]
    assert [r["session_cum_delta"] for r in got] == [r["window_cum_delta"] for r in got] == np.cumsum(delta).tolist()
    assert [r["buy_volume"] for r in got] == np.cumsum(np.maximum(delta, 0)).tolist() and [r["price_range"] for r in got] == [float(min(i, 999)) for i in range(n)]
    assert [r["trade_intensity"] for r in got] == [(i + 1) / 5.0 for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_flow_of_many_trades_at_once(seed):
    """The same to the last bit as trade by trade: ties, pauses, reconnects, batches that go back in time, values of very different size, missing and infinite ones."""
    r = np.random.default_rng(seed)
    one, many, gap = live.FlowWindow(5000, 9000 if seed % 2 else None), live.FlowWindow(5000, 9000 if seed % 2 else None), 0
    for size in (1, 700, 3, 1, 400):
        t = np.sort(1_700_000_000_000 + gap + np.cumsum(r.choice([0, 0, 1, 60, 900, 9500], size, p=[0.2, 0.2, 0.2, 0.2, 0.19, 0.01])))
        gap = int(t[-1] - 1_700_000_000_000) - (3000 if seed < 4 else 0)
        delta = r.choice([0.0, 0.1, -0.1, 1e9, -1e9, 7.0], size) * r.choice([1.0, r.normal()], size)
        if seed in (2, 3):
            delta[r.random(size) < 0.01] = r.choice([np.nan, np.inf, -np.inf])
        price, begins = 100 + r.random(size), r.random(size) < 0.005
        got = many.update_many(t, price, delta, begins)
        for i in range(size):
            if begins[i]:
                one.reset()
            for name, v in one.update(int(t[i]), float(price[i]), float(delta[i])).items():
                np.testing.assert_equal(float(got[name][i]), float("nan") if v is None else float(v), f"{name} {i}")
        np.testing.assert_equal([many.events, many.since, many.total], [one.events, one.since, one.total])


def test_flow_price_range_leaves_missing_prices_out():
    got = live.FlowWindow(100).update_many(np.array([0, 50, 120]), np.array([np.nan, 3.0, 5.0]), np.ones(3), np.zeros(3, bool))
    np.testing.assert_equal(got["price_range"], [np.nan, 0.0, 2.0])


def test_permutations_are_repeatable_and_right(spark):
    r = np.random.default_rng(2)
    v, g = r.normal(0, 1, 9000), r.random(9000) < 0.3
    near = [(bool(a), float(b + 0.04 * a)) for a, b in zip(g, v)]
    p = lambda rows, n: A.permutation_pvalue(spark.createDataFrame(rows, "g boolean, v double").repartition(n), "g", "v", n_iter=400).first()[0]
    one, many = p(near, 1), p(near, 6)
    assert one == many
    x, y = np.array([b for a, b in near if a]), np.array([b for a, b in near if not a])
    z = abs(x.mean() - y.mean()) / np.sqrt(x.var() / len(x) + y.var() / len(y))
    from math import erfc

    assert abs(one - erfc(z / 2**0.5)) < 0.1
    assert p([(bool(a), float(b + 3 * a)) for a, b in zip(g, v)], 2) == 1 / 401
    assert p([(True, 1.0)], 1) is None


def test_order_statistics(spark):
    rows = [("a", float(x)) for x in (5, 1, 4, 2)] + [(None, 7.0), ("a", None), ("a", float("nan"))]
    got = {r["k"]: r for r in A.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"m": 0.5, "t": 0.75}, {"r": 0.95}).collect()}
    assert (got["a"]["n"], got["a"]["m"], got["a"]["t"], got["a"]["r"]) == (4, 3.0, 4.25, 4.0) and got[None]["m"] == 7.0


def test_schema_variants_over_files(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a long, b string").coalesce(1).write.parquet(f"{tmp_path}/p/1")
    spark.createDataFrame([("1", "x")], "a string, c string").coalesce(1).write.parquet(f"{tmp_path}/p/2")
    got = {(r["field"], r["dtype"], r["files"]) for r in A.schema_variants(spark, f"{tmp_path}/p").collect()}
    assert got == {("a", "int64", 1), ("a", "string", 1), ("b", "string", 1), ("c", "string", 1)}
    assert {tuple(r) for r in A.schema_variants(spark, f"{tmp_path}/p").select("n_files", "layouts").distinct().collect()} == {(2, 2)}


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Files of very different sizes: Spark reads the largest first, numbers follow names and lines all the same."""
    n = 0
    for k, size in enumerate((5, 3000, 40)):
        with open(tmp_path / f"{k}.csv", "w") as f:
            for _ in range(size):
                f.write(f"{n},1.5,2,3,{1_700_000_000_000 + n},true\n")
                n += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = S.read_trades(spark, f"{tmp_path}/*.csv", "A").orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["seq"] for r in got] == list(range(n)) and [r["timestamp"] for r in got] == [1_700_000_000_000 + i for i in range(n)]


def test_profiles_first_and_last(spark, tmp_path):
    lines = [{"session_id": "2024-01-05", "poc_price": 1.0}, {"session_id": "2024-01-06", "poc_price": 2.0}, {"session_id": "2024-01-05", "poc_price": 3.0}]
    (tmp_path / "p.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    p = S.read_profiles(spark, f"{tmp_path}/p.jsonl")
    assert {r["session_id"]: r["poc_price"] for r in S.latest_profiles(p).collect()} == {"2024-01-05": 3.0, "2024-01-06": 2.0}
    assert S.profile_of(p, "2024-01-05").first()["poc_price"] == 1.0
    with pytest.raises(ValueError):
        S.profile_of(p, "2024-01-07")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A", "d1", 1.5, [1, 2]), ("B", "d2", None, None), ('q"x,y', "d2", 2.0, [])], "symbol string, session_id string, v double, a array<int>")
    write_jsonl(df, f"{tmp_path}/j")
    assert sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in spark.read.text(f"{tmp_path}/j").collect()) == sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    write_csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert {r["symbol"]: r["a"] for r in back.collect()} == {"A": "[1,2]", "B": None, 'q"x,y': "[]"}
    write_partitions(df.drop("a"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").filter("session_id = 'd2'").count() == 2


def test_opening_range_waits_for_its_end(spark):
    rows = [("A", i, i * 900_000, c, c, c, c, 1.0, "d") for i, c in enumerate([10.0, 12.0, 11.0, 12.0, 13.0, 9.0])]
    got = N.opening_range(spark.createDataFrame(rows, BARS)).orderBy("seq").collect()
    assert [r["orb_high"] for r in got] == [None, None, 12.0, 12.0, 12.0, 12.0]
    assert [r["orb_long"] for r in got] == [False, False, False, False, True, False] and [r["orb_short"] for r in got] == [False] * 5 + [True]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tapewright.functions.common import shared_dir

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://x:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_overlay_window():
    from tapewright.operators.profile import overlay_window

    with pytest.raises(ValueError):
        overlay_window(F.lit(0), F.lit(1), 0.0)
