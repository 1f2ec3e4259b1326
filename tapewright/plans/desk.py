"""Queries of folds, backtests, metrics, audits, bar indicators and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import epoch_ms, materialize
from tapewright.operators import audit as A
from tapewright.operators import backtest as B
from tapewright.operators import features as X
from tapewright.operators import folds as M
from tapewright.operators import indicators as N
from tapewright.operators import regime as R
from tapewright.operators.candles import candles
from tapewright.plans.market import DEC, SESSION, TAPE, area_sql, tape
from tapewright.plans.registry import Registry, table
from tapewright.plans.research import CORE_STEP, ftape, tagged
from tapewright.sources import tape as S
from tapewright.streaming import live

REGISTRY = Registry()


@REGISTRY.query("signal_stream")
def signal_stream(spark, sf_dir):
    return M.signal_stream(tagged(spark, sf_dir))


def _delivered_tape(spark, sf_dir) -> DataFrame:
    """The delivered trades as a tape of many symbols, one delivery of each; those with a missing value are no trades."""
    d = table(spark, sf_dir, "trade_deliveries").dropna(subset=["trade_id", "price", "qty", "is_buyer_maker", "timestamp"])
    one = d.groupBy(F.upper("symbol").alias("symbol"), "trade_id", epoch_ms(F.col("timestamp")).alias("timestamp")).agg(F.min(F.struct("delivery_id", "price", "qty", "is_buyer_maker")).alias("r"))
    return one.select("symbol", F.col("r.delivery_id").alias("seq"), "timestamp", "r.price", "r.qty", "r.is_buyer_maker")


def _trades(spark, sf_dir) -> DataFrame:
    core = X.core_regime(X.core_features(S.feature_tape(_delivered_tape(spark, sf_dir)), 1))
    return materialize(M.execution_trades(core), "trades")


@REGISTRY.query("mvp_trades")
def mvp_trades(spark, sf_dir):
    return _trades(spark, sf_dir)


@REGISTRY.query("mvp_cum_pnl")
def mvp_cum_pnl(spark, sf_dir):
    return M.with_cum_pnl(_trades(spark, sf_dir)).select("symbol", "entry_idx", "exit_idx", "pnl", "cum_pnl")


@REGISTRY.query("mvp_summary")
def mvp_summary(spark, sf_dir):
    return M.summarize_trades(_trades(spark, sf_dir))


@REGISTRY.query("mvp_exit_stats")
def mvp_exit_stats(spark, sf_dir):
    return R.distribution(_trades(spark, sf_dir), "exit_reason")


BARS = f"""{TAPE}, bars as (select symbol, "timestamp" // 900000 * 900000 as seq, "timestamp" // 900000 * 900000 as t, first(price order by "timestamp", price, qty, seq) as open, max(price) as high, min(price) as low,
 first(price order by "timestamp" desc, price desc, qty desc, seq desc) as close, {DEC.format(x="qty")} as volume from tape group by 1, 2, 3),
sig as (select *, row_number() over (partition by symbol order by t) - 1 as event_idx, case when close > open then 1 when close < open then -1 else 0 end as signal from bars)"""


def bars(spark, sf_dir) -> DataFrame:
    c = candles(tape(spark, sf_dir), "15m")
    return c.select("symbol", F.col("timestamp_ms").alias("seq"), F.col("timestamp_ms").alias("timestamp"), "open", "high", "low", "close", "volume", S.session_id(F.col("timestamp_ms")).alias("session_id"))


def _signal(size: float = 1.0):
    return F.when(F.col("close") > F.col("open"), size).when(F.col("close") < F.col("open"), -size).otherwise(0.0)


# A hundredth of the capital is put at stake: prices of the test tape jump by far more than real ones.
_VB = f"""{BARS}, s1 as (select * exclude (signal), signal * cast(0.01 as double) as signal from sig),
v0 as (select *, lag(signal) over w as position, close / lag(close) over w - 1 as ret, lag(signal) over w - lag(signal, 2) over w as dp from s1 window w as (partition by symbol order by t)),
v1 as (select *, abs(dp) * cast(0.001 as double) as cost, position * ret - abs(dp) * cast(0.001 as double) as sr from v0),
v2 as (select *, case when event_idx = 0 then 100000.0 when sr is not null then 100000.0 * product(1 + coalesce(sr, 0)) over (partition by symbol order by t rows unbounded preceding) end as equity from v1)"""


def _curve(spark, sf_dir) -> DataFrame:
    return B.vectorized_backtest(bars(spark, sf_dir), _signal(0.01))


@REGISTRY.query("bt_vectorized", f"with {_VB} select symbol, t as \"timestamp\", cast(position as double) as position, round(ret, 9) as ret, round(cost, 9) as cost, round(sr, 9) as strategy_return, round(equity, 3) as equity from v2")
def bt_vectorized(spark, sf_dir):
    c = _curve(spark, sf_dir)
    return c.select("symbol", "timestamp", "position", *[F.round(x, 9).alias(x) for x in ("ret", "cost", "strategy_return")], F.round("equity", 3).alias("equity"))


@REGISTRY.query("bt_summary", f"""with {_VB}, a as (select *, coalesce(cost > 0, false) as ch from v2), b as (select *, coalesce(lag(ch) over (partition by symbol order by t), false) as aft from a),
dd as (select symbol, t, equity, equity / max(equity) over (partition by symbol order by t rows unbounded preceding) - 1 as d from v2 where equity is not null)
select symbol, round((select last(equity order by t) from dd) / 100000.0 - 1, 7) as total_return, round(sqrt(252) * avg(sr) / stddev_samp(sr), 7) as sharpe_ratio, round((select min(d) from dd), 7) as max_drawdown, count(*) filter (aft and coalesce(sr > 0, false)) / count(*) filter (aft) as win_rate, count(*) filter (ch) as total_trades from b group by symbol""")
def bt_summary(spark, sf_dir):
    return B.backtest_summary(_curve(spark, sf_dir)).withColumns({c: F.round(c, 7) for c in ("total_return", "sharpe_ratio", "max_drawdown")})


#: The broker as a recursion over bars: s signal, x price after slippage, q cash after a position was closed, then cash and size.
_LOOP = f"""{BARS}, lb as (select symbol, seq, t, close, signal as s, row_number() over (partition by symbol order by t) as k from sig),
lr as (select symbol, cast(0 as bigint) as k, cast(0 as bigint) as seq, cast(0 as bigint) as t, cast(0 as double) as close, 0 as s, cast(0 as double) as x, cast(0 as double) as old, cast(0 as double) as q, cast(100000 as double) as cash, cast(0 as double) as size, false as trades from lb where k = 1
 union all select symbol, k, seq, t, close, s, x, size, q, case when trades then case when s > 0 then q - abs(s * q / x) * x * 1.001 else q + abs(s * q / x) * x * 0.999 end else cash end, case when trades then s * q / x else size end, trades
 from (select b.symbol, b.k, b.seq, b.t, b.close, b.s, b.close * (1 + 0.0005 * b.s) as x, r.size, r.cash, b.s <> 0 and r.size * b.s <= 0 as trades, case when r.size <> 0 then r.cash + r.size * (b.close * (1 + 0.0005 * b.s)) * 0.999 else r.cash end as q from lr r join lb b on b.symbol = r.symbol and b.k = r.k + 1))"""
_ACTION = "case when trades then concat_ws(',', case when old <> 0 then case when s > 0 then 'CLOSE_SHORT' else 'CLOSE_LONG' end end, case when s > 0 then 'BUY' else 'SELL' end) else '' end"


@REGISTRY.query("bt_loop", f"with recursive {_LOOP} select symbol, seq, t as \"timestamp\", round(cash + size * close, 2) as equity, actions from (select *, {_ACTION} as actions from lr where k > 0)")
def bt_loop(spark, sf_dir):
    return _loop(spark, sf_dir).select("symbol", "seq", "timestamp", F.round("equity", 2).alias("equity"), "actions")


def _loop(spark, sf_dir) -> DataFrame:
    return B.loop_backtest(bars(spark, sf_dir).withColumn("signal", _signal()))


@REGISTRY.query("bt_loop_trades", f"""with recursive {_LOOP}, d as (select * from lr where k > 0 and trades)
select symbol, seq, t as "timestamp", case when s > 0 then 'CLOSE_SHORT' else 'CLOSE_LONG' end as action, round(x, 7) as price, round(q, 2) as equity from d where old <> 0
union all select symbol, seq, t, case when s > 0 then 'BUY' else 'SELL' end, round(x, 7), round(cash, 2) from d""")
def bt_loop_trades(spark, sf_dir):
    t = B.loop_trades(bars(spark, sf_dir).withColumn("signal", _signal()))
    return t.withColumns({"price": F.round("price", 7), "equity": F.round("equity", 2)})


@REGISTRY.query("bt_loop_summary", f"""with recursive {_LOOP}, e as (select symbol, t, cash + size * close as v, case when trades then 1 + (old <> 0)::int else 0 end as n from lr where k > 0),
r as (select *, v / lag(v) over w - 1 as r, v > lag(v) over w as up, v / max(v) over (partition by symbol order by t rows unbounded preceding) - 1 as dd from e window w as (partition by symbol order by t))
select symbol, round(last(v order by t) / 100000 - 1, 7) as total_return, case when isfinite(avg(r)) then round(sqrt(252 * 390) * avg(r) / stddev_samp(r), 7) end as sharpe_ratio, round(min(dd), 7) as max_drawdown, count(*) filter (up) / count(*) as win_rate, cast(sum(n) as bigint) as total_trades from r group by symbol""")
def bt_loop_summary(spark, sf_dir):
    s = B.loop_summary(materialize(_loop(spark, sf_dir), "loop"))
    # Prices of the test tape jump so far that the broker's equity leaves the range of doubles: no ratio then.
    return s.withColumns({c: F.round(c, 7) for c in ("total_return", "max_drawdown")}).withColumn("sharpe_ratio", F.when(~F.isnan("sharpe_ratio"), F.round("sharpe_ratio", 7)))


@REGISTRY.query("bar_returns", f"with {BARS} select symbol, t as \"timestamp\", close / lag(close) over (partition by symbol order by t) - 1 as ret from bars")
def bar_returns(spark, sf_dir):
    return B.returns(bars(spark, sf_dir)).select("symbol", "timestamp", "ret")


_PERF = ["total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "average_drawdown", "win_rate", "profit_factor", "annualized_volatility"]


@REGISTRY.query("perf_metrics", f"""with {BARS}, r as (select symbol, t, close as v, close / lag(close) over (partition by symbol order by t) - 1 as r, close / max(close) over (partition by symbol order by t rows unbounded preceding) - 1 as d from bars),
g as (select symbol, first(v order by t) as a, last(v order by t) as b, count(*) as n, avg(r) as m, stddev_samp(r) as s, stddev_samp(r) filter (r < 0) as sd, count(r) as nr, count(*) filter (r > 0) as nu, sum(r) filter (r > 0) as su, sum(r) filter (r < 0) as sn, min(d) as mdd, avg(d) as ad from r group by symbol)
select symbol, round(b / a - 1, 7) as total_return, round(pow(b / a, 252.0 / n) - 1, 7) as annualized_return, round(sqrt(252) * m / s, 7) as sharpe_ratio, round(sqrt(252) * m / sd, 7) as sortino_ratio, round(m * 252 / abs(mdd), 7) as calmar_ratio, round(mdd, 7) as max_drawdown, round(ad, 7) as average_drawdown,
 round(nu / nr, 7) as win_rate, round(abs(su / sn), 7) as profit_factor, round(s * sqrt(252), 7) as annualized_volatility, n as total_days from g""")
def perf_metrics(spark, sf_dir):
    return B.performance(bars(spark, sf_dir).withColumn("event_idx", F.col("timestamp")), "close").withColumns({c: F.round(c, 7) for c in _PERF})


_TD_COLS = ["trade_id", "price", "qty", "quote_qty", "timestamp", "is_buyer_maker"]


@REGISTRY.query("audit_nulls", " union all ".join(f"select '{c}' as field, count(*) filter (\"{c}\" is null) as nulls from trade_deliveries" for c in _TD_COLS))
def audit_nulls(spark, sf_dir):
    return A.null_counts(table(spark, sf_dir, "trade_deliveries"), _TD_COLS)


@REGISTRY.query("audit_invalid", "select count(*) filter (side is null or side not in ('buy', 'sell')) as side_invalid, count(*) filter (price <= 0) as price_non_positive, count(*) filter (quantity <= 0) as qty_non_positive from event_features")
def audit_invalid(spark, sf_dir):
    return A.invalid_counts(table(spark, sf_dir, "event_features"), "price", "quantity", "side", ("buy", "sell"))


@REGISTRY.query("audit_dups", """with p as (select trade_id, batch_id, count(*) as n from trade_deliveries where trade_id is not null group by 1, 2), i as (select trade_id, sum(n) as n, sum(n - 1) as w from p group by 1)
select cast(sum(w) as bigint) as within_files, cast(sum(n - 1) as bigint) as overall from i""")
def audit_dups(spark, sf_dir):
    return A.duplicate_counts(table(spark, sf_dir, "trade_deliveries"), "trade_id", "batch_id")


@REGISTRY.query("audit_monotonic", """with l as (select batch_id, "timestamp" as t, lag("timestamp") over (partition by batch_id order by delivery_id) as p from trade_deliveries) select batch_id, count(*) filter (t < p) as falls from l group by 1 having count(*) filter (t < p) > 0""")
def audit_monotonic(spark, sf_dir):
    return A.disorder(table(spark, sf_dir, "trade_deliveries"), "batch_id", "delivery_id", "timestamp")


_RANGES = "r as (select * from file_ranges where min_ts is not null and max_ts is not null)"


@REGISTRY.query("audit_segments", f"""with {_RANGES}, n as (select *, case when min_ts - lag(max_ts) over w > 300000 then 1 else 0 end as s from r window w as (partition by symbol, session_id order by min_ts, max_ts, file_name)),
g as (select *, sum(s) over (partition by symbol, session_id order by min_ts, max_ts, file_name rows unbounded preceding) as segment from n)
select symbol, session_id, cast(segment as bigint) as segment, count(*) as files, min(min_ts) as from_ts, max(max_ts) as to_ts from g group by 1, 2, 3""")
def audit_segments(spark, sf_dir):
    return A.timeline_segments(table(spark, sf_dir, "file_ranges"), ["symbol", "session_id"])


@REGISTRY.query("audit_boundaries", f"""with {_RANGES}, d as (select symbol, session_id, lead(min_ts) over (partition by symbol, session_id order by min_ts, max_ts, file_name) - max_ts as d from r)
select symbol, session_id, count(*) filter (d < 0) as backwards, count(*) filter (d = 0) as exact, count(*) filter (d > 1000) as gaps_over_1s, least(min(d), 0) as max_backward_ms, greatest(coalesce(max(d) filter (d > 1000), 0), 0) as max_forward_ms from d where d is not null group by 1, 2""")
def audit_boundaries(spark, sf_dir):
    return A.boundary_checks(table(spark, sf_dir, "file_ranges"), ["symbol", "session_id"])


@REGISTRY.query("gap_stats", f"""with {TAPE}, g as (select symbol, "timestamp" - lag("timestamp") over (partition by symbol order by "timestamp", seq) as gap from tape)
select symbol, min(gap) as min_gap, quantile_cont(gap, 0.5) as p50_gap, cast(list_sort(list(gap) filter (gap is not null))[cast(floor(0.95 * (count(gap) - 1)) as int) + 1] as double) as p95_gap, max(gap) as max_gap, count(*) filter (gap > 1000) as gaps_over_1s, count(*) filter (gap > 5000) as gaps_over_5s, count(*) filter (gap > 10000) as gaps_over_10s, count(*) filter (gap > 60000) as gaps_over_60s, count(*) filter (gap = 0) as duplicate_ts from g group by symbol""")
def gap_stats(spark, sf_dir):
    return A.gap_stats(tape(spark, sf_dir))


@REGISTRY.query("tape_report", f"""with {TAPE}, g as (select symbol, "timestamp" as t, "timestamp" - lag("timestamp") over (partition by symbol order by "timestamp", seq) as gap from tape),
m as (select symbol, count(*) as rows, min(t) as ts_min, max(t) as ts_max, min(gap) as min_gap, max(gap) as max_gap, quantile_cont(gap, 0.5) as p50_gap, list_sort(list(gap) filter (gap is not null))[cast(floor(0.95 * (count(gap) - 1)) as int) + 1] as p95_gap,
 count(*) filter (gap > 1000) as gaps_over_1s, count(*) filter (gap > 5000) as gaps_over_5s, count(*) filter (gap > 10000) as gaps_over_10s, count(*) filter (gap > 60000) as gaps_over_60s, count(*) filter (gap = 0) as duplicate_ts from g group by symbol),
d as (select symbol, cast(columns(* exclude (symbol)) as double), (ts_max - ts_min) / 1000.0::double as duration_s, rows / nullif((ts_max - ts_min) / 1000.0::double, 0) as rows_per_s from m)
unpivot d on columns(* exclude (symbol)) into name metric value value""")
def tape_report(spark, sf_dir):
    return A.tape_report(tape(spark, sf_dir))


@REGISTRY.query("schema_variants", """select column_name as field, case column_type when 'BIGINT' then 'int64' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'BOOLEAN' then 'bool' when 'TIMESTAMP' then 'timestamp[us]' else column_type end as dtype,
 cast(1 as bigint) as files, cast(1 as bigint) as n_files, cast(1 as bigint) as layouts from (describe trade_deliveries)""")
def schema_variants(spark, sf_dir):
    return A.schema_variants(spark, f"{sf_dir}/trade_deliveries.parquet").withColumns({c: F.col(c).cast("long") for c in ("n_files", "layouts")})


_FWD = f"""{TAPE}, fr as (select a.symbol, a.seq, a.price, a.is_buyer_maker, (b.price - a.price) / nullif(a.price, 0) as ret_3s, (c.price - a.price) / nullif(a.price, 0) as ret_600s
 from tape a asof left join (select symbol, "timestamp" as t, first(price order by seq) as price from tape group by 1, 2) b on a.symbol = b.symbol and a."timestamp" + 3000 <= b.t
 asof left join (select symbol, "timestamp" as t, first(price order by seq) as price from tape group by 1, 2) c on a.symbol = c.symbol and a."timestamp" + 600000 <= c.t)"""


def _forward(spark, sf_dir) -> DataFrame:
    return A.forward_returns(tape(spark, sf_dir), "symbol", (3_000, 600_000), carry=("is_buyer_maker",))


@REGISTRY.query("fwd_returns", f"with {_FWD} select symbol, seq, ret_3s, ret_600s from fr")
def fwd_returns(spark, sf_dir):
    return _forward(spark, sf_dir).select("symbol", "seq", "ret_3s", "ret_600s")


@REGISTRY.query("directional_accuracy", f"with {_FWD}, d as (select case when is_buyer_maker then -1.0 else 1.0 end as s, ret_3s as r from fr where ret_3s is not null) select count(*) as total, count(*) filter (sign(s) = sign(r)) as hits from d")
def directional_accuracy(spark, sf_dir):
    f = _forward(spark, sf_dir).withColumn("s", F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0))
    return A.directional_accuracy(f, "s", "ret_3s")


@REGISTRY.query("flow_correlation", "select count(*) as n, round(corr(pressure, delta), 7) as corr from flow_readings where pressure is not null and delta is not null and isfinite(pressure) and isfinite(delta)")
def flow_correlation(spark, sf_dir):
    return A.correlation(table(spark, sf_dir, "flow_readings"), "pressure", "delta").withColumn("corr", F.round("corr", 7))


@REGISTRY.query("permutation_pvalue")
def permutation_pvalue(spark, sf_dir):
    rows = table(spark, sf_dir, "flow_readings").withColumn("size", F.abs("price_range"))
    return A.permutation_pvalue(rows, "absorption", "size")


_RANK = "x as (select source as k, pressure as v, row_number() over (partition by source order by pressure) - 1 as rn, count(*) over (partition by source) as n from flow_readings where pressure is not null and isfinite(pressure))"


@REGISTRY.query("nearest_rank", f"with {_RANK} select k as source, max(n) as n, max(v) filter (rn = floor(0.5 * (n - 1))) as p50, max(v) filter (rn = floor(0.95 * (n - 1))) as p95 from x group by k")
def nearest_rank(spark, sf_dir):
    return A.nearest_rank(table(spark, sf_dir, "flow_readings"), "source", "pressure", {"p50": 0.5, "p95": 0.95})


@REGISTRY.query("iqr_outliers", f"""with {_RANK}, q as (select k, max(n) as n, max(v) filter (rn = floor(0.25 * (n - 1))) as q1, max(v) filter (rn = floor(0.75 * (n - 1))) as q3 from x group by k)
select q.k as source, q.n, max(q1 - 1.5 * (q3 - q1)) as low, max(q3 + 1.5 * (q3 - q1)) as high, count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers from q join x on q.k = x.k group by 1, 2""")
def iqr_outliers(spark, sf_dir):
    return A.iqr_outliers(table(spark, sf_dir, "flow_readings"), "source", "pressure")


@REGISTRY.query("rule_violations")
def rule_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "raw_lines").filter("line_format = 'flow_jsonl'")
    return A.rule_violations(lines, "line_id", "line_text")


# No SQL: DuckDB's reader takes Infinity and trailing commas for JSON.
@REGISTRY.query("field_histogram")
def field_histogram(spark, sf_dir):
    return A.field_histogram(table(spark, sf_dir, "raw_lines").filter("line_format <> 'trade_csv'"))


#: Trailing window and pause that begins a session, in the test tape's pace.
FLOW_MS, PAUSE_MS = 300_000, 900_000
_FLOW = f"""{TAPE}, f0 as (select symbol, seq, "timestamp" as t, price, qty, case when is_buyer_maker then -qty else qty end as delta, case when "timestamp" - lag("timestamp") over (partition by symbol order by "timestamp", seq) > {PAUSE_MS} then 1 else 0 end as nw from tape),
f as (select *, sum(nw) over (partition by symbol order by t, seq rows unbounded preceding) as sid from f0),
w as (select *, cast(sum(cast(greatest(delta, 0.0) as decimal(28,8))) over w5 as double) as buy_volume, cast(sum(cast(greatest(-delta, 0.0) as decimal(28,8))) over w5 as double) as sell_volume, cast(sum(cast(delta as decimal(28,8))) over w5 as double) as window_cum_delta,
 cast(sum(cast(delta as decimal(28,8))) over (partition by symbol, sid order by t, seq rows unbounded preceding) as double) as session_cum_delta, count(*) over w5 as n, max(price) over w5 - min(price) over w5 as price_range, min(t) over (partition by symbol, sid) as first
 from f window w5 as (partition by symbol, sid order by t range between {FLOW_MS - 1} preceding and current row))
select symbol, seq, window_cum_delta, session_cum_delta, buy_volume, sell_volume, window_cum_delta / (buy_volume + sell_volume) as pressure, (buy_volume + sell_volume) / {FLOW_MS / 1000} as volume_per_sec, window_cum_delta / {FLOW_MS / 1000} as delta_per_sec, n / {FLOW_MS / 1000} as trade_intensity, price_range, t - first >= {FLOW_MS} as warm from w"""


@REGISTRY.query("order_flow", f"with {_FLOW}")
def order_flow(spark, sf_dir):
    return live.order_flow(ftape(spark, sf_dir), FLOW_MS, gap_ms=PAUSE_MS).drop("timestamp", "price", "delta")


@REGISTRY.query("order_flow_stream")
def order_flow_stream(spark, sf_dir):
    """The same from a stream; trades of one instant are seen one after the other, so rows with ties differ from ``order_flow``."""
    t = S.feature_tape(S.events_as_tape(S.stream_files(spark, f"{sf_dir}/events.parquet"))).select("symbol", "seq", "timestamp", "price", "delta")
    return live.run_available(live.order_flow_stream(t, FLOW_MS, gap_ms=PAUSE_MS), "flow").drop("timestamp", "price", "delta")


@REGISTRY.query("ohlcv_stream", f"""with {TAPE}, c as (select symbol, '15m' as timeframe, "timestamp" // 900000 * 900000 as timestamp_ms, first(price order by "timestamp", price, qty, seq) as open, max(price) as high, min(price) as low, first(price order by "timestamp" desc, price desc, qty desc, seq desc) as close,
 {DEC.format(x="qty")} as volume, {DEC.format(x="case when is_buyer_maker then 0 else qty end")} as buy_volume, {DEC.format(x="case when is_buyer_maker then qty else 0 end")} as sell_volume, count(*) as trade_count from tape group by 1, 2, 3)
select symbol, timeframe, timestamp_ms, open, high, low, close, volume, buy_volume, sell_volume, buy_volume - sell_volume as delta, trade_count from c where timestamp_ms + 900000 <= (select max("timestamp") from tape) - 60000""")
def ohlcv_stream(spark, sf_dir):
    t = S.events_as_tape(S.stream_files(spark, f"{sf_dir}/events.parquet"))
    return live.run_available(live.candle_stream(t, "15m"), "candles")


def _indicated(spark, sf_dir) -> DataFrame:
    b = N.session_vwap(N.wilder_atr(materialize(bars(spark, sf_dir), "bars")))
    b = N.rolling_profile(N.bar_indicators(materialize(b, "bars2")))
    return N.opening_range(N.exchange_session(materialize(b, "bars3")), flag="in_session")


_VWAP = f"""{BARS}, sb as (select *, {SESSION.format(c="t")} as session_id from bars)"""


@REGISTRY.query("bar_vwap", f"with {_VWAP} select symbol, t as \"timestamp\", round(sum((high + low + close) / 3 * volume) over w / sum(volume) over w, 7) as vwap from sb window w as (partition by symbol, session_id order by t rows unbounded preceding)")
def bar_vwap(spark, sf_dir):
    return N.session_vwap(bars(spark, sf_dir)).select("symbol", "timestamp", F.round("vwap", 7).alias("vwap"))


@REGISTRY.query("bar_delta", f"""with {BARS}, b as (select *, case when close > open then volume when close = open then volume * 0.5 else volume * ((high - close) / (high - low + 0.0001)) end as bv from bars),
d as (select *, bv - (volume - bv) as delta from b), s as (select *, case when count(delta) over w >= 5 then avg(delta) over w end as sd from d window w as (partition by symbol order by t rows between 4 preceding and current row))
select symbol, t as "timestamp", round(bv, 7) as buy_volume, round(delta, 7) as delta, round(sd, 7) as smooth_delta from s""")
def bar_delta(spark, sf_dir):
    b = N.bar_indicators(bars(spark, sf_dir).withColumn("atr", F.lit(1.0)))
    return b.select("symbol", "timestamp", *[F.round(c, 7).alias(c) for c in ("buy_volume", "delta", "smooth_delta")])


@REGISTRY.query("bar_opening_range", f"""with {_VWAP}, o as (select *, row_number() over (partition by symbol, session_id order by t) - 1 as n, lag(close) over (partition by symbol, session_id order by t) as pc from sb),
h as (select *, case when n >= 2 then max(high) filter (n <= 2) over (partition by symbol, session_id) end as orb_high, case when n >= 2 then min(low) filter (n <= 2) over (partition by symbol, session_id) end as orb_low from o)
select symbol, t as "timestamp", orb_high, orb_low, coalesce(close > orb_high and pc <= orb_high, false) as orb_long, coalesce(close < orb_low and pc >= orb_low, false) as orb_short from h""")
def bar_opening_range(spark, sf_dir):
    return N.opening_range(bars(spark, sf_dir)).select("symbol", "timestamp", "orb_high", "orb_low", "orb_long", "orb_short")


@REGISTRY.query("bar_session_flag", f"""with {BARS}, m as (select symbol, t, (t + 7200000) // 60000 % 1440 as m from bars), f as (select *, m >= 570 and m < 960 as in_session from m)
select symbol, t as "timestamp", in_session, in_session and not coalesce(lag(in_session) over (partition by symbol order by t), false) as session_change from f""")
def bar_session_flag(spark, sf_dir):
    """The flag by a clock two hours ahead of UTC, which SQL can state without time zones."""
    return N.exchange_session(bars(spark, sf_dir), zone="+02:00").select("symbol", "timestamp", "in_session", "session_change")


_ATR = f"""{BARS}, tr as (select *, row_number() over (partition by symbol order by t) as k, greatest(high - low, abs(high - lag(close) over (partition by symbol order by t)), abs(low - lag(close) over (partition by symbol order by t))) as x, high - low as hl from bars),
tx as (select symbol, t, k, case when k = 1 then hl else x end as x from tr),
rec as (select symbol, t, k, (select avg(x) from tx b where b.symbol = a.symbol and b.k <= 14) as atr from tx a where k = 14 union all select n.symbol, n.t, n.k, r.atr + (n.x - r.atr) / 14 from rec r join tx n on n.symbol = r.symbol and n.k = r.k + 1)"""


@REGISTRY.query("bar_atr", f"with recursive {_ATR} select tx.symbol, tx.t as \"timestamp\", round(rec.atr, 7) as atr from tx left join rec on tx.symbol = rec.symbol and tx.k = rec.k")
def bar_atr(spark, sf_dir):
    return N.wilder_atr(bars(spark, sf_dir)).select("symbol", "timestamp", F.round("atr", 7).alias("atr"))


_ROLLED = f"""{BARS}, r0 as (select *, row_number() over (partition by symbol order by t) as k, min(low) over w as lo, max(high) over w as hi, count(*) over w as c from bars window w as (partition by symbol order by t rows between 49 preceding and current row)),
r1 as (select *, (hi - lo) / 24 as step from r0 where c >= 50),
pl as (select a.symbol, a.t, cast(floor((b.close - a.lo) / nullif(a.step, 0)) as int) as i, sum(b.volume) as v from r1 a join r0 b on a.symbol = b.symbol and b.k between a.k - 49 and a.k group by 1, 2, 3),
fr as (select symbol, t, lo, step, cast(unnest(range(24)) as int) as bin_index from r1),
bins as (select fr.symbol, fr.t as session_id, bin_index, lo + bin_index * step as bin_low, lo + bin_index * step + step as bin_high, coalesce(v, 0) as total_volume from fr left join pl on fr.symbol = pl.symbol and fr.t = pl.t and fr.bin_index = pl.i), {area_sql("desc")}"""


@REGISTRY.query("bar_rolling_profile", f"with {_ROLLED} select b.symbol, b.t as \"timestamp\", round(poc_price, 7) as poc, round(vah, 7) as vah, round(val, 7) as val from bars b left join poc on b.symbol = poc.symbol and b.t = poc.session_id left join area on b.symbol = area.symbol and b.t = area.session_id")
def bar_rolling_profile(spark, sf_dir):
    return N.rolling_profile(bars(spark, sf_dir)).select("symbol", "timestamp", *[F.round(c, 7).alias(c) for c in ("poc", "vah", "val")])


_AV = lambda c, n: f"case when count({c}) over (partition by symbol order by t rows between {n - 1} preceding and current row) >= {n} then avg({c}) over (partition by symbol order by t rows between {n - 1} preceding and current row) end"
_AGO = lambda c, k: f"coalesce(lag({c}, {k}) over (partition by symbol order by t), false)"
_SETUPS = f"""{BARS}, b as (select *, case when close > open then volume when close = open then volume * 0.5 else volume * ((high - close) / (high - low + 0.0001)) end as bv, {_AV("volume", 20)} as av,
 case when count(high) over w10 >= 10 then max(high) over w10 - min(low) over w10 end as rs from bars window w10 as (partition by symbol order by t rows between 9 preceding and current row)),
d as (select *, bv - (volume - bv) as delta, {_AV("rs", 50)} as ar from b), e as (select *, {_AV("delta", 5)} as sd from d), f as (select *, lag(sd) over (partition by symbol order by t) as ps from e),
g as (select *, coalesce(sd > 0 and sd > ps, false) as buyers_control, coalesce(sd < 0 and sd < ps, false) as sellers_control, coalesce(volume > av * 2.0 and abs(close - open) / 100.0 < 0.3, false) as absorption, coalesce(rs < ar * 0.6, false) as contraction, coalesce(rs > ar * 1.2 and volume > av * 1.5, false) as expansion from f),
h as (select *, absorption and close > open as au, absorption and close < open as ad from g)
select symbol, t as "timestamp", buyers_control, sellers_control, absorption, absorption and {_AGO("absorption", 1)} as strong_absorption, contraction, expansion,
 ({_AGO("au", 3)} or {_AGO("au", 4)} or {_AGO("au", 5)}) and {_AGO("contraction", 1)} and expansion and close > open and coalesce(sd > 0, false) as triple_a_long,
 ({_AGO("ad", 3)} or {_AGO("ad", 4)} or {_AGO("ad", 5)}) and {_AGO("contraction", 1)} and expansion and close < open and coalesce(sd < 0, false) as triple_a_short from h"""


@REGISTRY.query("bar_setups", f"with {_SETUPS}")
def bar_setups(spark, sf_dir):
    """Control, absorption, contraction, expansion and the three-step setups, for a volatility of 100."""
    b = N.bar_indicators(bars(spark, sf_dir).withColumn("atr", F.lit(100.0)))
    return b.select("symbol", "timestamp", "buyers_control", "sellers_control", "absorption", "strong_absorption", "contraction", "expansion", "triple_a_long", "triple_a_short")


@REGISTRY.query("bar_signals")
def bar_signals(spark, sf_dir):
    return N.combined_signals(_indicated(spark, sf_dir)).select("symbol", "timestamp", F.round("atr", 7).alias("atr"), "absorption", "strong_absorption", "contraction", "expansion", "triple_a_long", "triple_a_short", "orb_long", "orb_short", "in_session", "poc", "vah", "val", "signal")


@REGISTRY.query("bar_strategy")
def bar_strategy(spark, sf_dir):
    return N.strategy_trades(materialize(N.combined_signals(_indicated(spark, sf_dir)), "signals"))
