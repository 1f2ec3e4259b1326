"""Queries over trade tapes: scans, candles, large trades, session profiles, auction context and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.common import work_path
from tapewright.operators import profile as P
from tapewright.operators.candles import candles, marker_sizes, order_bubbles
from tapewright.plans.registry import Registry, table
from tapewright.sources import tape as S
from tapewright.sources.export import write_jsonl
from tapewright.streaming.live import record

REGISTRY = Registry()

TAPE = """tape as (select 'EVT' as symbol, event_id as seq, epoch_us(ts) // 1000 as "timestamp", value as price,
 cast(json_extract_string(props, '$.k') as double) + 1 as qty, event_type in ('click', 'view') as is_buyer_maker from events)"""
LTAPE = """ltape as (select 'L' || l_linestatus as symbol, l_orderkey as seq, epoch_us(l_shipdate) // 1000 as "timestamp", l_extendedprice / l_quantity as price,
 l_quantity as qty, l_returnflag = 'R' as is_buyer_maker from lineitem)"""
SESSION = "strftime(make_timestamp(({c} - 48600000) * 1000), '%Y-%m-%d')"
DEC = "cast(sum(cast({x} as decimal(28,8))) as double)"
START, END = "2024-01-05T13:30:00+00:00", "2024-01-09T13:30:00+00:00"


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trades_from_events(spark, sf_dir)


@REGISTRY.query("trades_window", f"""with {TAPE} select * from tape where "timestamp" >= {S.to_utc_ms(START)} and "timestamp" < {S.to_utc_ms(END)}""")
def trades_window(spark, sf_dir):
    return S.trades_window(tape(spark, sf_dir), START, END)


@REGISTRY.query("trades_norm", f"""with {LTAPE} select symbol, seq, cast("timestamp" as bigint) as "timestamp", price, qty, is_buyer_maker from ltape""")
def trades_norm(spark, sf_dir):
    return S.normalize_trades(S.trades_from_lineitem(spark, sf_dir))


#: The events as JSON lines of both shapes, some of them bad: the input of the line parser, in Spark and in SQL.
_LINES_SQL = f"""{TAPE}, lines as (select seq, "timestamp" as t, price, qty, is_buyer_maker, seq % 7 as k from tape)"""


def _feature_lines(spark, sf_dir) -> DataFrame:
    t = tape(spark, sf_dir)
    k = F.col("seq") % 7
    side = F.when(F.col("is_buyer_maker"), "SELL").otherwise("buy")
    raw = F.to_json(F.struct(F.col("timestamp").alias("timestamp"), "price", F.col("qty").cast("string").alias("quantity"), side.alias("side")))
    delta = F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty"))
    wrapped = F.to_json(F.struct(F.col("timestamp").alias("ts"), F.struct("price", delta.alias("delta")).alias("flow")))
    bad = F.to_json(F.struct(F.col("timestamp").alias("timestamp"), "price", F.lit(0).alias("quantity"), F.lit("hold").alias("side")))
    broken = F.concat(F.lit('{"timestamp": '), F.col("timestamp").cast("string"))
    return t.select(F.when(k < 3, raw).when(k < 5, wrapped).when(k == 5, bad).otherwise(broken).alias("value"))


@REGISTRY.query("parse_two_schema", f"""with {_LINES_SQL} select t as "timestamp", price, qty as quantity, case when is_buyer_maker then 'sell' else 'buy' end as side, k >= 3 as reconstructed, case when is_buyer_maker then -qty else qty end as delta from lines where k < 5""")
def parse_two_schema(spark, sf_dir):
    return S.parse_feature_lines(_feature_lines(spark, sf_dir))[0]


@REGISTRY.query("parse_two_schema_stats", f"""with {_LINES_SQL} select count(*) as total, count(*) filter (k < 5) as parsed, count(*) filter (k >= 5) as bad, count(*) filter (k < 3) as raw, count(*) filter (k in (3, 4)) as reconstructed from lines""")
def parse_two_schema_stats(spark, sf_dir):
    return S.parse_feature_lines(_feature_lines(spark, sf_dir))[1]


@REGISTRY.query("parse_side", f"""with {TAPE} select seq, case seq % 5 when 0 then 'buy' when 1 then 'sell' when 2 then 'buy' when 3 then 'sell' end as side from tape""")
def parse_side(spark, sf_dir):
    k = F.col("seq") % 5
    raw = F.when(k == 0, " BUY").when(k == 1, "-1").when(k == 2, "2.5").when(k == 3, "Sell").otherwise("0")
    return tape(spark, sf_dir).select("seq", S.side_of(raw).alias("side"))


@REGISTRY.query("parse_trade", f"""with {TAPE} select seq, 'binance' as source, 'trade' as type, "timestamp", price, qty as quantity, case when is_buyer_maker then 'sell' else 'buy' end as side from tape where seq % 11 <> 0""")
def parse_trade(spark, sf_dir):
    p = F.when(F.col("seq") % 11 == 0, F.lit("-1")).otherwise(F.col("price").cast("string"))
    body = F.to_json(F.struct(F.col("timestamp").alias("T"), p.alias("p"), F.col("qty").cast("string").alias("q"), F.col("is_buyer_maker").alias("m")))
    return tape(spark, sf_dir).select("seq", S.parse_exchange_message(body).alias("e")).filter("e is not null").select("seq", "e.*")


@REGISTRY.query("tape_validation", """
with d as (select price, qty, "timestamp" as t, is_buyer_maker as m from trade_deliveries)
select count(*) as total_rows, count(*) filter (price > 0 and not isinf(price) and not isnan(price) and qty > 0 and not isinf(qty) and not isnan(qty) and t is not null and m is not null) as valid_rows,
 count(*) filter (price <= 0 and not isinf(price)) as non_positive_price, count(*) filter (qty <= 0 and not isinf(qty)) as non_positive_qty, count(*) filter (t is null) as bad_timestamp, count(*) filter (m is null) as bad_flag from d""")
def tape_validation(spark, sf_dir):
    return S.validate_trades(table(spark, sf_dir, "trade_deliveries"))[1]


@REGISTRY.query("session_of", f"""with {TAPE} select seq, {SESSION.format(c='"timestamp"')} as session_id from tape""")
def session_of(spark, sf_dir):
    return tape(spark, sf_dir).select("seq", S.session_id(F.col("timestamp")).alias("session_id"))


def _candle_sql(ms: int, name: str) -> str:
    first, last = '"timestamp", price, qty, seq', '"timestamp" desc, price desc, qty desc, seq desc'
    return f"""with {TAPE}, b as (select *, "timestamp" // {ms} * {ms} as bucket, case when is_buyer_maker then 'sell' else 'buy' end as side from tape),
c as (select symbol, bucket as timestamp_ms, first(price order by {first}) as open, max(price) as high, min(price) as low, first(price order by {last}) as close,
 {DEC.format(x="qty")} as volume, {DEC.format(x="case when side = 'buy' then qty else 0 end")} as buy_volume, {DEC.format(x="case when side = 'sell' then qty else 0 end")} as sell_volume,
 {DEC.format(x="case when side = 'buy' then qty else -qty end")} as delta, count(*) as trade_count, count(*) filter (side = 'buy') as buy_trade_count, count(*) filter (side = 'sell') as sell_trade_count,
 max(qty) as largest_trade_qty, first(side order by qty desc, "timestamp", price, seq) as largest_trade_side from b group by symbol, bucket)
select symbol, '{name}' as timeframe, timestamp_ms, open, high, low, close, volume, buy_volume, sell_volume, delta, trade_count, buy_trade_count, sell_trade_count, largest_trade_qty, largest_trade_side,
 close - open as price_change, high - low as range, abs(close - open) as body, high - greatest(open, close) as upper_wick, least(open, close) - low as lower_wick from c"""


def _candle_query(name: str):
    return lambda spark, sf_dir: candles(tape(spark, sf_dir), name)


for _name, _ms in (("1m", 60_000), ("5m", 300_000), ("15m", 900_000)):
    REGISTRY.query(f"ohlcv_{_name}", _candle_sql(_ms, _name))(_candle_query(_name))

_BUBBLES = f"""b as (select *, price * qty as notional, qty / 6.0 as r1, price * qty / 1500.0 as r2 from tape where qty >= 6.0 or price * qty >= 1500.0),
s as (select *, case when r1 >= 1 and r2 >= 1 then 'qty+notional' when r1 >= 1 then 'qty' else 'notional' end as threshold_mode,
 case when r1 >= 1 and r2 >= 1 then greatest(r1, r2) when r1 >= 1 then r1 else r2 end as score from b)"""
_BUBBLE_ROW = """symbol, seq, 'agg_trade' as bubble_type, 'confirmed' as bubble_status, "timestamp" as timestamp_ms, "timestamp" // 60000 * 60000 as minute_bucket_ms, price, qty, notional,
 case when is_buyer_maker then 'sell' else 'buy' end as aggressive_side, threshold_mode,
 cast(case threshold_mode when 'qty+notional' then case when r1 >= r2 then 6.0 else 1500.0 end when 'qty' then 6.0 else 1500.0 end as double) as threshold_value, score as bubble_size_score,
 case when score >= 3.0 then 'extreme' when score >= 1.75 then 'large' else 'medium' end as bubble_tier"""


@REGISTRY.query("order_bubbles", f"with {TAPE}, {_BUBBLES} select {_BUBBLE_ROW} from s")
def bubbles(spark, sf_dir):
    return order_bubbles(tape(spark, sf_dir), min_qty=6.0, min_notional=1500.0)


@REGISTRY.query("marker_sizes", f"with {TAPE}, {_BUBBLES} select symbol, seq, least(8 + 8 * score, 40.0) as marker_size from s")
def sizes(spark, sf_dir):
    return marker_sizes(order_bubbles(tape(spark, sf_dir), min_qty=6.0, min_notional=1500.0)).select("symbol", "seq", "marker_size")


@REGISTRY.query("bubble_hover", f"""with {TAPE}, {_BUBBLES}, r as (select {_BUBBLE_ROW} from s) select symbol, seq, aggressive_side || ' | ' || threshold_mode || ' | ' || bubble_tier as hover from r""")
def hover(spark, sf_dir):
    return order_bubbles(tape(spark, sf_dir), min_qty=6.0, min_notional=1500.0).select("symbol", "seq", F.concat_ws(" | ", "aggressive_side", "threshold_mode", "bubble_tier").alias("hover"))


BINS = f"""{TAPE}, st as (select *, {SESSION.format(c='"timestamp"')} as session_id from tape),
edges as (select symbol, session_id, min(price) as session_low, max(price) as session_high, (max(price) - min(price)) / 50 as bin_width from st group by 1, 2),
placed as (select st.*, coalesce(least(greatest(cast(floor((price - session_low) / nullif(bin_width, 0)) as int), 0), 49), 0) as bin_index from st join edges using (symbol, session_id)),
sums as (select symbol, session_id, bin_index, {DEC.format(x="case when not is_buyer_maker then qty else 0 end")} as bv, {DEC.format(x="case when is_buyer_maker then qty else 0 end")} as sv, {DEC.format(x="qty")} as tv from placed group by 1, 2, 3),
frame as (select *, unnest(range(50)) as bin_index from edges),
bins as (select symbol, session_id, session_low, session_high, bin_width, cast(bin_index as int) as bin_index, session_low + bin_index * bin_width as bin_low, session_low + bin_index * bin_width + bin_width as bin_high,
 coalesce(bv, 0) as buy_volume, coalesce(sv, 0) as sell_volume, coalesce(tv, 0) as total_volume, coalesce(bv, 0) - coalesce(sv, 0) as delta from frame left join sums using (symbol, session_id, bin_index))"""
POC = """poc as (select symbol, session_id, first(bin_index order by total_volume desc, bin_index) as poc_bin_index, first((bin_low + bin_high) / 2 order by total_volume desc, bin_index) as poc_price, max(total_volume) as poc_volume from bins group by 1, 2)"""


def area_sql(tie: str) -> str:
    return f"""{POC},
sided as (select bins.*, poc_bin_index, sign(bin_index - poc_bin_index) as side, abs(bin_index - poc_bin_index) as dist from bins join poc using (symbol, session_id)),
mins as (select *, min(total_volume) over (partition by symbol, session_id, side order by dist rows unbounded preceding) as m from sided),
cums as (select *, coalesce(sum(cast(total_volume as decimal(28,8))) over (partition by symbol, session_id order by (dist = 0) desc, m desc, side {tie}, dist rows between unbounded preceding and 1 preceding), 0) as before,
 sum(cast(total_volume as decimal(28,8))) over (partition by symbol, session_id) as total from mins),
area as (select symbol, session_id, min(bin_low) as val, max(bin_high) as vah, min(bin_index) as val_bin, max(bin_index) as vah_bin from cums where dist = 0 or before < total * 0.7 group by 1, 2)"""


AREA = area_sql("asc")
DENSITY = """sm as (select *, (coalesce(lag(total_volume) over w, total_volume) + total_volume + coalesce(lead(total_volume) over w, total_volume)) / 3.0 as smoothed from bins window w as (partition by symbol, session_id order by bin_index)),
mx as (select *, max(smoothed) over (partition by symbol, session_id) as top from sm),
dens as (select *, case when top > 0 then smoothed / top else 0.0 end as density from mx),
reg as (select *, case when density >= 0.65 then 'hvn' when density <= 0.20 then 'lvn' else 'neutral' end as regime from dens)"""
REGIONS = f"""{DENSITY},
st2 as (select *, case when lag(regime) over w is distinct from regime then 1 else 0 end as s, lag(density) over w as lft, lead(density) over w as rgt from reg window w as (partition by symbol, session_id order by bin_index)),
rn as (select *, sum(s) over (partition by symbol, session_id order by bin_index rows unbounded preceding) as run from st2),
rg as (select symbol, session_id, run, regime, min(bin_index) as start_bin, max(bin_index) as end_bin, first(bin_index order by total_volume desc, bin_index) as dominant_bin, first((bin_low + bin_high) / 2 order by total_volume desc, bin_index) as dominant_price,
 max(density) as max_density, avg(density) as mean_density, first(lft order by bin_index) as l, last(rgt order by bin_index) as r from rn where regime <> 'neutral' group by 1, 2, 3, 4),
regions as (select * from rg where regime = 'hvn' or (l > mean_density * 1.3 and r > mean_density * 1.3))"""


def _bins(spark, sf_dir):
    return P.profile_bins(tape(spark, sf_dir), 50)


@REGISTRY.query("vp_bins", f"with {BINS} select * from bins")
def vp_bins(spark, sf_dir):
    return _bins(spark, sf_dir)


@REGISTRY.query("vp_poc", f"with {BINS}, {POC} select * from poc")
def vp_poc(spark, sf_dir):
    return P.point_of_control(_bins(spark, sf_dir))


@REGISTRY.query("vp_value_area", f"with {BINS}, {AREA} select * from area")
def vp_value_area(spark, sf_dir):
    return P.value_area(_bins(spark, sf_dir))


@REGISTRY.query("vp_value_area_up", f"with {BINS}, {area_sql('desc')} select * from area")
def vp_value_area_up(spark, sf_dir):
    return P.value_area(_bins(spark, sf_dir), tie_up=True)


@REGISTRY.query("vp_density", f"with {BINS}, {DENSITY} select symbol, session_id, bin_index, round(density, 9) as density, regime from reg")
def vp_density(spark, sf_dir):
    return P.density(_bins(spark, sf_dir)).select("symbol", "session_id", "bin_index", F.round("density", 9).alias("density"), "regime")


@REGISTRY.query("vp_regions", f"with {BINS}, {REGIONS} select symbol, session_id, regime, start_bin, end_bin, dominant_bin, dominant_price, round(max_density, 9) as max_density, round(mean_density, 9) as mean_density from regions")
def vp_regions(spark, sf_dir):
    return P.regions(_bins(spark, sf_dir)).withColumns({"max_density": F.round("max_density", 9), "mean_density": F.round("mean_density", 9)})


@REGISTRY.query("session_profile", f"""with {BINS}, {AREA}, {REGIONS},
n as (select symbol, session_id, count(*) filter (regime = 'hvn') as hvn, count(*) filter (regime = 'lvn') as lvn from regions group by 1, 2)
select symbol, session_id, 50 as bins, poc_bin_index, round(poc_volume, 3) as poc_volume, coalesce(hvn, 0) as hvn, coalesce(lvn, 0) as lvn from poc join area using (symbol, session_id) left join n using (symbol, session_id)""")
def session_profile(spark, sf_dir):
    p = P.session_profiles(tape(spark, sf_dir))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c[:3])
    return p.select("symbol", "session_id", "bins", "poc_bin_index", "poc_volume", size("hvn_regions"), size("lvn_regions"))


ZONES = f"""nb as (select bins.*, val, vah, lag(total_volume) over w as p1, lead(total_volume) over w as n1, lag(total_volume, 2) over w as p2, lead(total_volume, 2) over w as n2, lag(abs(delta)) over w as pd, lead(abs(delta)) over w as nd,
 cast(row_number() over (partition by symbol, session_id order by total_volume, bin_index) as int) - 1 as rnk, sum(total_volume) over (partition by symbol, session_id) / 50 as gm from bins join area using (symbol, session_id) window w as (partition by symbol, session_id order by bin_index)),
mm as (select *, (coalesce(p1, 0) + coalesce(n1, 0)) / ((p1 is not null)::int + (n1 is not null)::int) as m1, (coalesce(p2, 0) + coalesce(p1, 0) + coalesce(n1, 0) + coalesce(n2, 0)) / ((p2 is not null)::int + (p1 is not null)::int + (n1 is not null)::int + (n2 is not null)::int) as m2,
 (coalesce(pd, 0) + coalesce(nd, 0)) / ((pd is not null)::int + (nd is not null)::int) as d1, max(case when rnk = 36 then total_volume end) over (partition by symbol, session_id) as q75 from nb),
ft as (select *, total_volume / greatest(m2, 1e-12) as prom, (total_volume - m1) / greatest(m1, 1e-12) as dv, total_volume >= 1.35 * m1 and total_volume >= 1.05 * gm as anom from mm),
zz as (select *, round(prom, 3) as topology_prominence, round(dv, 3) as neighbor_divergence from ft where prom >= 1.6 or (anom and dv >= 0.3) or (total_volume >= q75 and prom >= 1.2 and dv >= 0.12)),
zr as (select *, cast(row_number() over (partition by symbol, session_id order by topology_prominence desc, neighbor_divergence desc, bin_index) as int) as zone_rank from zz)"""


@REGISTRY.query("watch_zones", f"""with {BINS}, {AREA}, {ZONES} select symbol, session_id, zone_rank, bin_index, bin_low as price_low, bin_high as price_high, anom as local_volume_anomaly, abs(delta) >= 1.5 * greatest(d1, 1e-12) as delta_asymmetry,
 case when abs(bin_high - vah) <= bin_width or abs(bin_low - vah) <= bin_width then 'VAH' when abs(bin_low - val) <= bin_width or abs(bin_high - val) <= bin_width then 'VAL' else 'INSIDE_VALUE' end as edge_proximity, neighbor_divergence, topology_prominence from zr where zone_rank <= 6""")
def watch_zones(spark, sf_dir):
    b = _bins(spark, sf_dir)
    return P.watch_zones(b, P.value_area(b))


@REGISTRY.query("auction_context", f"""with {BINS}, {AREA}, {ZONES} select symbol, session_id, count(zone_rank) as zones from area left join (select * from zr where zone_rank <= 6) using (symbol, session_id) group by 1, 2""")
def auction_context(spark, sf_dir):
    b = _bins(spark, sf_dir)
    return P.auction_context(b, P.value_area(b)).select("symbol", "session_id", F.size("watch_zones").cast("long").alias("zones"))


def _balance_sql(join: str) -> str:
    return f"""with {BINS}, {AREA}, cd as (select symbol, '15m' as timeframe, "timestamp" // 900000 * 900000 as timestamp_ms, first(price order by "timestamp" desc, price desc, qty desc, seq desc) as close from tape group by 1, 2, 3),
cs as (select *, {SESSION.format(c="timestamp_ms")} as session_id from cd),
pv as (select symbol, strftime(cast(session_id as date) + interval 1 day, '%Y-%m-%d') as nx, session_id as previous_session_id, val as previous_val, vah as previous_vah from area)
select cs.symbol, timeframe, timestamp_ms, cs.session_id, close, previous_session_id, previous_val, previous_vah, case when previous_val is null then 'unknown' when close > previous_vah then 'above_vah' when close < previous_val then 'below_val' else 'inside' end as location,
 case when previous_val is null then 'unknown' when close between previous_val and previous_vah then 'balance' else 'imbalance' end as balance_state from cs {join} join pv on cs.symbol = pv.symbol and cs.session_id = pv.nx"""


@REGISTRY.query("balance_state", _balance_sql(""))
def balance(spark, sf_dir):
    return P.balance_state(candles(tape(spark, sf_dir), "15m"), P.value_area(_bins(spark, sf_dir)))


@REGISTRY.query("balance_state_left", _balance_sql("left"))
def balance_left(spark, sf_dir):
    return P.balance_state(candles(tape(spark, sf_dir), "15m"), P.value_area(_bins(spark, sf_dir)), keep_unknown=True)


@REGISTRY.query("profile_overlay", f"""with {BINS}, {AREA}, cl as (select symbol, session_id, session_low + 0.1 * (session_high - session_low) as clamp_low, session_high - 0.1 * (session_high - session_low) as clamp_high from edges),
c as (select bins.*, val, vah, greatest(bin_low, clamp_low) as low, least(bin_high, clamp_high) as high from bins join area using (symbol, session_id) join cl using (symbol, session_id) where bin_high >= clamp_low and bin_low <= clamp_high),
k as (select *, max(case when total_volume > 0 then total_volume end) over (partition by symbol, session_id) as tv, max(case when delta <> 0 then abs(delta) end) over (partition by symbol, session_id) as td from c where high > low)
select symbol, session_id, bin_index, low, high, total_volume, delta, bin_low > val and bin_high < vah as in_value_area, round(coalesce(0.65 * (total_volume / tv), 0.0), 9) as volume_width, round(coalesce(0.35 * (abs(delta) / td), 0.0), 9) as delta_width from k""")
def overlay(spark, sf_dir):
    b = _bins(spark, sf_dir)
    span = F.col("session_high") - F.col("session_low")
    clamp = b.filter("bin_index = 0").select("symbol", "session_id", (F.col("session_low") + 0.1 * span).alias("clamp_low"), (F.col("session_high") - 0.1 * span).alias("clamp_high"))
    return P.profile_overlay(b, P.value_area(b), clamp).withColumns({"volume_width": F.round("volume_width", 9), "delta_width": F.round("delta_width", 9)})


@REGISTRY.query("overlay_window", f"""with {BINS} select symbol, session_id, s as overlay_start, s + cast(round(86400000 * 0.35) as bigint) as overlay_end from (select symbol, session_id, epoch_ms(cast(session_id as timestamp)) + 48600000 as s from edges)""")
def overlay_window(spark, sf_dir):
    e = _bins(spark, sf_dir).filter("bin_index = 0")
    start = F.unix_millis(F.to_timestamp(F.concat("session_id", F.lit(" 00:00:00+00:00")), "yyyy-MM-dd HH:mm:ssXXX")) + 48_600_000
    a, b = P.overlay_window(start, start + 86_400_000, 0.35)
    return e.select("symbol", "session_id", a.alias("overlay_start"), b.alias("overlay_end"))


@REGISTRY.query("session_trades", f"""with {TAPE} select *, case when "timestamp" >= {S.session_bounds("2024-01-07")[0]} then 'current' else 'previous' end as session_part from tape where "timestamp" >= {S.session_bounds("2024-01-06")[0]} and "timestamp" < {S.session_bounds("2024-01-07")[1]}""")
def session_trades(spark, sf_dir):
    return S.session_trades(tape(spark, sf_dir), "07012024")


_RELOADED = f"""with {BINS}, {POC} select session_id, symbol, poc_bin_index, round(poc_volume, 3) as poc_volume from poc"""


def _exported(spark, sf_dir) -> DataFrame:
    """Session profiles written as JSON lines, twice, the first time with another volume, and read back."""
    path = work_path(spark, "profiles")
    p = P.session_profiles(tape(spark, sf_dir)).select("symbol", "session_id", F.col("poc_bin_index").cast("int").alias("poc_bin_index"), "poc_volume", "volume_profile")
    write_jsonl(p.withColumn("poc_volume", F.lit(-1.0)), f"{path}/a")
    write_jsonl(p, f"{path}/b")
    return S.read_profiles(spark, f"{path}/*")


@REGISTRY.query("profiles_latest", _RELOADED)
def profiles_latest(spark, sf_dir):
    return S.latest_profiles(_exported(spark, sf_dir), ("symbol", "session_id")).select("session_id", "symbol", F.col("poc_bin_index").cast("int").alias("poc_bin_index"), "poc_volume")


@REGISTRY.query("profile_lookup", f"select session_id, symbol, poc_bin_index, cast(-1 as double) as poc_volume from ({_RELOADED}) where session_id = '2024-01-06'")
def profile_lookup(spark, sf_dir):
    return S.profile_of(_exported(spark, sf_dir), "2024-01-06").select("session_id", "symbol", F.col("poc_bin_index").cast("int").alias("poc_bin_index"), "poc_volume")


_TAPE_ROWS = f"""with {TAPE} select 'EVT' as symbol, row_number() over (order by "timestamp", seq) - 1 as seq, "timestamp", price, qty, is_buyer_maker from tape"""


def _in_order(spark, sf_dir) -> DataFrame:
    """The tape in order of time, in one file's worth of rows."""
    return tape(spark, sf_dir).coalesce(1).sortWithinPartitions("timestamp", "seq")


@REGISTRY.query("csv_trades", _TAPE_ROWS)
def csv_trades(spark, sf_dir):
    """The tape written as headerless CSV of six columns, and read again."""
    path = work_path(spark, "csv")
    t = _in_order(spark, sf_dir)
    t.select("seq", "price", "qty", F.lit(0.0).alias("quote_qty"), "timestamp", "is_buyer_maker").write.csv(f"{path}/trades.csv")
    return S.read_trades(spark, f"{path}/trades.csv", "EVT")


@REGISTRY.query("jsonl_trades", _TAPE_ROWS)
def jsonl_trades(spark, sf_dir):
    """The tape written as exchange messages, and read again."""
    path = work_path(spark, "jsonl")
    write_jsonl(_in_order(spark, sf_dir).select(F.col("timestamp").alias("T"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), F.col("is_buyer_maker").alias("m")), f"{path}/trades.jsonl")
    return S.read_trades(spark, f"{path}/trades.jsonl", "EVT")


_FEATURE_ROWS = f"""with {_LINES_SQL} select 'EVT' as symbol, t as "timestamp", price, qty as quantity, case when is_buyer_maker then 'sell' else 'buy' end as side, {{r}} as reconstructed, case when is_buyer_maker then -qty else qty end as delta from lines{{w}}"""


@REGISTRY.query("features_from_lines", _FEATURE_ROWS.format(r="k >= 3", w=" where k < 5"))
def features_from_lines(spark, sf_dir):
    path = work_path(spark, "lines")
    _feature_lines(spark, sf_dir).write.text(f"{path}/x.jsonl")
    return S.read_features(spark, f"{path}/x.jsonl", "EVT")[0].drop("seq")


@REGISTRY.query("features_from_parquet", _FEATURE_ROWS.format(r="false", w=""))
def features_from_parquet(spark, sf_dir):
    """Two files of different columns: one states the side as a signed number, the other the maker's flag."""
    path, t = work_path(spark, "parquet"), tape(spark, sf_dir)
    t.filter("seq % 2 = 0").select("timestamp", "price", F.col("qty").alias("quantity"), F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0).alias("side")).write.parquet(f"{path}/x/a")
    t.filter("seq % 2 = 1").select("timestamp", "price", "qty", "is_buyer_maker").write.parquet(f"{path}/x/b")
    return S.read_features(spark, f"{path}/x/*", "EVT")[0].drop("seq")


@REGISTRY.query("recorded", f"with {TAPE} select symbol, seq, price from tape")
def recorded(spark, sf_dir):
    """The stream of trades recorded as JSON lines, and read again."""
    path = work_path(spark, "recorded")
    stream = S.events_as_tape(S.stream_files(spark, f"{sf_dir}/events.parquet")).select("symbol", "seq", "price")
    record(stream, path).awaitTermination()
    return spark.read.schema("symbol string, seq long, price double").json(path)


@REGISTRY.query("clean_bars", """select l_extendedprice as open, l_extendedprice as high, l_discount as low, l_tax as close, l_quantity as volume from lineitem where l_quantity <> 7""")
def clean_bars(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("Open"), F.col("l_extendedprice").alias("HIGH"), F.col("l_discount").alias("low"), F.col("l_tax").alias("Close"), F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("Volume"), F.lit("x").alias("Ticker"))
    return S.clean_bars(x)
