"""Queries of the record-quality operators (problems 1 to 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.common import epoch_ms, materialize
from tapewright.operators.dedup import deliver_once
from tapewright.operators.drift import consistent_records, ingest, record_profile, schema_changes
from tapewright.operators.intervals import periods_and_gaps
from tapewright.operators.lineparse import parse_lines
from tapewright.operators.regrid import regular_grid
from tapewright.operators.spikes import find_implausible
from tapewright.plans.registry import Registry, table

REGISTRY = Registry()

#: Milliseconds of an epoch number of any unit, in SQL.
_MS = "case when abs({c}) < 100000000000 then {c} * 1000 when abs({c}) < 100000000000000 then {c} when abs({c}) < 100000000000000000 then {c} // 1000 else {c} // 1000000 end"


@REGISTRY.query(
    "p1_found",
    """
with r as (select symbol, session_id, min_ts a, max_ts b from file_ranges where min_ts <= max_ts),
o as (select *, max(b) over (partition by symbol, session_id order by a, b rows between unbounded preceding and 1 preceding) m from r),
g as (select *, sum(case when m is null or a > m + 1000 then 1 else 0 end) over (partition by symbol, session_id order by a, b rows unbounded preceding) i from o),
p as (select symbol, session_id, min(a) f, max(b) t from g group by symbol, session_id, i),
n as (select *, lead(f) over (partition by symbol, session_id order by f) nx from p)
select symbol, session_id, 'period' as kind, f as from_ts, t as to_ts from n
union all select symbol, session_id, 'gap', t, nx from n where nx is not null
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "file_ranges"), ["symbol", "session_id"], "min_ts", "max_ts")


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_implausible(table(spark, sf_dir, "flow_readings")).select("reading_id", "field").distinct()


@REGISTRY.query(
    "p3_found",
    f"""
with r as (select symbol, timeframe, session_id, {_MS.format(c="timestamp_ms")} ms,
  cast(regexp_extract(timeframe, '^([0-9]+)', 1) as bigint) * case right(timeframe, 1) when 's' then 1000 when 'm' then 60000 when 'h' then 3600000 else 86400000 end tf
  from ohlcv where volume is not null and not isnan(volume)),
b as (select distinct symbol, timeframe, session_id, tf, ms // tf * tf bucket_ms from r),
g as (select symbol, timeframe, session_id, unnest(range(min(bucket_ms), max(bucket_ms) + 1, any_value(tf))) bucket_ms from b group by 1, 2, 3)
select * from g except select symbol, timeframe, session_id, bucket_ms from b
""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).filter("status <> 'observed'").select("symbol", "timeframe", "session_id", "bucket_ms")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "ohlcv"), ["symbol", "timeframe", "session_id"], "timeframe", "timestamp_ms", "volume")


#: The cubic of problem 3 in SQL: secants to both neighbours, Fritsch-Carlson slopes, Hermite basis. A neighbour further than 13 bars is beyond a gap.
_SLOPE = "case when {d0} * {d1} > 0 then (3 * {h1} + 3 * {h0}) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) else 0 end"
_END = "(case when sign({e}) <> sign({d0}) then 0 when sign({d0}) <> sign({d1}) and abs({e}) > 3 * abs({d0}) then 3 * {d0} else {e} end)"


def _end(h0: str, d0: str, h1: str, d1: str) -> str:
    return _END.format(e=f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))", d0=d0, d1=d1)


@REGISTRY.query(
    "p3_grid",
    f"""
with u as (select distinct * from ohlcv where volume is not null and not isnan(volume)),
r as (select symbol, timeframe, session_id, volume, {_MS.format(c="timestamp_ms")} ms,
  cast(regexp_extract(timeframe, '^([0-9]+)', 1) as bigint) * case right(timeframe, 1) when 's' then 1000 when 'm' then 60000 when 'h' then 3600000 else 86400000 end tf from u),
k as (select symbol, timeframe, session_id, tf, ms // tf bar, sum(volume) v, count(*) n from r group by all),
w as (select *, lag(bar) over s pb, lag(v) over s pv, lead(bar) over s qb, lead(v) over s qv, lead(bar, 2) over s nb, lead(v, 2) over s nv from k window s as (partition by symbol, timeframe, session_id order by bar)),
c as (select *, cast(qb - bar as double) h, (qv - v) / (qb - bar) d, case when bar - pb <= 13 then cast(bar - pb as double) end hp, (v - pv) / (bar - pb) dp, case when nb - qb <= 13 then cast(nb - qb as double) end hn, (nv - qv) / (nb - qb) dn from w),
m as (select *, case when hp is not null then {_SLOPE.format(h0="hp", d0="dp", h1="h", d1="d")} when hn is not null then {_end("h", "d", "hn", "dn")} else d end m0,
  case when hn is not null then {_SLOPE.format(h0="h", d0="d", h1="hn", d1="dn")} when hp is not null then {_end("h", "d", "hp", "dp")} else d end m1 from c),
b as (select *, unnest(range(cast(coalesce(h, 1) as bigint))) i from m),
t as (select *, i / h t from b)
select symbol, timeframe, session_id, (bar + i) * tf as bucket_ms, case when i = 0 then 'observed' when h <= 13 then 'filled' else 'gap' end as status, cast(case when i = 0 then n else 0 end as bigint) as n_readings,
  round(case when i = 0 then v when h <= 13 then (1 + 2 * t) * (1 - t) * (1 - t) * v + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * qv + t * t * (t - 1) * h * m1 end, 9) as value from t
""",
)
def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar of every series with its value: observed, filled, or left open in a long gap."""
    return _grid(spark, sf_dir).select("symbol", "timeframe", "session_id", "bucket_ms", "status", F.col("n_readings").cast("long").alias("n_readings"), F.round("value", 9).alias("value"))


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "raw_lines")).filter("reason is not null").select("line_id", "reason")


@REGISTRY.query("p4_loaded")
def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "raw_lines")).filter("reason is null").drop("reason", "detail")


#: Segments of the delivery log: each is judged against the bits that the ones before it committed.
P5_BATCHES = 3


@REGISTRY.query(
    "p5_found",
    f"""
select delivery_id from (select delivery_id, row_number() over (partition by upper(symbol), trade_id, {_MS.format(c='"timestamp"')} order by delivery_id) n
from trade_deliveries where trade_id is not null and symbol is not null and "timestamp" is not null) where n > 1
""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "trade_deliveries")
    _, repeated = deliver_once(trades, [F.upper("symbol"), F.col("trade_id"), epoch_ms(F.col("timestamp"))], "delivery_id", batches=P5_BATCHES)
    return repeated.select("delivery_id")


#: The schema that records are ingested under: the fields of the feeds' first files and the type each must have. Everything else is rescued.
P6_SCHEMA = {
    "timestamp": ("bigint", ["timestamp"]), "price": ("double", ["price"]), "quantity": ("double", ["quantity"]), "qty": ("double", ["qty"]), "side": ("string", ["side"]),
    "ts": ("bigint", ["ts"]), "flow_price": ("double", ["flow.price"]), "flow_delta": ("double", ["flow.delta"]),
    "agg_trade_id": ("bigint", ["agg_trade_id"]), "first_trade_id": ("bigint", ["first_trade_id"]), "last_trade_id": ("bigint", ["last_trade_id"]), "is_buyer_maker": ("boolean", ["is_buyer_maker"]),
}
#: Columns of the consistent table that have a name of their own: type it loads as, fields of the first files. All other fields' columns come from the profile.
P6_TARGET = {
    "event_ts": ("bigint", ["timestamp", "ts"]),
    "price": ("double", ["price", "flow.price"]),
    "quantity": ("double", ["quantity", "qty"]),
    "delta": ("double", ["flow.delta"]),
    "side": ("string", ["side"]),
    "agg_trade_id": ("bigint", ["agg_trade_id"]),
    "first_trade_id": ("bigint", ["first_trade_id"]),
    "last_trade_id": ("bigint", ["last_trade_id"]),
    "is_buyer_maker": ("boolean", ["is_buyer_maker"]),
}


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The records ingested, and the profile of what was typed and rescued. Both written: payloads are read once."""
    records = table(spark, sf_dir, "drift_records").select("record_id", "feed", "feed_kind", "file_no", "payload")
    typed = materialize(ingest(records, "payload", P6_SCHEMA).drop("payload"), "ingested")
    return typed, record_profile(typed, P6_SCHEMA)


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(_ingested(spark, sf_dir)[1])


@REGISTRY.query("p6_records")
def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, profile = _ingested(spark, sf_dir)
    changes = materialize(schema_changes(profile), "changes")
    return consistent_records(typed, P6_SCHEMA, profile, changes, P6_TARGET).drop("feed_kind")
