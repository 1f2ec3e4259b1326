"""Queries of the research chain: event features, regimes, probability tables, sequences, folds and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import materialize
from tapewright.operators import features as X
from tapewright.operators import regime as R
from tapewright.operators import sequence as Q
from tapewright.plans.market import TAPE, tape
from tapewright.plans.registry import Registry
from tapewright.sources.tape import feature_tape

REGISTRY = Registry()

_O = 'partition by symbol order by "timestamp", seq'
FTAPE = f"""{TAPE}, ftape as (select symbol, seq, "timestamp", price, qty as quantity, case when is_buyer_maker then 'sell' else 'buy' end as side,
 case when is_buyer_maker then -qty else qty end as delta, false as reconstructed, row_number() over ({_O}) - 1 as event_idx from tape)"""


def _full(col: str, n: int, value: str, frame: str) -> str:
    return f"case when count({col}) over ({_O} {frame}) >= {n} then {value} end"


def _rolling_sql(n: int) -> str:
    f = f"rows between {n - 1} preceding and current row"
    s = lambda c: f"cast(sum(cast({c} as decimal(28,8))) over ({_O} {f}) as double)"
    delta, volume = _full("delta", n, s("delta"), f), _full("quantity", n, s("quantity"), f)
    dt = f'("timestamp" - lag("timestamp", {n}) over ({_O}))'
    return f"""{delta} as delta_{n}, {volume} as volume_{n}, {delta} / nullif({volume}, 0) as pressure_{n},
 {_full("price", n, f"max(price) over ({_O} {f}) - min(price) over ({_O} {f})", f)} as range_{n},
 case when {dt} >= 1 then least({n} / ({dt} / 1000.0), 1000.0) end as speed_{n}"""


def _target_sql(n: int) -> str:
    t = f"(lead(price, {n}) over ({_O}) - price)"
    g = f"(lead(price, {n + 10}) over ({_O}) - lead(price, 10) over ({_O}))"
    d = lambda x: f"cast(case when {x} > 0 then 1 when {x} < 0 then 0 end as int)"
    return f"{t} as target_{n}, {d(t)} as target_direction_{n}, {g} as target_{n}_gap, {d(g)} as target_direction_{n}_gap"


def _location_sql(n: int) -> str:
    f = f"rows between {n} preceding and 1 preceding"
    high, low = _full("price", n, f"max(price) over ({_O} {f})", f), _full("price", n, f"min(price) over ({_O} {f})", f)
    mean = _full("price", n, f"cast(sum(cast(price as decimal(28,8))) over ({_O} {f}) as double) / {n}", f)
    return f"{high} as rolling_high_{n}, {low} as rolling_low_{n}, {mean} as rolling_mean_{n}, (price - {low}) / nullif({high} - {low}, 0) as position_{n}"


ROLLING = f"rolled as (select ftape.*, {', '.join(map(_rolling_sql, X.WINDOWS))} from ftape)"
TARGETS = f"tg as (select rolled.*, {', '.join(map(_target_sql, X.WINDOWS))} from rolled)"
LOCATED = f"""lo as (select tg.*, {', '.join(map(_location_sql, X.LOCATION_WINDOWS))} from tg),
located as (select *, case when position_200 <= 0.2 then 'low' when position_200 >= 0.8 then 'high' when position_200 is not null then 'mid' end as location_bin from lo)"""
_PRIOR = "rows between unbounded preceding and 1 preceding"


def _quantile_sql(table: str, names: list[str], key: str = "event_idx") -> str:
    o = f"partition by symbol order by {key}"
    cols = ", ".join(f"case when count({c}) over ({o} {_PRIOR}) >= {m} then quantile_cont({c}, {q!r}) over ({o} {_PRIOR}) end as {n}" for n, (c, q, m) in X.THRESHOLDS.items() if n in names)
    return f"select *, {cols} from {table}"


def _tertile_sql(x: str, p: str, labels: tuple[str, str, str]) -> str:
    a, b, c = labels
    return f"case when {x} <= {p}_q1 then '{a}' when {x} > {p}_q1 and {x} <= {p}_q2 then '{b}' when {x} > {p}_q2 then '{c}' end as {p}_bin"


_FLAG = "cast(coalesce(volume_50 > vol_p80_50 and range_50 < range_p30_50, false) as int) as absorption_flag"
_PBIN, _SBIN, _RBIN = _tertile_sql("pressure_50", "pressure", ("low", "mid", "high")), _tertile_sql("speed_50", "speed", ("slow", "medium", "fast")), _tertile_sql("range_50", "range", ("low", "medium", "high"))
BINNED = f"qt as ({_quantile_sql('located', list(X.THRESHOLDS))}), binned as (select *, {_FLAG}, {_PBIN}, {_SBIN}, {_RBIN} from qt)"
_NEEDED = [c for c in X.FEATURES if c not in ("symbol", "seq", "timestamp", "price", "quantity", "side", "delta", "reconstructed")]
_COLS = ", ".join(f'"{c}"' for c in X.FEATURES)
FEATURES = f"""{FTAPE}, {ROLLING}, {TARGETS}, {LOCATED}, {BINNED}, features as (select {_COLS} from binned where target_50_gap <> 0 and {' and '.join(f'{c} is not null' for c in _NEEDED)})"""
_REGIME = "case when absorption_flag = 1 then 'conflict' when coalesce(absorption_flag = 0 and pressure_bin in ('high', 'low') and speed_bin in ('fast', 'medium'), false) then 'trend' else 'neutral' end as regime"
TAGGED = f"{FEATURES}, tagged as (select *, case pressure_bin when 'high' then 'up' when 'low' then 'down' else 'none' end as direction, {_REGIME} from features)"


def ftape(spark, sf_dir) -> DataFrame:
    return feature_tape(tape(spark, sf_dir))


def features(spark, sf_dir) -> DataFrame:
    """Written once per query: what follows reads it several times."""
    return materialize(X.event_features(ftape(spark, sf_dir)), "features")


def tagged(spark, sf_dir) -> DataFrame:
    return R.tag_regime(features(spark, sf_dir))


_ROLL_COLS = [f"{k}_{n}" for n in X.WINDOWS for k in ("delta", "volume", "pressure", "range", "speed")]


@REGISTRY.query("event_rolling", f"with {FTAPE}, {ROLLING} select symbol, seq, {', '.join(_ROLL_COLS)} from rolled")
def event_rolling(spark, sf_dir):
    return X.event_windows(ftape(spark, sf_dir), locations=(), targets=False).select("symbol", "seq", *_ROLL_COLS)


_TARGET_COLS = [f"{k}_{n}{g}" for n in X.WINDOWS for k in ("target", "target_direction") for g in ("", "_gap")]


@REGISTRY.query("event_targets", f"with {FTAPE}, {ROLLING}, {TARGETS} select symbol, seq, {', '.join(_TARGET_COLS)} from tg")
def event_targets(spark, sf_dir):
    return X.event_windows(ftape(spark, sf_dir), locations=()).select("symbol", "seq", *_TARGET_COLS)


_LOC_COLS = [f"{k}_{n}" for n in X.LOCATION_WINDOWS for k in ("rolling_high", "rolling_low", "rolling_mean", "position")]


@REGISTRY.query("event_location", f"with {FTAPE}, {ROLLING}, {TARGETS}, {LOCATED} select symbol, seq, location_bin, {', '.join(_LOC_COLS)} from located")
def event_location(spark, sf_dir):
    return X.event_windows(ftape(spark, sf_dir), targets=False).select("symbol", "seq", "location_bin", *_LOC_COLS)


@REGISTRY.query("event_bins", f"with {FTAPE}, {ROLLING}, {TARGETS}, {LOCATED}, {BINNED} select symbol, seq, absorption_flag, pressure_bin, speed_bin, range_bin, {', '.join(f'round({c}, 9) as {c}' for c in X.THRESHOLDS)} from binned")
def event_bins(spark, sf_dir):
    b = X.causal_bins(X.event_windows(ftape(spark, sf_dir), windows=(50,), locations=(), targets=False))
    return b.select("symbol", "seq", "absorption_flag", "pressure_bin", "speed_bin", "range_bin", *[F.round(c, 9).alias(c) for c in X.THRESHOLDS])


@REGISTRY.query("event_features", f"with {FEATURES} select * from features")
def event_features(spark, sf_dir):
    return features(spark, sf_dir)


@REGISTRY.query("event_features_subsampled", f"""with {FEATURES}, n as (select *, row_number() over ({_O}) - 1 as rn from features) select * exclude (rn) from n where rn % 50 = 0""")
def event_features_subsampled(spark, sf_dir):
    return X.subsample(features(spark, sf_dir), 50)


@REGISTRY.query("feature_report", f"""with {FEATURES}, u as (unpivot (select pressure_50, speed_50, range_50, volume_50 from features) on pressure_50, speed_50, range_50, volume_50 into name field value v)
select field, cast(0 as bigint) as nulls, cast(0 as bigint) as nans, cast(0 as bigint) as infs, min(v) as min, max(v) as max, round(quantile_cont(v, 0.5), 9) as median, round(quantile_cont(v, 0.99), 9) as p99 from u group by field""")
def feature_report(spark, sf_dir):
    return X.feature_report(features(spark, sf_dir), ["pressure_50", "speed_50", "range_50", "volume_50"]).withColumns({c: F.round(c, 9) for c in ("median", "p99")})


_BINS = ["pressure_bin", "speed_bin", "range_bin", "location_bin"]


@REGISTRY.query("feature_bin_counts", f"with {FEATURES} " + " union all ".join(f"select '{c}' as field, {c} as bin, count(*) as n from features group by 2" for c in _BINS))
def feature_bin_counts(spark, sf_dir):
    return X.bin_counts(features(spark, sf_dir), _BINS)


#: The fold queries and sampled chains use every 5th event: with 1 in 50 the small tables never fill the windows.
CORE_STEP = 5
CORE = f"""{FTAPE}, {ROLLING}, core as (select symbol, seq, "timestamp", price, delta, pressure_50, speed_50, range_50, volume_50 from rolled where (event_idx + 1) % {CORE_STEP} = 0 and pressure_50 is not null and volume_50 is not null and range_50 is not null and speed_50 is not null)"""
_CORE_Q = [n for n in X.THRESHOLDS if not n.startswith("range_q")]


@REGISTRY.query("core_features_50", f"with {CORE} select * from core")
def core_features_50(spark, sf_dir):
    return X.core_features(ftape(spark, sf_dir), CORE_STEP)


@REGISTRY.query("core_regime", f"""with {CORE}, ci as (select *, row_number() over ({_O}) - 1 as event_idx from core), cq as ({_quantile_sql("ci", _CORE_Q)}), cb as (select *, {_FLAG}, {_PBIN}, {_SBIN} from cq), cr as (select *, {_REGIME} from cb)
select symbol, seq, absorption_flag, pressure_bin, speed_bin, regime from cr where pressure_bin is not null and speed_bin is not null""")
def core_regime(spark, sf_dir):
    return X.core_regime(X.core_features(ftape(spark, sf_dir), CORE_STEP)).select("symbol", "seq", "absorption_flag", "pressure_bin", "speed_bin", "regime")


@REGISTRY.query("regime_tag", f"with {TAGGED} select symbol, seq, direction, regime from tagged")
def regime_tag(spark, sf_dir):
    return tagged(spark, sf_dir).select("symbol", "seq", "direction", "regime")


def _prob_sql(by: list[str], least: int | None = None) -> str:
    g = ", ".join(by)
    return f"""with {TAGGED}, p as (select {g}, avg(target_direction_50_gap) as prob_up, count(target_direction_50_gap) as samples from tagged group by {g}) select *, abs(prob_up - 0.5) as edge from p""" + (f" where samples >= {least}" if least else "")


#: The reference's least group size is 10,000; the test tables are smaller.
MIN_SAMPLES = 20


@REGISTRY.query("regime_direction_prob", _prob_sql(["regime", "direction"]))
def regime_direction_prob(spark, sf_dir):
    return R.probability_table(tagged(spark, sf_dir), ["regime", "direction"], "target_direction_50_gap")


_BREAKOUT = ["regime", "direction", "location_bin", "absorption_flag"]


@REGISTRY.query("breakout_failure_table", _prob_sql(_BREAKOUT, MIN_SAMPLES))
def breakout_failure_table(spark, sf_dir):
    return R.probability_table(tagged(spark, sf_dir), _BREAKOUT, "target_direction_50_gap", MIN_SAMPLES)


@REGISTRY.query("best_condition", f"select * from ({_prob_sql(_BREAKOUT, MIN_SAMPLES)}) where regime = 'trend' and direction = 'up' order by edge desc, absorption_flag, direction, location_bin, prob_up, regime, samples limit 1")
def best_condition(spark, sf_dir):
    return R.best_condition(breakout_failure_table(spark, sf_dir), regime="trend", direction="up")


_PTABLE = ["pressure_bin", "speed_bin", "absorption_flag"]


@REGISTRY.query("probability_table", _prob_sql(_PTABLE, MIN_SAMPLES))
def probability_table(spark, sf_dir):
    return R.probability_table(tagged(spark, sf_dir), _PTABLE, "target_direction_50_gap", MIN_SAMPLES)


@REGISTRY.query("regime_duration", f"""with {TAGGED}, c as (select *, case when lag(regime) over ({_O}) is distinct from regime then 1 else 0 end as s from tagged), r as (select *, sum(s) over ({_O} rows unbounded preceding) as run from c),
d as (select symbol, run, regime, count(*) as duration from r group by 1, 2, 3)
select regime, count(*) as count, avg(duration) as mean, round(stddev_samp(duration), 9) as std, min(duration) as min, quantile_cont(duration, 0.25) as q25, quantile_cont(duration, 0.5) as q50, quantile_cont(duration, 0.75) as q75, max(duration) as max from d group by regime""")
def regime_duration(spark, sf_dir):
    return R.duration_stats(tagged(spark, sf_dir)).withColumn("std", F.round("std", 9))


_TRANS = f"""with {TAGGED}, n as (select regime, lead(regime) over ({_O}) as nx from tagged), c as (select regime as from_state, nx as to_state, count(*) as n from n where nx is not null group by 1, 2), s as (select *, n / sum(n) over (partition by from_state) as share from c)"""


@REGISTRY.query("regime_transition", f"{_TRANS} select from_state, to_state, n, share from s")
def regime_transition(spark, sf_dir):
    return R.transitions(tagged(spark, sf_dir))


@REGISTRY.query("regime_transition_matrix", f"""{_TRANS} select from_state, coalesce(max(share) filter (to_state = 'conflict'), 0) as conflict, coalesce(max(share) filter (to_state = 'neutral'), 0) as neutral, coalesce(max(share) filter (to_state = 'trend'), 0) as trend from s group by 1""")
def regime_transition_matrix(spark, sf_dir):
    return R.transition_matrix(tagged(spark, sf_dir), ["conflict", "neutral", "trend"])


@REGISTRY.query("regime_persistence", f"{_TRANS} select from_state as regime, share from s where from_state = to_state")
def regime_persistence(spark, sf_dir):
    return R.transitions(tagged(spark, sf_dir)).filter("from_state = to_state").select(F.col("from_state").alias("regime"), "share")


@REGISTRY.query("regime_dist", f"with {TAGGED}, c as (select regime, count(*) as n from tagged group by 1) select *, n / sum(n) over () as pct from c")
def regime_dist(spark, sf_dir):
    return R.distribution(tagged(spark, sf_dir), "regime")


def _seq_sql(n: int = 5) -> str:
    o = _O
    lag = lambda c, k: f"lag({c}, {k}) over ({o})" if k else c
    seq = lambda c: "case when " + " and ".join(f"{lag(c, k)} is not null" for k in range(n)) + " then " + " || ',' || ".join(lag(c, k) for k in range(n - 1, -1, -1)) + " end"
    mean = (n - 1) / 2
    den = sum((i - mean) ** 2 for i in range(n))
    slope = lambda c: " + ".join(f"({(i - mean) / den!r}) * {lag(c, n - 1 - i)}" for i in range(n))
    lead = lambda c, k: f"lead({c}, {k}) over ({o})"
    same = " + ".join(f"coalesce({lead('sp', k)} = sp, false)::int" for k in range(1, n + 1))
    opp = " + ".join(f"coalesce({lead('sp', k)} = case sp when 'strong_up' then 'strong_down' when 'strong_down' then 'strong_up' end, false)::int" for k in range(1, n + 1))
    fab = " or ".join(f"coalesce({lead('absorption_flag', k)} = 1, false)" for k in range(1, n + 1))
    smean = f"case when count(speed_50) over ({o} rows between {n - 1} preceding and current row) >= {n} then avg(speed_50) over ({o} rows between {n - 1} preceding and current row) end"
    return f"""{TAGGED},
q0 as (select *, row_number() over ({o}) - 1 as idx, count(*) over (partition by symbol) as cnt, case pressure_bin when 'high' then 'strong_up' when 'low' then 'strong_down' else 'neutral' end as sp, case when absorption_flag = 1 then 'present' else 'absent' end as sa,
 case pressure_bin when 'high' then 1 when 'low' then -1 else 0 end as sg from tagged),
q1 as (select *, coalesce(regime, 'nan') || '|' || sp || '|' || coalesce(location_bin, 'nan') || '|' || sa as state_key, {seq('sp')} as pressure_seq_5, {seq('speed_bin')} as speed_seq_5, {seq('sa')} as absorption_seq_5, {slope('pressure_50')} as ps, ({slope('speed_50')}) / nullif({smean}, 0) as ss,
 {same} as same, {opp} as opp, {fab} as fab, lead(price, {n}) over ({o}) - price as mv, cast(sign(target_50_gap) as int) as fs from q0),
q2 as (select *, coalesce((sg = 1 and mv > 0) or (sg = -1 and mv < 0), false) as al, coalesce((sg = 1 and mv < 0) or (sg = -1 and mv > 0), false) as ag, coalesce(regime = 'trend' and location_bin in ('low', 'high') and sg <> 0, false) as cv from q1),
q3 as (select *, sg <> 0 and same >= 3 and al as ct, sg <> 0 and ((same <= 1 and not al) or (fab and opp >= 1)) as fl, sg <> 0 and (sa = 'present' or fab) and opp >= 2 and ag as rv from q2),
q4 as (select *, case when idx < cnt - {n} then case when rv then 'reversal' when cv and ct then 'breakout_success' when cv and fl then 'breakout_failure' when regime = 'trend' and ct and not cv then 'continuation' else 'no_resolution' end end as resolution_label,
 case when idx < cnt - {n} then cv end as context_valid, case when idx >= {n - 1} then case when ps > 0.05 then 'increasing' when ps < -0.05 then 'decreasing' else 'flat' end end as pressure_trend_5,
 case when idx >= {n - 1} then case when ss > 0.05 then 'accelerating' when ss < -0.05 then 'decelerating' else 'stable' end end as speed_trend_5,
 case when idx >= {n - 1} then case when absorption_seq_5 not like '%present%' then 'none' when absorption_seq_5 like '%present,present' then 'persists' when absorption_seq_5 like '%present' then 'appears' else 'fades' end end as absorption_pattern_5 from q3),
q5 as (select *, case when resolution_label in ('breakout_success', 'continuation') then sg when resolution_label in ('breakout_failure', 'reversal') then -sg else 0 end as winner_side from q4),
sq as (select *, cast(winner_side <> 0 and winner_side = fs as int) as winner_confirmed from q5)"""


SEQ = _seq_sql()


def sequences(spark, sf_dir) -> DataFrame:
    return Q.sequence_dataset(tagged(spark, sf_dir))


@REGISTRY.query("sequence_states", f"with {SEQ} select symbol, seq, state_key, pressure_seq_5, speed_seq_5, absorption_seq_5, pressure_trend_5, speed_trend_5, absorption_pattern_5 from sq")
def sequence_states(spark, sf_dir):
    return sequences(spark, sf_dir).select("symbol", "seq", "state_key", "pressure_seq_5", "speed_seq_5", "absorption_seq_5", "pressure_trend_5", "speed_trend_5", "absorption_pattern_5")


@REGISTRY.query("sequence_labels", f"with {SEQ} select symbol, seq, cast(sg as int) as direction_sign, cast(same as int) as same_side_count, cast(opp as int) as opposite_side_count, mv as price_move_t_plus_5, fs as future_outcome_sign, context_valid, resolution_label, cast(winner_side as int) as winner_side, winner_confirmed from sq")
def sequence_labels(spark, sf_dir):
    return sequences(spark, sf_dir).select("symbol", "seq", "direction_sign", "same_side_count", "opposite_side_count", "price_move_t_plus_5", "future_outcome_sign", "context_valid", "resolution_label", "winner_side", "winner_confirmed")


_PCT = ", ".join(f"avg((resolution_label = '{v}')::int) as pct_{v}" for v in ("breakout_success", "breakout_failure", "reversal", "no_resolution"))


@REGISTRY.query("sequence_pattern_summary", f"""with {SEQ} select state_key, pressure_trend_5, absorption_pattern_5, count(*) as samples, {_PCT}, round(avg(target_50_gap), 9) as avg_target_50_gap from sq where resolution_label is not null and pressure_trend_5 is not null and absorption_pattern_5 is not null group by 1, 2, 3""")
def sequence_pattern_summary(spark, sf_dir):
    return Q.pattern_summary(sequences(spark, sf_dir)).withColumn("avg_target_50_gap", F.round("avg_target_50_gap", 9))


@REGISTRY.query("resolution_statistics", f"""with {SEQ}, u as (select * from sq where resolution_label is not null)
select resolution_label, count(*) as samples, round(avg(target_50_gap), 9) as avg_target_50_gap, round(quantile_cont(target_50_gap, 0.5), 9) as median_target_50_gap, avg(winner_confirmed) as winner_confirmation_rate, count(*) / (select count(*) from u) as pct_of_total from u group by 1
union all select '__metric_absorption_to_reversal_rate__', count(*) filter (sa = 'present'), null, null, avg((resolution_label = 'reversal')::int) filter (sa = 'present'), null from u
union all select '__metric_top_failure_pattern_count__', coalesce((select max(c) from (select count(*) as c from u where resolution_label = 'breakout_failure' group by state_key, absorption_pattern_5)), 0), null, null, null, null""")
def resolution_statistics(spark, sf_dir):
    return Q.resolution_statistics(sequences(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("avg_target_50_gap", "median_target_50_gap")})
