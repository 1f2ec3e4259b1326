"""Patterns over consecutive feature rows: state sequences, trends, and how each situation resolves.

Row frames run over shards with a halo of ``lookback`` and ``forward`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import materialize, require_columns
from tapewright.functions.halo import SHARD_ROWS, over_shards

REQUIRED = ["symbol", "seq", "timestamp", "price", "pressure_50", "pressure_bin", "speed_50", "speed_bin", "absorption_flag", "location_bin", "regime", "target_50_gap"]


def _yes(c: Column) -> Column:
    """A comparison with a missing value is false, not unknown."""
    return F.coalesce(c, F.lit(False))


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _sequence(col: str, w: WindowSpec, n: int) -> Column:
    items = [F.lag(col, k).over(w) if k else F.col(col) for k in range(n - 1, -1, -1)]
    known = reduce(lambda a, b: a & b, [i.isNotNull() for i in items])
    return F.when(known, F.concat_ws(",", *items))


def _slope(col: str, w: WindowSpec, n: int) -> Column:
    """Least-squares slope over the last ``n`` rows: a fixed linear combination of them."""
    mean = (n - 1) / 2
    denom = sum((i - mean) ** 2 for i in range(n))
    return _sum([F.lit((i - mean) / denom) * (F.lag(col, n - 1 - i).over(w) if i < n - 1 else F.col(col)) for i in range(n)])


def sequence_dataset(tagged: DataFrame, lookback: int = 5, forward: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Feature rows with their state, the sequences that led to it and a label of how it resolved.

    Labels of the last ``forward`` rows of a symbol and sequences of its first ``lookback`` - 1 rows are null. When several
    labels apply the order is reversal, breakout_success, breakout_failure, continuation, no_resolution.
    """
    require_columns(tagged, REQUIRED)
    L, N = lookback, forward

    # Fixed values, here and below: the names of states, patterns and labels, which results show.
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        state = F.when(F.col("pressure_bin") == "high", "strong_up").when(F.col("pressure_bin") == "low", "strong_down").otherwise("neutral")
        d = df.withColumns({
            "state_pressure": state, "state_speed": F.col("speed_bin"), "state_absorption": F.when(F.col("absorption_flag") == 1, "present").otherwise("absent"),
            "state_location": F.col("location_bin"), "state_regime": F.col("regime"),
            "direction_sign": F.when(F.col("pressure_bin") == "high", 1).when(F.col("pressure_bin") == "low", -1).otherwise(0),
        })
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        mean_frame = w.rowsBetween(-(L - 1), 0)
        ahead = range(1, N + 1)
        after = {k: F.lead("state_pressure", k).over(w) for k in ahead}
        flagged = [F.coalesce(F.lead("absorption_flag", k).over(w) == 1, F.lit(False)) for k in ahead]
        other = F.when(F.col("state_pressure") == "strong_up", "strong_down").when(F.col("state_pressure") == "strong_down", "strong_up")
        d = d.withColumns({
            "state_key": F.concat_ws("|", text("regime"), text("state_pressure"), text("location_bin"), text("state_absorption")),
            f"pressure_seq_{L}": _sequence("state_pressure", w, L), f"speed_seq_{L}": _sequence("state_speed", w, L), f"absorption_seq_{L}": _sequence("state_absorption", w, L),
            "_pslope": _slope("pressure_50", w, L), "_sslope": F.try_divide(_slope("speed_50", w, L), F.when(F.count("speed_50").over(mean_frame) >= L, F.avg("speed_50").over(mean_frame))),
            "_same": _sum([_yes(x == F.col("state_pressure")).cast("int") for x in after.values()]), "_opp": _sum([_yes(x == other).cast("int") for x in after.values()]),
            "_fabs": reduce(lambda a, b: a | b, flagged), f"price_move_t_plus_{N}": F.lead("price", N).over(w) - F.col("price"), "future_outcome_sign": F.signum("target_50_gap").cast("int"),
            "_last": F.max("event_idx").over(w.rowsBetween(0, N)) - F.col("event_idx"),
        })
        return d

    d = over_shards(tagged, compute, back=lookback, ahead=forward + 1, shard_rows=shard_rows)
    seq = F.col(f"absorption_seq_{L}")
    pattern = F.when(seq.isNull(), F.lit(None)).when(~seq.contains("present"), "none").when(seq.endswith("present,present"), "persists").when(seq.endswith("present"), "appears").otherwise("fades")
    move, sign = F.col(f"price_move_t_plus_{N}"), F.col("direction_sign")
    aligned = _yes(((sign == 1) & (move > 0)) | ((sign == -1) & (move < 0)))
    against = _yes(((sign == 1) & (move < 0)) | ((sign == -1) & (move > 0)))
    strong = sign != 0
    cont = strong & (F.col("_same") >= 3) & aligned
    fail = strong & (((F.col("_same") <= 1) & ~aligned) | (F.col("_fabs") & (F.col("_opp") >= 1)))
    rev = strong & ((F.col("state_absorption") == "present") | F.col("_fabs")) & (F.col("_opp") >= 2) & against
    valid = _yes(F.col("regime") == "trend") & _yes(F.col("location_bin").isin("low", "high")) & strong
    label = F.when(rev, "reversal").when(valid & cont, "breakout_success").when(valid & fail, "breakout_failure").when(_yes(F.col("regime") == "trend") & cont & ~valid, "continuation").otherwise("no_resolution")
    history, future = F.col("event_idx") >= L - 1, F.col("_last") >= N
    trend = lambda c, up, down, flat: F.when(history, F.when(_yes(F.col(c) > 0.05), up).when(_yes(F.col(c) < -0.05), down).otherwise(flat))
    d = d.withColumns({
        f"pressure_trend_{L}": trend("_pslope", "increasing", "decreasing", "flat"), f"speed_trend_{L}": trend("_sslope", "accelerating", "decelerating", "stable"),
        f"absorption_pattern_{L}": F.when(history, pattern), "resolution_label": F.when(future, label), "context_valid": F.when(future, valid),
        "same_side_count": F.col("_same"), "opposite_side_count": F.col("_opp"),
    })
    winner = F.when(F.col("resolution_label").isin("breakout_success", "continuation"), sign).when(F.col("resolution_label").isin("breakout_failure", "reversal"), -sign).otherwise(0)
    d = d.withColumn("winner_side", winner)
    d = d.withColumn("winner_confirmed", _yes((F.col("winner_side") != 0) & (F.col("winner_side") == F.col("future_outcome_sign"))).cast("int"))
    return d.drop("_pslope", "_sslope", "_same", "_opp", "_fabs", "_last")


def pattern_summary(seq: DataFrame, lookback: int = 5) -> DataFrame:
    """How each (state, pressure trend, absorption pattern) resolved."""
    by = ["state_key", f"pressure_trend_{lookback}", f"absorption_pattern_{lookback}"]
    share = lambda v: F.avg((F.col("resolution_label") == v).cast("double")).alias(f"pct_{v}")
    use = seq.dropna(subset=[*by, "resolution_label"])
    return use.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), share("breakout_success"), share("breakout_failure"), share("reversal"), share("no_resolution"), F.avg("target_50_gap").alias("avg_target_50_gap"))


def resolution_statistics(seq: DataFrame, lookback: int = 5) -> DataFrame:
    """Labels with counts, mean and median target and share of confirmed winners; and two rows of metrics."""
    columns = ["resolution_label", "target_50_gap", "winner_confirmed", "state_absorption", "state_key", f"absorption_pattern_{lookback}"]
    use = materialize(seq.filter(F.col("resolution_label").isNotNull()).select(*columns), "resolved")
    per = use.groupBy("resolution_label").agg(F.count(F.lit(1)).alias("samples"), F.avg("target_50_gap").alias("avg_target_50_gap"), F.percentile("target_50_gap", F.lit(0.5)).alias("median_target_50_gap"), F.avg(F.col("winner_confirmed").cast("double")).alias("winner_confirmation_rate"))
    # A window over a row per label.
    per = per.withColumn("pct_of_total", F.col("samples") / F.sum("samples").over(Window.partitionBy(F.lit(1))))
    none = F.lit(None).cast("double")
    here = F.col("state_absorption") == "present"
    absorbed = use.agg(F.count_if(here).alias("samples"), F.avg(F.when(here, (F.col("resolution_label") == "reversal").cast("double"))).alias("winner_confirmation_rate"))
    absorbed = absorbed.select(F.lit("__metric_absorption_to_reversal_rate__").alias("resolution_label"), "samples", none.alias("avg_target_50_gap"), none.alias("median_target_50_gap"), "winner_confirmation_rate", none.alias("pct_of_total"))
    failures = use.filter("resolution_label = 'breakout_failure'").groupBy("state_key", f"absorption_pattern_{lookback}").agg(F.count(F.lit(1)).alias("n"))
    top = failures.agg(F.coalesce(F.max("n"), F.lit(0)).alias("samples")).select(F.lit("__metric_top_failure_pattern_count__").alias("resolution_label"), "samples", none.alias("avg_target_50_gap"), none.alias("median_target_50_gap"), none.alias("winner_confirmation_rate"), none.alias("pct_of_total"))
    return per.unionByName(absorbed).unionByName(top)
