"""Regimes, directions, and tables of conditional probability, duration and transition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.common import materialize, require_columns
from tapewright.functions.halo import over_shards
from tapewright.operators.features import regime


def choose_target(columns: list[str], preferred: str | None = None) -> str:
    """The preferred target column, else the one after a gap, else the plain one."""
    for c in (preferred, "target_direction_50_gap", "target_direction_50"):
        if c and c in columns:
            return c
        if c and c == preferred:
            raise ValueError(f"target column not found: {c}")
    raise ValueError("no target column found")


def tag_regime(features: DataFrame) -> DataFrame:
    """Features with ``direction`` (up, down, none) and ``regime`` (conflict, trend, neutral)."""
    require_columns(features, ["pressure_bin", "speed_bin", "absorption_flag"])
    direction = F.when(F.col("pressure_bin") == "high", "up").when(F.col("pressure_bin") == "low", "down").otherwise("none")
    return features.withColumn("direction", direction).withColumn("regime", regime())


def probability_table(df: DataFrame, by: list[str], target: str, min_samples: int | None = None) -> DataFrame:
    """Share of ups and number of samples per group (nulls are groups), with the distance from one half."""
    t = df.groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias("prob_up"), F.count(target).alias("samples")).withColumn("edge", F.abs(F.col("prob_up") - 0.5))
    return t.filter(F.col("samples") >= min_samples) if min_samples is not None else t


def best_condition(table: DataFrame, **equal) -> DataFrame:
    """The row of the largest edge among those that meet the conditions (none if there is none)."""
    for k, v in equal.items():
        table = table.filter(F.col(k) == v)
    return table.orderBy(F.col("edge").desc(), *sorted(c for c in table.columns if c != "edge")).limit(1)


def _runs(df: DataFrame, column: str) -> DataFrame:
    """Runs of equal ``column`` per symbol: where they begin and how long they are. Neighbours are looked up in shards."""
    marked = over_shards(df, lambda d, w: d.withColumn("_prev", F.lag(F.struct(F.col(column).alias("v"))).over(w)), 1, 1)
    marked = materialize(marked.select("symbol", column, "event_idx", "_prev"), "runs")
    starts = marked.filter(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(column))).select("symbol", column, "event_idx")
    ends = marked.groupBy("symbol").agg((F.max("event_idx") + 1).alias("_end"))
    # The next start is that of another run: again within shards of the starts.
    nxt = over_shards(starts.withColumnRenamed("event_idx", "at").withColumn("seq", F.lit(0)), lambda d, w: d.withColumn("_next", F.lead("at").over(w)), 1, 1, order=("at", "seq"))
    return nxt.join(ends, "symbol").select("symbol", column, F.col("at").alias("start"), (F.coalesce("_next", "_end") - F.col("at")).alias("duration"))


def duration_stats(df: DataFrame, column: str = "regime") -> DataFrame:
    """Runs of each regime described: count, mean, std, min, quartiles (linear), max."""
    d = F.col("duration")
    return _runs(df, column).groupBy(column).agg(
        F.count(d).alias("count"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"),
        F.percentile(d, F.lit(0.25)).alias("q25"), F.percentile(d, F.lit(0.5)).alias("q50"), F.percentile(d, F.lit(0.75)).alias("q75"), F.max(d).alias("max"),
    )


def transitions(df: DataFrame, column: str = "regime") -> DataFrame:
    """Share of each next regime among the successors of a regime, in long form. The last row of a symbol has no successor."""
    nxt = over_shards(df, lambda d, w: d.withColumn("_next", F.lead(column).over(w)), 1, 1).filter(F.col("_next").isNotNull())
    c = nxt.groupBy(F.col(column).alias("from_state"), F.col("_next").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def transition_matrix(df: DataFrame, states: list[str], column: str = "regime") -> DataFrame:
    """``transitions`` as a matrix with a column per state, 0 where none occurs."""
    return transitions(df, column).groupBy("from_state").pivot("to_state", states).agg(F.max("share")).fillna(0.0)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
