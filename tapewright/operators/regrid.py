"""Irregular readings onto a regular grid.

Method: shape-preserving monotone cubic interpolation (Fritsch-Carlson slopes) per source segment. The
bars of a series are cut into time shards; the first and last two knots of each shard are exchanged
with the neighbouring shards as halo readings, so that slopes at shard borders are those of the whole
series. Gaps longer than a limit end a segment and stay marked. Everything is JVM-side: the cubic is a
closed form of four knots found by ``lag``/``lead``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.common import epoch_ms, require_columns

#: Milliseconds of the units a timeframe may be written in.
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def timeframe_ms(col: Column) -> Column:
    """'1m', '15m', '2h' ... in milliseconds; null if it can't be read."""
    n = F.regexp_extract(col, r"^(\d{1,9})([smhd])$", 1)
    unit = F.regexp_extract(col, r"^(\d{1,9})([smhd])$", 2)
    size = F.create_map(*[x for k, v in UNIT_MS.items() for x in (F.lit(k), F.lit(v))])
    ms = F.when(n != "", n.cast("long") * F.element_at(size, unit))
    return F.when(ms > 0, ms)


def bar_volumes(df: DataFrame, series: list[str], timeframe: str, ts: str, value: str) -> DataFrame:
    """One knot per bar that has a reading: ``series``, ``_tf``, ``_bar`` (its number since the epoch), ``value``.

    Exact duplicate rows count once; the values of several readings in one bar add up. Rows whose value is
    null or NaN, or whose instant or timeframe is null or unreadable, are no readings.
    """
    require_columns(df, [*series, timeframe, ts, value])
    # Exact duplicates meet by 128 bits of hash of the whole row (hashes skip nulls, so which columns are null is hashed too); map-side combine on both steps.
    every = [F.col(f"`{c}`") for c in df.columns]
    absent = F.concat(*[F.isnull(c).cast("int").cast("string") for c in every])
    hashes = F.struct(F.xxhash64(absent, *every), F.xxhash64(F.lit(7), *every, absent))
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *series, timeframe_ms(F.col(timeframe)).alias("_tf"), epoch_ms(F.col(ts)).alias("_ms"), F.col(value).alias("_v"), hashes.alias("_row")
    )
    rows = rows.filter(F.col("_tf").isNotNull() & F.col("_ms").isNotNull())
    rows = rows.withColumn("_bar", F.call_function("div", F.col("_ms") - F.pmod("_ms", "_tf"), F.col("_tf"))).drop("_ms")
    once = rows.groupBy(*series, "_tf", "_bar", "_row").agg(F.first("_v").alias("_v"))
    return once.groupBy(*series, "_tf", "_bar").agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_n"))


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Slope at a knot between two secants: 0 at an extremum, else their weighted harmonic mean."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    mean = (w1 + w2) / (w1 / d0 + w2 / d1)
    return F.when(d0 * d1 > 0, mean).otherwise(0.0)


def _end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Three-point slope at the end of a segment, kept shape-preserving; ``d0`` is the end's own secant."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    m = F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)
    return m


def regular_grid(df: DataFrame, series: list[str], timeframe: str, ts: str, value: str, max_fill_bars: int = 12, shard_bars: int = 256) -> DataFrame:
    """One row per bar from the first to the last bar with a reading of each series.

    Returns ``series``, ``bucket_ms``, ``value``, ``status``, ``n_readings``. status is 'observed' (sum of
    the bar's readings), 'filled' (monotone cubic between the knots around it, at most ``max_fill_bars``
    missing bars in a row) or 'gap' (more are missing; value null). Segments are bounded by such gaps.

    Defined results: rows without a value, instant or readable timeframe are no readings; a null in a series
    column makes a series of its own; infinite values are readings, but a fill that would use one is
    null with status 'gap'; one reading gives one row; an empty table none; exact duplicate rows count
    once, ties add up; other columns are ignored.
    """
    names = [f"_s{i}" for i in range(len(series))]
    src = df
    knots = bar_volumes(src, series, timeframe, ts, value)
    knots = knots.select(*[F.col(c).alias(n) for c, n in zip(series, names)], "_tf", "_bar", "_v", "_n")
    knots = knots.withColumn("_shard", F.floor(F.col("_bar") / F.lit(shard_bars)))
    key = [*names, "_tf"]
    inside = Window.partitionBy(*key, "_shard").orderBy("_bar")
    whole = Window.partitionBy(*key).orderBy("_bar")
    knot = F.struct(F.col("_bar").alias("x"), F.col("_v").alias("y"))
    local = (
        knots.withColumn("_p1", F.lag(knot, 1).over(inside))
        .withColumn("_q1", F.lead(knot, 1).over(inside))
        .withColumn("_q2", F.lead(knot, 2).over(inside))
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*key, "_shard")))
    )
    at_edge = (F.col("_rn") <= 2) | (F.col("_rn") > F.col("_cnt") - 2)
    # Halo exchange: four knots a shard at most, so the window over a whole series is short.
    edges = local.filter(at_edge)
    edges = (
        edges.withColumn("_hp1", F.lag(knot, 1).over(whole)).withColumn("_hq1", F.lead(knot, 1).over(whole)).withColumn("_hq2", F.lead(knot, 2).over(whole))
        .withColumn("_p1", F.coalesce("_p1", "_hp1"))
        .withColumn("_q1h", F.coalesce("_q1", "_hq1"))
        # The knot after next of the last knot but one is the next shard's first.
        .withColumn("_q2", F.coalesce("_q2", "_hq2"))
        .withColumn("_q1", F.col("_q1h"))
        .drop("_hp1", "_hq1", "_hq2", "_q1h")
    )
    full = local.filter(~at_edge).unionByName(edges).drop("_rn", "_cnt", "_shard")
    return _fill(full, series, names, max_fill_bars)


def _fill(full: DataFrame, series: list[str], names: list[str], max_fill_bars: int) -> DataFrame:
    x0, y0 = F.col("_bar"), F.col("_v")
    x1, y1 = F.col("_q1.x"), F.col("_q1.y")
    h, missing = (x1 - x0).cast("double"), x1 - x0 - 1
    d = (y1 - y0) / h
    limit = F.lit(max_fill_bars + 1)
    hp = (x0 - F.col("_p1.x")).cast("double")
    hn = (F.col("_q2.x") - x1).cast("double")
    has_p = F.col("_p1").isNotNull() & (hp <= limit)
    has_n = F.col("_q2").isNotNull() & (hn <= limit)
    dp, dn = (y0 - F.col("_p1.y")) / hp, (F.col("_q2.y") - y1) / hn
    # At the end of a segment the three-point rule; with two knots only, the straight line.
    m0 = F.when(has_p, _slope(hp, dp, h, d)).when(has_n, _end_slope(h, d, hn, dn)).otherwise(d)
    m1 = F.when(has_n, _slope(h, d, hn, dn)).when(has_p, _end_slope(h, d, hp, dp)).otherwise(d)
    usable = (missing > 0) & (missing <= max_fill_bars)
    coefs = full.select(
        *names, "_tf", "_bar", "_v", "_n", missing.alias("_missing"), h.alias("_h"), y1.alias("_y1"),
        F.when(usable, m0).alias("_m0"), F.when(usable, m1).alias("_m1"),
    )
    # Long gaps unroll in two steps, so that no array grows with the gap.
    step = 4096
    last = F.coalesce(F.col("_missing"), F.lit(0))
    blocks = coefs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last - F.pmod(last, F.lit(step)), F.lit(step).cast("long"))))
    bars = blocks.withColumn("_k", F.explode(F.sequence(F.col("_block"), F.least(last, F.col("_block") + (step - 1)), F.lit(1).cast("long"))))
    t = F.col("_k") / F.col("_h")
    cubic = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("_v") + t * (1 - t) * (1 - t) * F.col("_h") * F.col("_m0")
        + t * t * (3 - 2 * t) * F.col("_y1") + t * t * (t - 1) * F.col("_h") * F.col("_m1")
    )
    finite = cubic.isNotNull() & ~F.isnan(cubic) & (F.abs(cubic) < F.lit(float("inf")))
    observed = F.col("_k") == 0
    fillable = (F.col("_missing") <= max_fill_bars) & finite
    return bars.select(
        *[F.col(n).alias(c) for c, n in zip(series, names)],
        ((F.col("_bar") + F.col("_k")) * F.col("_tf")).alias("bucket_ms"),
        F.when(observed, F.col("_v")).when(fillable, cubic).alias("value"),
        F.when(observed, F.lit("observed")).when(fillable, F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
        F.when(observed, F.col("_n")).otherwise(F.lit(0)).alias("n_readings"),
    )
