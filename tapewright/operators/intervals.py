"""Overlapping, nested and gapped time ranges per entity: continuous periods and the gaps between.

Method: ``session_window`` with a row-specific duration merges overlapping ranges natively, once
inside every (entity, time shard); touching periods of different shards are joined afterwards by a
carry of the largest end so far, and gaps come from ``lead``. All work on single ranges is keyed by
(entity, shard), so an entity that holds a third of all ranges is spread over its shards; only
one summary row per shard is handled per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.common import materialize, require_columns, shard_of


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, tolerance_ms: int = 1000, shard_ms: int = 3_600_000) -> DataFrame:
    """Continuous periods per entity.

    Ranges join when the next start is at most ``tolerance_ms`` (0 or more) after the largest end so far.
    Returns ``keys``, ``from_ts``, ``to_ts`` and ``n_ranges``, one row per period.

    Defined results: rows with a null or reversed bound are left out; any two bigints are bounds, however far from today; a range
    of a single instant is a range; repeated rows and ties change nothing; a null key is a key of
    its own; an empty table gives no row; other columns are ignored.
    """
    require_columns(df, [*keys, start, end])
    # Internal names, so that columns of the input can't clash with ours.
    names = [f"_k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"))
    src = src.filter(F.col("_a") <= F.col("_b")).withColumn("_shard", shard_of("_a", shard_ms))
    # Windows run on the offset within the shard. A range that outlasts its shard need only reach the shard's
    # last possible start, so offsets and durations fit a timestamp whatever the bounds; the real ends are aggregated.
    src = src.withColumn("_d", F.least(F.coalesce(F.try_subtract("_b", "_a"), F.lit(shard_ms)), F.lit(shard_ms)))
    # Spark joins sessions whose start is not after the end so far, and drops empty ones: with no
    # tolerance a range lasts a microsecond more, less than the next possible start.
    seconds = "cast(cast(_d + %d as decimal(18,6)) / 1000 + %s as decimal(18,6))" % (tolerance_ms, "0" if tolerance_ms else "0.000001")
    gap = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {seconds})")
    by_shard = [*names, "_shard"]
    local = (
        src.withColumn("_t", F.timestamp_millis(F.pmod("_a", F.lit(shard_ms))))
        .groupBy(*by_shard, F.session_window("_t", gap).alias("_w"))
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
        .drop("_w")
    )
    # Read for the carry and for the periods: written once, so ranges are merged once.
    local = materialize(local, "periods")
    # Largest end in the earlier shards of the entity: one row per shard.
    ends = local.groupBy(*by_shard).agg(F.max("_b").alias("_end"))
    prior = Window.partitionBy(*names).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.max("_end").over(prior)).drop("_end")
    carried = _join_shards(local, carry, by_shard)
    # A period that starts within the carried end goes on with an earlier shard's last period. As
    # the carry is one value a shard, these are the first periods of the shard.
    carried = carried.withColumn("_new", F.col("_carry").isNull() | F.coalesce(F.try_subtract("_a", F.lit(tolerance_ms)) > F.col("_carry"), F.lit(False)))
    shards = carried.groupBy(*by_shard).agg(
        F.max(F.when(F.col("_new"), F.col("_a"))).alias("_last"),
        F.max(F.when(~F.col("_new"), F.col("_b"))).alias("_more"),
        F.sum(F.when(~F.col("_new"), F.col("_n")).otherwise(0)).alias("_more_n"),
    )
    # Ends absorbed by later shards go to the last period begun before them.
    forward = Window.partitionBy(*names).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    owner = shards.withColumn("_owner", F.max("_last").over(forward))
    absorbed = owner.filter(F.col("_more").isNotNull()).groupBy(*names, F.col("_owner").alias("_a")).agg(F.max("_more").alias("_more"), F.sum("_more_n").alias("_more_n"))
    periods = carried.filter("_new").select(*names, "_a", "_b", "_n")
    cond = periods["_a"] == absorbed["_a"]
    for n in names:
        cond = cond & periods[n].eqNullSafe(absorbed[n])
    joined = periods.join(absorbed, cond, "left")
    return joined.select(
        *[periods[n].alias(k) for k, n in zip(keys, names)],
        periods["_a"].alias("from_ts"),
        F.greatest(periods["_b"], F.coalesce(absorbed["_more"], periods["_b"])).alias("to_ts"),
        (periods["_n"] + F.coalesce(absorbed["_more_n"], F.lit(0))).alias("n_ranges"),
    )


def _join_shards(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_r{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_r{c}"])
    return left.join(right, cond, "left").drop(*[f"_r{c}" for c in on])


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, tolerance_ms: int = 1000, shard_ms: int = 3_600_000) -> DataFrame:
    """``merge_ranges`` plus the gaps: ``keys``, ``kind`` ('period' or 'gap'), ``from_ts``, ``to_ts``.

    A gap goes from the end of a period to the start of the next one of the same entity. Same defined
    results as ``merge_ranges``; an entity of one period has no gap.
    """
    periods = materialize(merge_ranges(df, keys, start, end, tolerance_ms, shard_ms), "merged")
    names = [f"_k{i}" for i in range(len(keys))]
    p = periods.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "from_ts", "to_ts")
    p = p.withColumn("_shard", shard_of("from_ts", shard_ms))
    by_shard = [*names, "_shard"]
    inside = Window.partitionBy(*by_shard).orderBy("from_ts")
    p = p.withColumn("_next", F.lead("from_ts").over(inside))
    # The last period of a shard looks at the first start of the next shard that has one.
    first = p.groupBy(*by_shard).agg(F.min("from_ts").alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*names).orderBy("_shard"))).drop("_first")
    p = _join_shards(p, first, by_shard)
    nxt = F.coalesce("_next", "_after")
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_ts").alias("a"), F.col("to_ts").alias("b")),
        F.when(nxt.isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("to_ts").alias("a"), nxt.alias("b"))),
    )
    out = p.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
    return out.select(*keys, F.col("r.kind").alias("kind"), F.col("r.a").alias("from_ts"), F.col("r.b").alias("to_ts"))
