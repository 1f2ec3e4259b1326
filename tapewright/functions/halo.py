"""Row-frame windows over long tapes, without one task per symbol.

A tape is cut into shards of equal numbers of rows by exact position; each shard gets the rows it looks back on and ahead to as a halo. Bounded
frames, lags and leads inside (key, shard) then equal those over the whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import with_positions

SHARD_ROWS = 16_384
#: Width of the time buckets that positions are counted in.
BUCKET_MS = 3_600_000


def over_shards(df: DataFrame, compute: Callable[[DataFrame, WindowSpec], DataFrame], back: int, ahead: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("timestamp", "seq"), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``compute`` applied to each shard with its halo; ``compute`` gets the rows, with ``event_idx`` (0-based position in the key), and the window
    (key and shard, in order) to build frames of at most ``back`` rows before and ``ahead`` after. Rows of the halo are dropped afterwards.
    """
    if max(back, ahead) > shard_rows:
        raise ValueError("a frame reaches beyond the neighbouring shard")
    placed = with_positions(df, list(keys), list(order), F.floor(F.col(order[0]) / F.lit(BUCKET_MS)))
    placed = placed.drop("_bucket", "_before").withColumnRenamed("_pos", "event_idx")
    own = F.floor(F.col("event_idx") / F.lit(shard_rows))
    at = F.pmod("event_idx", F.lit(shard_rows))
    copies = F.filter(F.array(own, F.when((at < ahead) & (own > 0), own - 1), F.when(at >= shard_rows - back, own + 1)), lambda x: x.isNotNull())
    spread = placed.withColumn("_own", own).withColumn("_shard", F.explode(copies))
    window = Window.partitionBy(*keys, "_shard").orderBy("event_idx")
    return compute(spread, window).filter(F.col("_own") == F.col("_shard")).drop("_own", "_shard")


def running(df: DataFrame, sums: dict[str, Column], maxima: dict[str, Column] | None = None, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("event_idx",), width: int = 65_536, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds running sums and maxima (up to and with each row, null before the first value) of a key, computed inside shards and carried over by one row of totals per shard.

    ``width`` is that of the buckets of ``order[0]`` in which positions are counted.
    """
    both = {**{n: (c, F.sum) for n, c in sums.items()}, **{n: (c, F.max) for n, c in (maxima or {}).items()}}
    placed = with_positions(df.withColumns({f"_run_{n}": c for n, (c, _) in both.items()}), list(keys), list(order), F.floor(F.col(order[0]) / F.lit(width)))
    placed = placed.withColumn("_shard", F.floor(F.col("_pos") / F.lit(shard_rows)))
    inside = Window.partitionBy(*keys, "_shard").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"_in_{n}": f(f"_run_{n}").over(inside) for n, (_, f) in both.items()})
    totals = placed.groupBy(*keys, "_shard").agg(*[f(f"_run_{n}").alias(f"_t_{n}") for n, (_, f) in both.items()])
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_shard").alias("_k"), *[f(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (_, f) in both.items()])
    cond = local["_shard"] == totals["_k"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(totals[f"_k_{k}"])
    joined = local.join(totals, cond)
    joined = joined.withColumns({n: F.greatest(f"_in_{n}", f"_b_{n}") if f is F.max else F.coalesce(F.col(f"_in_{n}") + F.col(f"_b_{n}"), f"_in_{n}", f"_b_{n}") for n, (_, f) in both.items()})
    return joined.drop("_bucket", "_before", "_pos", "_shard", "_k", *[f"_k_{k}" for k in keys], *[f"{p}{n}" for n in both for p in ("_run_", "_in_", "_b_")])
