"""Helpers shared by the operators: shared work folders, sharding, distributed ranks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is
    ``local`` (tests, a single machine) a temporary folder is made and set. A cluster without it is an
    error: a folder of one machine would lose or split what executors write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by all executors (master {master})")
    base = "file://" + tempfile.mkdtemp(prefix="tapewright-")
    atexit.register(_remove, base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _remove(path: str) -> None:
    """Delete a folder made by this process, at its end."""
    spark = SparkSession.getActiveSession()
    if path.startswith(("file:", "/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    elif spark is not None:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be gone already
            pass


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = os.path.join(shared_dir(spark), f"tapewright-{label}-{uuid.uuid4().hex}")
    atexit.register(_remove, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def epoch_ms(col: Column) -> Column:
    """Epoch number in s, ms, us or ns to whole milliseconds (cut off), by its magnitude.

    Below 1e11 a number counts as seconds, below 1e14 as ms, below 1e17 as us, else as ns:
    the ranges do not meet for instants between 1973 and 5138. Null stays null.
    """
    size = F.abs(col)
    return (
        F.when(size < F.lit(10**11), col * 1000)
        .when(size < F.lit(10**14), col)
        .when(size < F.lit(10**17), _floor_div(col, 1000))
        .otherwise(_floor_div(col, 10**6))
    ).cast("long")


def _floor_div(col: Column, by: int) -> Column:
    """Integer floor division without passing through double."""
    return F.call_function("div", col - F.pmod(col, F.lit(by)), F.lit(by))


def finite(col: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def shard_of(col: str, width: int) -> Column:
    """Number of the shard of ``width`` that a bigint lies in, exact for any bigint."""
    return F.expr(f"{col} div {width} - if({col} % {width} < 0, 1, 0)")


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equi-join condition under which null keys meet null keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def with_positions(df: DataFrame, keys: list[str], order: list[str], bucket: Column, weight: Column | None = None, weight_type: str = "long") -> DataFrame:
    """Exact position (and running weight) of each row within its key, without one task per key.

    ``bucket`` must be monotone in the order of ``order[0]``. Rows are ranked inside
    (key, bucket); the small table of bucket totals gives each bucket its offset. Adds
    ``_pos`` (0-based) and, given ``weight``, ``_before`` (sum of weights before the row).
    A key that holds a third of all rows is spread over its buckets.
    """
    df = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    inner = Window.partitionBy(*part).orderBy(*order)
    w = F.lit(1) if weight is None else weight
    ranked = df.withColumn("_rn", F.row_number().over(inner) - 1).withColumn("_w", w.cast(weight_type))
    ranked = ranked.withColumn("_in", F.sum("_w").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    totals = df.withColumn("_w", w.cast(weight_type)).groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = totals.withColumn("_t0", F.coalesce(F.sum("_t").over(before), F.lit(0).cast(weight_type)))
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in part], "_n0", "_t0")
    cond = F.lit(True)
    for c in part:
        cond = cond & ranked[c].eqNullSafe(totals[f"_k_{c}"])
    joined = ranked.join(totals, cond, "left").drop(*[f"_k_{c}" for c in part])
    joined = joined.withColumn("_pos", F.col("_n0") + F.col("_rn"))
    joined = joined.withColumn("_before", F.col("_t0") + F.coalesce(F.col("_in"), F.lit(0).cast(weight_type)))
    return joined.drop("_rn", "_w", "_in", "_n0", "_t0")

