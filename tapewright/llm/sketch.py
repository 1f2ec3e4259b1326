"""Percentiles of very large numeric columns with bounded error, from states that can be combined.

Method: randomized compactor hierarchies (KLL): a full level is sorted and every other value, from a random
start, goes one level up with twice the weight; two states merge level by level; a percentile is a value whose rank
is right within a probabilistic bound. The sketches are Spark's own (``kll_sketch_agg_double`` and
its kin): built inside the JVM, partly on the map side, so a group that holds any share of the rows reaches
the shuffle as one state per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns

#: Size of the top compactor. Decides the error and the size of a state (at most some 24 bytes times k).
K = 2048


def rank_error(k: int = K) -> float:
    """Stated bound on |rank of the answer - q|, as a share of the rows.

    It is the published 99 % fit for a KLL sketch of half this size. The error of one of size ``k`` is about half as large, so the bound is that of some five standard
    deviations: kept by all answers of a report, not only by 99 in 100.
    """
    return 2.296 / (k / 2) ** 0.9723


def _valid(col: str) -> Column:
    return F.when(~F.isnan(col), F.col(col))


def sketch_states(df: DataFrame, keys: list[str], values: list[str], row_id: str | None = None, k: int = K) -> DataFrame:
    """One state per group and value column: ``keys``, and for each value ``<value>_n`` and ``<value>_state``.

    ``row_id``: rows that share it count once (its smallest (keys, values), rows without one count each). Defined results: null
    and NaN are left out; a group without values has n 0 and a null state; infinite values count, as
    the largest or smallest; null keys form a group; an empty table gives no row.
    """
    require_columns(df, [*keys, *values, *([row_id] if row_id else [])])
    rows = df.select(*([row_id] if row_id else []), *keys, *[_valid(v).alias(v) for v in values])
    if row_id:
        body = F.struct(*keys, *values)
        # Rows without an id keep one of their own: a hash of nothing shared.
        once = rows.filter(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.min(body).alias("_r")).select("_r.*")
        rows = once.unionByName(rows.filter(F.col(row_id).isNull()).select(*keys, *values))
    aggs = []
    for v in values:
        aggs.append(F.count(v).alias(f"{v}_n"))
        aggs.append(F.expr(f"kll_sketch_agg_double(`{v}`, {k})").alias(f"{v}_state"))
    states = rows.groupBy(*keys).agg(*aggs)
    return states.withColumns({f"{v}_state": F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_state")) for v in values})


def merge_states(states: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """States of coarser groups, from states of finer ones (of other days, partitions or tables)."""
    aggs = []
    for v in values:
        aggs.append(F.sum(f"{v}_n").alias(f"{v}_n"))
        aggs.append(F.expr(f"kll_merge_agg_double(`{v}_state`)").alias(f"{v}_state"))
    merged = states.groupBy(*keys).agg(*aggs)
    return merged.withColumns({f"{v}_state": F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_state")) for v in values})


def percentiles(states: DataFrame, keys: list[str], values: list[str], quantiles: list[float]) -> DataFrame:
    """One row per group and value column: ``keys``, ``field``, ``n``, ``quantiles``, ``answers`` (null for a group without values), ``state``."""
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    per = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"{v}_n").alias("n"), F.col(f"{v}_state").alias("state")) for v in values]))
    rows = states.select(*keys, per.alias("_p")).select(*keys, "_p.*")
    answers = F.when(F.col("state").isNotNull(), F.call_function("kll_sketch_get_quantile_double", F.col("state"), q))
    return rows.select(*keys, "field", "n", q.alias("quantiles"), answers.alias("answers"), "state")


def rank_errors(df: DataFrame, answers: DataFrame, keys: list[str], row_id: str | None = None) -> DataFrame:
    """Exact check of ``percentiles``: per group and field the largest distance of an answer's ranks from the rank asked for (``worst``), and ``n``.

    ``answers`` is a row per group and field; the values meet it by key. Ties: an answer holds all ranks of its equals, so the distance is to the nearest of them.
    """
    fields = [r["field"] for r in answers.select("field").distinct().collect()]
    rows = df.select(*([row_id] if row_id else []), *keys, *[_valid(f).alias(f) for f in fields])
    if row_id:  # as sketch_states has it: rows without an id count one each
        body = F.struct(*keys, *fields)
        once = rows.filter(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.min(body).alias("_r")).select("_r.*")
        rows = once.unionByName(rows.filter(F.col(row_id).isNull()).select(*keys, *fields))
    per = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]))
    tall = rows.select(*keys, per.alias("_x")).select(*keys, "_x.field", "_x.v").filter("v is not null")
    a = answers.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col("field").alias("_f"), "quantiles", "answers")
    cond = tall["field"] == a["_f"]
    for k in keys:
        cond = cond & tall[k].eqNullSafe(a[f"_a_{k}"])
    hit = tall.join(a, cond).select(*keys, "field", "v", F.posexplode(F.arrays_zip("quantiles", "answers")).alias("i", "qa"))
    ranks = hit.groupBy(*keys, "field", "i").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("qa.answers")).alias("below"), F.count_if(F.col("v") <= F.col("qa.answers")).alias("upto"), F.first("qa.quantiles").alias("q"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"), F.lit(0.0))
    return ranks.groupBy(*keys, "field").agg(F.max("n").alias("n"), F.max(off).alias("worst"))
