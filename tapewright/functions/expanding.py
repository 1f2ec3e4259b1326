"""Exact expanding quantiles of a long tape: at each row, over all rows before it.

A window frame that grows with the tape costs its square, and one Python task per symbol can't hold a symbol of a third of all rows. Here the
tape is cut into shards by position. Inside a shard all rows are answered at once by descending a wavelet matrix, bit by bit, for all rows and quantiles of a column
together.

Of the earlier shards a shard needs only the values near the ranks it will ask for, the others being counted. Values get a bucket by exact rank. Counts of values by (shard, bucket) are
summed over shards once per bucket, so what a shard finds before it is one row per bucket, first for groups of buckets, then for the buckets of the few groups that hold a wanted rank. The buckets
found are sent once per column, whatever the number of quantiles. So tables in between grow in proportion to the tape: (rows / shard) x groups, and some two shards' worth of
values per shard and column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.common import materialize, with_positions

#: Rows of a shard and of a bucket of values; groups that buckets are first looked up in; parts that the values of a bucket are sent in.
SHARD_ROWS, BUCKET_ROWS, GROUPS, SALTS = 131_072, 16_384, 256, 16


def kth_of_prefixes(ranks: np.ndarray, length: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of the first ``length`` entries of ``ranks``, for many (length, k) at once."""
    ranks, k, right = ranks.astype(np.int32), k.astype(np.int32), length.astype(np.int32)
    left, out, zeros = np.zeros_like(right), np.zeros_like(right), np.zeros(len(ranks) + 1, np.int32)
    for bit in range(max(int(ranks.max()).bit_length() if len(ranks) else 0, 1) - 1, -1, -1):
        one = ((ranks >> bit) & 1).astype(bool)
        np.cumsum(~one, dtype=np.int32, out=zeros[1:])
        l0, r0 = zeros.take(left), zeros.take(right)
        up = k >= r0 - l0
        np.subtract(k, r0 - l0, out=k, where=up)
        # Entries with the bit set follow those without it.
        left += zeros[-1] - l0
        right += zeros[-1] - r0
        np.copyto(left, l0, where=~up)
        np.copyto(right, r0, where=~up)
        out |= up.astype(np.int32) << np.int32(bit)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return out


def shard_quantiles(base: np.ndarray, values: np.ndarray, total: int, asked: list[tuple[float, int, int]]) -> list[np.ndarray]:
    """Quantiles (linear) at each position of ``values`` over everything before it, one array per (quantile, least number of values, shift) of ``asked``.

    Before the shard there are ``total`` values. ``base`` holds those of them near the wanted ranks, sorted; ``shift`` is the number of earlier values that are below the ones
    near this rank and not in ``base``. nan in ``values`` is no value; below the least number the answer is nan.
    """
    known = ~np.isnan(values)
    grid, ranks = np.unique(np.concatenate([base, values[known]]), return_inverse=True)
    before = np.cumsum(known) - known
    n = total + before
    out = [np.full(len(values), np.nan) for _ in asked]
    if not len(grid):
        return out
    jobs = []
    for i, (q, least, shift) in enumerate(asked):
        at = np.flatnonzero((n >= max(least, 1)))
        pos = q * (n[at] - 1)
        low = np.floor(pos).astype(np.int64)
        jobs.append((i, at, low - shift, pos - low))
    length = np.concatenate([len(base) + before[at] for _, at, _, _ in jobs])
    last = np.maximum(length - 1, 0)
    wanted = np.concatenate([k for _, _, k, _ in jobs])
    found = kth_of_prefixes(ranks.astype(np.int64), np.r_[length, length], np.r_[np.clip(wanted, 0, last), np.clip(wanted + 1, 0, last)])
    found = grid[np.minimum(found, len(grid) - 1)].reshape(2, -1)
    start = 0
    for i, at, k, frac in jobs:
        a, b = found[:, start : start + len(k)]
        start += len(k)
        with np.errstate(invalid="ignore"):
            out[i][at] = np.where(frac > 0, a + (b - a) * frac, a)
    return out


def expanding_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = ("symbol",), position: str = "event_idx", shard_rows: int = SHARD_ROWS, bucket_rows: int | None = None) -> DataFrame:
    """Adds a column per entry of ``wanted`` ({name: (column, quantile, least number of values)}): the quantile over all rows of the key before this one.

    ``position`` numbers the rows of a key from 0. Null and NaN are no values. Linear interpolation, as pandas has it. Repeated values are counted as often as they occur.
    A null key is a key of its own; an empty table gives an empty one. Where no tape is longer than a shard there is nothing before any shard, and nothing is exchanged.
    """
    # Read several times below: written once, whatever it took to make it.
    df = materialize(df, "expanding")
    names = [f"_k{i}" for i in range(len(keys))]
    columns = sorted({c for c, _, _ in wanted.values()})
    value = {c: f"_v{i}" for i, c in enumerate(columns)}
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.floor(F.col(position) / F.lit(shard_rows)).alias("_s"), F.col(position).cast("long").alias("_p"),
        *[F.when(~F.isnan(c), F.col(c)).cast("double").alias(v) for c, v in value.items()],
    )
    longest = df.agg(F.max(position)).first()[0]
    spec = list(wanted.items())
    types = dict(rows.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", _p long, " + ", ".join(f"`_a{i}` double" for i in range(len(spec)))

    def answer(pdf: pd.DataFrame, near: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values("_p", kind="stable")
        out = pdf[[*names, "_p"]].copy()
        for c in columns:
            mine = [(i, q, least, name) for i, (name, (of, q, least)) in enumerate(spec) if of == c]
            total, base, asked = 0, np.zeros(0), [(q, least, 0) for _, q, least, _ in mine]
            if near is not None and len(near):
                here = near[near["c"] == c]
                facts = here[here["name"].notna()]
                if len(facts):
                    total = int(facts["total"].iloc[0])
                    held = here[here["name"].isna()].sort_values("v")
                    base, bucket = held["v"].to_numpy(float), np.sort(held["b"].to_numpy(np.int64))
                    first = {n: (int(b), int(x)) for n, b, x in zip(facts["name"], facts["b"], facts["below"])}
                    asked = [(q, least, first[name][1] - int(np.searchsorted(bucket, first[name][0]))) for _, q, least, name in mine]
            got = shard_quantiles(base, pdf[value[c]].to_numpy(dtype=float, na_value=np.nan), total, asked)
            for (i, _, _, _), a in zip(mine, got):
                out[f"_a{i}"] = a
        return out

    by = rows.groupBy(*names, "_s")
    if longest is None or longest < shard_rows:
        answers = by.applyInPandas(lambda pdf: answer(pdf, None), schema)
    else:
        near = _near(rows, names, value, wanted, shard_rows, bucket_rows or max(shard_rows // 8, 1), int(longest))
        answers = by.cogroup(near.groupBy(*names, "_s")).applyInPandas(answer, schema)
    answers = answers.select(*names, "_p", *[F.when(~F.isnan(f"_a{i}"), F.col(f"_a{i}")).alias(name) for i, (name, _) in enumerate(spec)])
    cond = df[position] == answers["_p"]
    for k, n in zip(keys, names):
        cond = cond & df[k].eqNullSafe(answers[n])
    return df.join(answers, cond, "left").drop(*names, "_p")


def _near(rows: DataFrame, names: list[str], value: dict[str, str], wanted: dict, shard_rows: int, bucket_rows: int, longest: int) -> DataFrame:
    """What each shard needs of the earlier ones: rows of values (``c``, ``b`` their bucket, ``v``), and per wanted name the ``total`` before, the first bucket sent (``b``) and how many values lie ``below`` it."""
    key = [*names, "c"]
    per_column = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(v).alias("v")) for c, v in value.items()]))
    valued = rows.select(*names, "_s", "_p", per_column.alias("_x")).select(*names, "_s", "_p", "_x.c", "_x.v").filter("v is not null")
    ranked = with_positions(valued, key, ["v", "_p"], _value_slice("v")).select(*key, "_s", "_p", "v", F.floor(F.col("_pos") / F.lit(bucket_rows)).alias("b"))
    ranked = materialize(ranked, "ranked")
    cells = materialize(ranked.groupBy(*key, "_s", "b").agg(F.count(F.lit(1)).alias("n")), "cells")
    buckets = longest // bucket_rows + 1
    size = -(-buckets // GROUPS)  # buckets of a group
    groups = -(-buckets // size)
    # What lies before a shard, by groups of buckets: a row per shard and group, summed over the shards of one group at a time.
    shards = rows.select(*names, "_s").distinct().withColumn("c", F.explode(F.array(*[F.lit(c) for c in value])))
    frame = shards.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    coarse = cells.groupBy(*key, "_s", F.call_function("div", F.col("b"), F.lit(size)).alias("g")).agg(F.sum("n").alias("n"))
    coarse = _equal(frame, coarse, [*key, "_s", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over_s = Window.partitionBy(*key, "g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("before", F.coalesce(F.sum("n").over(over_s), F.lit(0)))
    at = Window.partitionBy(*key, "_s")
    coarse = coarse.withColumn("cum", F.sum("before").over(at.orderBy("g"))).withColumn("total", F.sum("before").over(at)).withColumn("own", F.sum("n").over(at)).filter("total > 0")
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("of"), F.lit(float(q)).alias("q")) for n, (c, q, _) in wanted.items()]))
    # Ranks asked for go from q (total - 1) down by at most own and up by at most own + 1.
    low, high = F.floor(F.col("q") * (F.col("total") - 1)) - F.col("own"), F.ceil(F.col("q") * (F.col("total") + F.col("own"))) + 1
    jobs = coarse.withColumn("_a", asked).filter("_a.of = c").select(*key, "_s", "g", "before", "cum", "total", "own", "_a.name", "_a.q").withColumns({"low": low, "high": high})
    chosen = jobs.filter((F.col("cum") > F.col("low")) & (F.col("cum") - F.col("before") <= F.col("high"))).withColumn("under", F.col("cum") - F.col("before"))
    chosen = materialize(chosen.select(*key, "_s", "g", "name", "low", "high", "total", "under"), "chosen")
    # The same by single buckets, for the groups found.
    ask = chosen.select(*key, "_s", "g").distinct().withColumn("b", F.explode(F.sequence(F.col("g") * size, F.col("g") * size + (size - 1))))
    both = ask.select(*key, "_s", "g", "b", F.lit(0).cast("long").alias("n")).unionByName(cells.select(*key, "_s", F.lit(None).cast("long").alias("g"), "b", "n"))
    # A question comes before the counts of its own shard, and sees those of earlier ones.
    over_b = Window.partitionBy(*key, "b").orderBy("_s", F.col("g").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    fine = both.withColumn("before", F.sum("n").over(over_b)).filter("g is not null").drop("n")
    fine = fine.withColumn("cum", F.sum("before").over(Window.partitionBy(*key, "_s", "g").orderBy("b")))
    hit = _equal(chosen, fine, [*key, "_s", "g"], "inner").withColumn("cum", F.col("cum") + F.col("under"))
    hit = hit.filter((F.col("cum") > F.col("low")) & (F.col("cum") - F.col("before") <= F.col("high")))
    hit = materialize(hit.select(*key, "_s", "name", "b", "total", (F.col("cum") - F.col("before")).alias("below")), "hit")
    facts = hit.groupBy(*key, "_s", "name").agg(F.min("b").alias("b"), F.min("below").alias("below"), F.first("total").alias("total"))
    # A bucket near a quantile is needed by every later shard: its values are sent in parts.
    need = hit.select(*key, "b", F.col("_s").alias("_t")).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ranked.withColumn("_salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int"))
    base = _equal(need, salted, [*key, "b", "_salt"], "inner").filter(F.col("_s") < F.col("_t")).select(*key, F.col("_t").alias("_s"), "b", "v")
    empty = {"v": "double", "name": "string", "total": "long", "below": "long"}
    fill = lambda d: d.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in d.columns})
    return fill(base).unionByName(fill(facts))


def _equal(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equal columns, nulls being equal; each of them once in the result."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in on])


def _value_slice(v: str):
    """A bucket number that grows with a double: its leading bits, order-preserving."""
    size = F.floor(F.log2(F.abs(v) + F.lit(2.0**-40)) * 8)
    return F.when(F.col(v) < 0, -(size + 400)).otherwise(size + 400).cast("long")
