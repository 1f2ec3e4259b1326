"""Implausible readings: impossible values, spikes and stuck runs per source.

Method: a Hampel filter (rolling median and median absolute deviation) per source, run-length detection
of stuck values, and physical bounds. Readings of a source are cut into shards of equal numbers of
readings by exact position, every shard gets the neighbouring readings it needs as a halo, and each
shard is one numpy task; what needs the whole source (its usual scale, how long it usually repeats a
value) travels as one small row of statistics per shard. A source that holds a third of all readings
is spread over its shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import materialize, require_columns, with_positions


@dataclass(frozen=True)
class SpikeRule:
    """How one field is judged. Half widths of the rolling median and of the rolling deviation, in readings."""

    field: str
    half_width: int = 50
    scale_half_width: int = 50


PRICE = SpikeRule("price", half_width=7)
DELTA = SpikeRule("delta")
PRESSURE = SpikeRule("pressure", half_width=7)
RULES = (PRICE, DELTA, PRESSURE)

#: Shortest run that can be stuck, longest run ever needed to call it stuck, readings of halo.
MIN_RUN, MAX_RUN, HALO = 10, 64, 192
#: Expected number of genuine readings, and of genuine runs, of a source that would be called implausible by chance.
CHANCE = 1e-3
#: Readings within so many of the usual deviations are never spikes, whatever the tail.
LEAST_SCORE = 6.0


def _impossible(field: str, v: np.ndarray, volume: np.ndarray) -> np.ndarray:
    bad = np.isinf(v)
    if field == "price":
        bad |= v <= 0
    elif field == "pressure":
        bad |= np.abs(v) > 1
    elif field == "delta":
        with np.errstate(invalid="ignore"):
            bad |= np.abs(v) > volume * (1 + 1e-9)
    return bad


def _rolling_median(v: np.ndarray, half: int) -> np.ndarray:
    return pd.Series(v).rolling(2 * half + 1, center=True, min_periods=1).median().to_numpy()


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(v):
        return np.zeros(0, int), np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return start, np.diff(np.r_[start, len(v)])


def _usual(dev: np.ndarray) -> float:
    """A scale that outliers can't move and that isn't 0 for values on a coarse grid."""
    if not len(dev):
        return 0.0
    return float(max(np.median(dev), np.minimum(dev, np.quantile(dev, 0.95)).mean()))


def _tail(scores: np.ndarray) -> tuple[float, float]:
    """(level, slope) of the exponential tail through two upper quantiles of ``scores``: a score is above level + slope ln(1/p) with chance p.

    The quantiles are those above which 1 % and 10 % of the scores lie, fewer than 1 % being implausible; more of a few scores, so that ten lie above.
    """
    n = len(scores)
    high = min(max(0.01, 10 / n), 0.5)
    low = min(10 * high, 0.9)
    top, mid = np.quantile(scores, [1 - high, 1 - low])
    slope = (top - mid) / np.log(low / high)
    return float(top + slope * np.log(high)), float(slope)


def _judge(rule: SpikeRule, pdf: pd.DataFrame, source, core: np.ndarray) -> list[tuple]:
    """Candidates and the statistics row of one field in one shard (rows in order of time)."""
    v = pdf[rule.field].to_numpy(dtype=float, na_value=np.nan)
    isnull = pdf[f"{rule.field}_null"].to_numpy()
    volume = pdf["volume"].to_numpy(dtype=float, na_value=np.inf)
    volume = np.where(np.isnan(volume), np.inf, volume)
    ids = pdf["reading_id"].to_numpy()
    impossible = ~isnull & (np.isnan(v) | _impossible(rule.field, np.where(isnull, 0.5, v), volume))
    out = [(source, rule.field, "impossible", int(i), None, None, None, None) for i in ids[impossible & core]]
    good = np.flatnonzero(~isnull & ~impossible)
    x = v[good]
    inner = core[good]
    if not inner.any():
        return out
    dev = np.abs(x - _rolling_median(x, rule.half_width))
    usual = _usual(dev[inner])
    scale = np.maximum(_rolling_median(dev, rule.scale_half_width), usual)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(dev > 0, dev / scale, 0.0)
    level, slope = _tail(np.minimum(score[inner], 1e12))
    n = int(inner.sum())
    spike = score > max(level + slope * np.log(n / CHANCE), LEAST_SCORE)
    # All that may be a spike by the source's own tail, which isn't known here.
    for i in np.flatnonzero((score > LEAST_SCORE) & inner):
        out.append((source, rule.field, "spike", int(ids[good[i]]), float(dev[i]), float(scale[i]), None, None))
    # Runs: a spike between two equal values doesn't end a run. Values on the bound of a bounded field
    # repeat more often than others and are counted by themselves.
    keep = np.flatnonzero(~spike)
    y, own = x[keep], inner[keep]
    start, length = _runs(y)
    which = np.repeat(np.arange(len(start)), length)
    edge = (np.abs(y) == 1.0) if rule.field == "pressure" else np.zeros(len(y), bool)
    long = length[which] >= MIN_RUN
    first = np.zeros(len(y), bool)
    first[start] = True
    for i in np.flatnonzero(long & own & ~first):
        out.append((source, rule.field, "run_edge" if edge[i] else "run", int(ids[good[keep[i]]]), float(length[which[i]]), None, None, None))
    for flag, name in ((False, "run"), (True, "run_edge")):
        # Runs that begin in the core, without the longest ones.
        mine = own[start] & (edge[start] == flag)
        ln = np.sort(length[mine])
        if len(ln):
            usual_ln = ln[ln < MIN_RUN] if (ln < MIN_RUN).any() else ln[:0]
            out.append((source, rule.field, name + "_stat", None, float(usual_ln.sum()), float(len(usual_ln)), float(ln.sum()), None))
    out.append((source, rule.field, "stat", None, usual, float(n), level, slope))
    return out


_OUT = "source string, field string, kind string, reading_id long, a double, b double, c double, d double"


def find_implausible(df: DataFrame, rules: tuple[SpikeRule, ...] = RULES, shard_readings: int = 20_000, bucket_ms: int = 900_000) -> DataFrame:
    """Implausible values of ``flow_readings``: ``reading_id``, ``field``, ``kind``, ``source``, one row per value and kind.

    A reading is a spike if its distance from the rolling median, in units of the larger of the local and the source's usual deviation, lies beyond what the
    exponential tail of the source's own scores would show ``CHANCE`` times among all its readings; a run is stuck if one as long would be expected ``CHANCE`` times, given how
    often the source repeats a value.

    kind is 'impossible' (NaN, infinite, price <= 0, pressure outside -1..1, delta above buy + sell volume),
    'spike' or 'stuck'. A reading delivered again counts once (the earliest ``arrived_at``, ties by the
    smallest values). Defined results: a null value is never a case; readings without a ts come first, in
    order of their id, readings with a null source form a source of their own; a null volume bounds nothing; an
    empty table gives no row; other columns are ignored.
    """
    fields = [r.field for r in rules]
    require_columns(df, ["reading_id", "source", "ts", "buy_volume", "sell_volume", "arrived_at", *fields])
    row = F.struct("arrived_at", "ts", "source", *fields, (F.col("buy_volume") + F.col("sell_volume")).alias("volume"))
    # Partial aggregation: copies meet before the shuffle where they can.
    once = df.filter(F.col("reading_id").isNotNull()).groupBy("reading_id").agg(F.min(row).alias("r"))
    once = once.select("reading_id", F.col("r.source").alias("source"), F.coalesce("r.ts", F.lit(-(2**62)) + F.pmod("reading_id", F.lit(2**60))).alias("ts"), *[F.col(f"r.{f}").alias(f) for f in fields], F.col("r.volume").alias("volume"))
    placed = with_positions(once, ["source"], ["ts", "reading_id"], F.floor(F.col("ts") / F.lit(bucket_ms)))
    shard = F.floor(F.col("_pos") / F.lit(shard_readings))
    at = F.pmod("_pos", F.lit(shard_readings))
    copies = F.filter(F.array(shard, F.when((at < HALO) & (shard > 0), shard - 1), F.when(at >= shard_readings - HALO, shard + 1)), lambda x: x.isNotNull())
    sharded = placed.select("source", "reading_id", "ts", "volume", *fields, *[F.col(f).isNull().alias(f"{f}_null") for f in fields], shard.alias("_own"), F.explode(copies).alias("_shard"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "reading_id"], kind="stable")
        core = (pdf["_own"] == pdf["_shard"]).to_numpy()
        source = pdf["source"].iloc[0]
        rows = [x for r in rules for x in _judge(r, pdf, source, core)]
        return pd.DataFrame(rows, columns=["source", "field", "kind", "reading_id", "a", "b", "c", "d"]).astype({"reading_id": "Int64"})

    # Candidates and statistics are read apart below: written once, so each shard is judged once.
    return _decide(materialize(sharded.groupBy("source", "_shard").applyInPandas(judge, _OUT), "judged"))


def _decide(found: DataFrame) -> DataFrame:
    """Candidates against what their whole source shows: its usual deviation and the tail of its scores, each the median over its shards (by readings)."""
    # Statistics spread to the candidates by window would put a source
    # into one task; they are aggregated (a row per source and field) and joined instead.
    median = lambda c: F.expr(f"percentile(if(kind = 'stat', {c}, null), 0.5, if(kind = 'stat', cast(b as bigint), 0))")
    stat = found.filter("kind like '%stat'").groupBy("source", "field").agg(
        median("a").alias("usual"), median("c").alias("level"), median("d").alias("slope"), F.expr("sum(if(kind = 'stat', b, 0))").alias("readings"),
        F.expr("sum(if(kind = 'run_stat', a, 0))").alias("n"),
        F.expr("sum(if(kind = 'run_stat', b, 0))").alias("r"),
        F.expr("sum(if(kind = 'run_edge_stat', a, 0))").alias("ne"),
        F.expr("sum(if(kind = 'run_edge_stat', b, 0))").alias("re"),
    )
    stat = stat.select(F.col("source").alias("_s"), F.col("field").alias("_f"), "usual", (F.col("level") + F.col("slope") * F.log(F.col("readings") / CHANCE)).alias("threshold"), "n", "r", "ne", "re")
    cand = found.filter("kind not like '%stat'").select("source", "field", "kind", "reading_id", "a", "b")
    j = cand.join(stat, cand["source"].eqNullSafe(stat["_s"]) & (cand["field"] == stat["_f"]), "left")
    is_edge = F.col("kind") == "run_edge"
    n, r = F.when(is_edge, F.col("ne")).otherwise(F.col("n")), F.when(is_edge, F.col("re")).otherwise(F.col("r"))
    # Rate at which the source repeats a value; half a repeat is added so that it is above 0.
    rate = F.greatest(n - r + 0.5, F.lit(0.5)) / F.greatest(n + 1, F.lit(1.0))
    needed = 1 + F.log(F.greatest(r, F.lit(1.0)) / F.lit(CHANCE)) / -F.log(rate)
    needed = F.least(F.greatest(needed, F.lit(float(MIN_RUN))), F.lit(float(MAX_RUN)))
    keep = (
        (F.col("kind") == "impossible")
        | ((F.col("kind") == "spike") & (F.col("a") > F.greatest("threshold", F.lit(LEAST_SCORE)) * F.greatest(F.col("b"), F.coalesce("usual", F.lit(0.0)))))
        | (F.col("kind").isin("run", "run_edge") & (F.col("a") >= needed))
    )
    return j.filter(keep).select("reading_id", "field", F.regexp_replace("kind", "^run.*", "stuck").alias("kind"), "source")
