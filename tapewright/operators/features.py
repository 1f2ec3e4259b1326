"""Event-level order-flow features with strictly causal thresholds.

Row frames run over shards with a halo (``functions.halo``), so no symbol is one task; expanding quantiles are exact and distributed
(``functions.expanding``). Sums go through decimals, so that results do not depend on where shards begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import finite, require_columns, with_positions
from tapewright.functions.expanding import SHARD_ROWS as QUANTILE_ROWS
from tapewright.functions.expanding import expanding_quantiles
from tapewright.functions.halo import BUCKET_MS, SHARD_ROWS, over_shards
from tapewright.operators.audit import order_statistics

WINDOWS, LOCATION_WINDOWS, GAP, SPEED_CAP, MIN_DT_MS = (20, 50, 100), (200, 500), 10, 1000.0, 1
INPUT = ["symbol", "seq", "timestamp", "price", "quantity", "delta"]

#: Quantiles of prior rows: {name: (column, quantile, least number of values)}.
THRESHOLDS = {
    "vol_p80_50": ("volume_50", 0.80, 50), "range_p30_50": ("range_50", 0.30, 50),
    "pressure_q1": ("pressure_50", 1 / 3, 100), "pressure_q2": ("pressure_50", 2 / 3, 100),
    "speed_q1": ("speed_50", 1 / 3, 100), "speed_q2": ("speed_50", 2 / 3, 100),
    "range_q1": ("range_50", 1 / 3, 100), "range_q2": ("range_50", 2 / 3, 100),
}


_HELPERS = {f"{k}{n}" for k in ("_cd", "_cq", "_cp") for n in ("", "n")} | {f"_{x}{k}" for x in "hl" for k in range(64)}
#: Internal running columns: sums of delta, quantity and price, counts of their values.
_RUNNING = {"_cd": "delta", "_cq": "quantity", "_cp": "price"}


def _running(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Running sums (decimal, so that differences are exact) and counts: any frame's sum is then the difference of two rows."""
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {k: F.sum(F.col(c).cast("decimal(28,8)")).over(f) for k, c in _RUNNING.items()}
    return df.withColumns({**sums, **{f"{k}n": F.count(c).over(f) for k, c in _RUNNING.items()}})


def _extremes(df: DataFrame, w: WindowSpec, longest: int) -> DataFrame:
    """Highest and lowest price of the last 1, 2, 4, ... rows, each from two of the step before: a frame of any length is then covered by two of them."""
    df, k = df.withColumns({"_h0": F.col("price"), "_l0": F.col("price")}), 0
    while 2 ** (k + 1) <= longest:
        df = df.withColumns({f"_h{k + 1}": F.greatest(f"_h{k}", F.lag(f"_h{k}", 2**k).over(w)), f"_l{k + 1}": F.least(f"_l{k}", F.lag(f"_l{k}", 2**k).over(w))})
        k += 1
    return df


def _frame(w: WindowSpec, n: int, shift: int = 0):
    """Sum, count, highest and lowest of the ``n`` rows that end ``shift`` rows before this one."""
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    total = lambda c: (back(c, shift) - F.coalesce(F.lag(c, n + shift).over(w), F.lit(0))).cast("double")
    full = lambda c: back(f"{c}n", shift) - F.coalesce(F.lag(f"{c}n", n + shift).over(w), F.lit(0)) >= n
    k = n.bit_length() - 1
    high = F.greatest(back(f"_h{k}", shift), back(f"_h{k}", shift + n - 2**k))
    low = F.least(back(f"_l{k}", shift), back(f"_l{k}", shift + n - 2**k))
    return total, full, high, low


def rolling_columns(w: WindowSpec, n: int) -> dict[str, Column]:
    """delta, volume, pressure, range and speed over the last ``n`` events."""
    total, full, high, low = _frame(w, n)
    delta, volume = F.when(full("_cd"), total("_cd")), F.when(full("_cq"), total("_cq"))
    dt = F.col("timestamp") - F.lag("timestamp", n).over(w)
    return {
        f"delta_{n}": delta, f"volume_{n}": volume, f"pressure_{n}": F.try_divide(delta, volume), f"range_{n}": F.when(full("_cp"), high - low),
        f"speed_{n}": F.when(dt >= MIN_DT_MS, F.least(n / (dt / 1000.0), F.lit(SPEED_CAP))),
    }


def _direction(t: Column) -> Column:
    return F.when(t > 0, 1).when(t < 0, 0)


def target_columns(w: WindowSpec, n: int) -> dict[str, Column]:
    """Price moves to come: over ``n`` events, and over ``n`` events after a gap."""
    t = F.lead("price", n).over(w) - F.col("price")
    g = F.lead("price", GAP + n).over(w) - F.lead("price", GAP).over(w)
    return {f"target_{n}": t, f"target_direction_{n}": _direction(t), f"target_{n}_gap": g, f"target_direction_{n}_gap": _direction(g)}


def location_columns(w: WindowSpec, n: int) -> dict[str, Column]:
    """High, low and mean of the ``n`` events before, and where the price lies between them."""
    total, full, high, low = _frame(w, n, shift=1)
    high, low = F.when(full("_cp"), high), F.when(full("_cp"), low)
    return {f"rolling_high_{n}": high, f"rolling_low_{n}": low, f"rolling_mean_{n}": F.when(full("_cp"), total("_cp") / n), f"position_{n}": F.try_divide(F.col("price") - low, high - low)}


def location_bin(position: Column) -> Column:
    return F.when(position <= 0.2, "low").when(position >= 0.8, "high").when(position.isNotNull(), "mid")


def event_windows(tape: DataFrame, windows: tuple[int, ...] = WINDOWS, locations: tuple[int, ...] = LOCATION_WINDOWS, targets: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All features of bounded reach, with ``event_idx``. Order is (timestamp, seq); the first rows of a symbol have nulls until a frame is full."""
    require_columns(tape, INPUT)

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        cols: dict[str, Column] = {}
        for n in windows:
            cols |= rolling_columns(w, n)
            if targets:
                cols |= target_columns(w, n)
        for n in locations:
            cols |= location_columns(w, n)
        helped = _extremes(_running(df, w), w, max([*windows, *locations]))
        out = helped.withColumns(cols)
        out = out.drop(*[c for c in out.columns if c in _HELPERS])
        return out.withColumn("location_bin", location_bin(F.col("position_200"))) if 200 in locations else out

    back = max([*windows, *locations]) + 1
    ahead = GAP + max(windows) + 1 if targets else 1
    return over_shards(tape, compute, back, ahead, shard_rows=shard_rows)


def tertile(x: str, q1: str, q2: str, labels: tuple[str, str, str]) -> Column:
    v = F.col(x)
    return F.when(v <= F.col(q1), labels[0]).when((v > F.col(q1)) & (v <= F.col(q2)), labels[1]).when(v > F.col(q2), labels[2])


def causal_bins(df: DataFrame, with_range: bool = True, position: str = "event_idx", quantile_rows: int = QUANTILE_ROWS) -> DataFrame:
    """Absorption flag and thirds of pressure, speed and range against the rows before. A missing threshold gives flag 0 and a null bin."""
    wanted = {k: v for k, v in THRESHOLDS.items() if with_range or not k.startswith("range_q")}
    out = expanding_quantiles(df, wanted, position=position, shard_rows=quantile_rows)
    absorbed = (F.col("volume_50") > F.col("vol_p80_50")) & (F.col("range_50") < F.col("range_p30_50"))
    cols = {
        "absorption_flag": F.coalesce(absorbed, F.lit(False)).cast("int"),
        "pressure_bin": tertile("pressure_50", "pressure_q1", "pressure_q2", ("low", "mid", "high")),
        "speed_bin": tertile("speed_50", "speed_q1", "speed_q2", ("slow", "medium", "fast")),
    }
    if with_range:
        cols["range_bin"] = tertile("range_50", "range_q1", "range_q2", ("low", "medium", "high"))
    return out.withColumns(cols)


FEATURES = (
    ["symbol", "seq", "timestamp", "price", "quantity", "side", "delta", "reconstructed"]
    + [f"{k}_{n}" for k in ("pressure", "delta", "range", "speed") for n in WINDOWS]
    + ["absorption_flag"]
    + [f"{k}_{n}{g}" for g in ("", "_gap") for k in ("target", "target_direction") for n in WINDOWS]
    + ["pressure_bin", "speed_bin", "range_bin"]
    + [f"{k}_{n}" for n in LOCATION_WINDOWS for k in ("rolling_high", "rolling_low", "rolling_mean", "position")]
    + ["location_bin", "volume_50"]
)


def event_features(tape: DataFrame, shard_rows: int = SHARD_ROWS, quantile_rows: int = QUANTILE_ROWS) -> DataFrame:
    """The feature data set: rows whose features and targets are all known and whose gap target of 50 events isn't 0."""
    full = causal_bins(event_windows(tape, shard_rows=shard_rows), quantile_rows=quantile_rows)
    needed = [c for c in FEATURES if c not in ("symbol", "seq", "timestamp", "price", "quantity", "side", "delta", "reconstructed")]
    return full.filter(F.col("target_50_gap") != 0).dropna(subset=needed).select(*FEATURES)


def subsample(df: DataFrame, step: int = 50, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every ``step``-th row of each key in order, from the first on, by exact position."""
    placed = with_positions(df, list(keys), ["timestamp", "seq"], F.floor(F.col("timestamp") / F.lit(BUCKET_MS)))
    return placed.filter(F.col("_pos") % step == 0).drop("_pos", "_bucket", "_before")


def core_features(tape: DataFrame, step: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Features of 50 events at every ``step``-th event (1-based count of valid trades) whose features are known."""
    valid = tape.filter(finite(F.col("price")) & finite(F.col("quantity")) & F.col("timestamp").isNotNull() & (F.col("price") > 0) & (F.col("quantity") > 0))
    w = event_windows(valid, windows=(50,), locations=(), targets=False, shard_rows=shard_rows)
    keep = ((F.col("event_idx") + 1) % step == 0) & F.col("pressure_50").isNotNull() & F.col("volume_50").isNotNull() & F.col("range_50").isNotNull() & F.col("speed_50").isNotNull()
    return w.filter(keep).select("symbol", "seq", "timestamp", "price", "delta", "pressure_50", "speed_50", "range_50", "volume_50")


def core_regime(core: DataFrame) -> DataFrame:
    """Bins and regime of ``core_features``, thresholds over the sampled rows before."""
    placed = with_positions(core, ["symbol"], ["timestamp", "seq"], F.floor(F.col("timestamp") / F.lit(BUCKET_MS))).withColumnRenamed("_pos", "event_idx").drop("_bucket", "_before")
    out = causal_bins(placed, with_range=False).withColumn("regime", regime())
    return out.dropna(subset=["pressure_bin", "speed_bin"])


def regime() -> Column:
    trend = (F.col("absorption_flag") == 0) & F.col("pressure_bin").isin("high", "low") & F.col("speed_bin").isin("fast", "medium")
    return F.when(F.col("absorption_flag") == 1, "conflict").when(F.coalesce(trend, F.lit(False)), "trend").otherwise("neutral")


def feature_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: nulls, NaN, infinite values, min, median, max and 99th percentile (exact, linear)."""
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns]))
    x = df.select(per.alias("x")).select("x.*")
    good = F.when(finite(F.col("v")), F.col("v"))
    counts = x.groupBy("field").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.isnan("v")).alias("nans"), F.count_if(F.abs("v") == float("inf")).alias("infs"), F.min(good).alias("min"), F.max(good).alias("max"))
    return counts.join(order_statistics(x, "field", "v", {"median": 0.5, "p99": 0.99}, {}).drop("n"), "field", "left")


def bin_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows are in each bin: ``field``, ``bin``, ``n``."""
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("bin")) for c in columns]))
    return df.select(per.alias("x")).select("x.*").filter("bin is not null").groupBy("field", "bin").agg(F.count(F.lit(1)).alias("n"))
