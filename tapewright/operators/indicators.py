"""Bar-level indicators and setups: volatility, average price bands, approximate delta, absorption, expansion, opening range.

Bars: symbol, seq, timestamp, open, high, low, close, volume, ``session_id``. Frames run over shards; the recursive average true range and the strategy's fills are folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import materialize
from tapewright.functions.halo import over_shards
from tapewright.operators.folds import fold_by_symbol
from tapewright.operators.profile import point_of_control, value_area


class _Wilder:
    """Average true range: the mean of the first n true ranges, then a recursive mean of weight 1/n."""

    def __init__(self, n: int) -> None:
        self.n, self.seen, self.value, self.close = n, [], None, None

    def step(self, r: dict) -> list[dict]:
        tr = r["high"] - r["low"] if self.close is None else max(r["high"] - r["low"], abs(r["high"] - self.close), abs(r["low"] - self.close))
        self.close = r["close"]
        if self.value is None:
            self.seen.append(tr)
            if len(self.seen) == self.n:
                self.value = sum(self.seen) / self.n
        else:
            self.value += (tr - self.value) / self.n
        return [{"seq": r["seq"], "timestamp": r["timestamp"], "atr": self.value}]

    def finish(self) -> list[dict]:
        return []


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """``bars`` with ``atr``; null for the first n - 1 bars of a symbol."""
    a = fold_by_symbol(bars, ["seq", "timestamp", "high", "low", "close"], lambda: _Wilder(n), "symbol string, seq long, timestamp long, atr double")
    return bars.join(a.drop("timestamp"), ["symbol", "seq"])


def session_vwap(bars: DataFrame) -> DataFrame:
    """Adds ``vwap``: running volume-weighted average of (high + low + close) / 3 within a session."""
    w = Window.partitionBy("symbol", "session_id").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def buy_volume(o: str = "open", h: str = "high", low: str = "low", c: str = "close", v: str = "volume") -> Column:
    """Buying share of a bar's volume, by where its body closes."""
    return F.when(F.col(c) > F.col(o), F.col(v)).when(F.col(c) == F.col(o), F.col(v) * 0.5).otherwise(F.col(v) * ((F.col(h) - F.col(c)) / (F.col(h) - F.col(low) + 0.0001)))


def bar_indicators(bars: DataFrame, delta_lookback: int = 5, volume_mult: float = 2.0, move_limit: float = 0.3) -> DataFrame:
    """Delta and its control, absorption, contraction, expansion and the three-step setups. ``bars`` hold ``atr``."""
    def mean(c: str, w: WindowSpec, n: int) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(c).over(f) >= n, F.avg(c).over(f))

    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("buy_volume", buy_volume()).withColumn("sell_volume", F.col("volume") - F.col("buy_volume")).withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
        d = d.withColumn("smooth_delta", mean("delta", w, delta_lookback)).withColumn("_avgv", mean("volume", w, 20))
        f10 = w.rowsBetween(-9, 0)
        d = d.withColumn("range_size", F.when(F.count("high").over(f10) >= 10, F.max("high").over(f10) - F.min("low").over(f10))).withColumn("_avgr", mean("range_size", w, 50))
        before = F.lag("smooth_delta").over(w)
        yes = lambda c: F.coalesce(c, F.lit(False))
        d = d.withColumns({
            "delta_momentum": F.sum("delta").over(w.rowsBetween(-(delta_lookback - 1), 0)),
            "buyers_control": yes((F.col("smooth_delta") > 0) & (F.col("smooth_delta") > before)), "sellers_control": yes((F.col("smooth_delta") < 0) & (F.col("smooth_delta") < before)),
            "absorption": yes((F.col("volume") > F.col("_avgv") * volume_mult) & (F.try_divide(F.abs(F.col("close") - F.col("open")), "atr") < move_limit)),
            "contraction": yes(F.col("range_size") < F.col("_avgr") * 0.6), "expansion": yes((F.col("range_size") > F.col("_avgr") * 1.2) & (F.col("volume") > F.col("_avgv") * 1.5)),
        })
        d = d.withColumns({"absorption_up": F.col("absorption") & (F.col("close") > F.col("open")), "absorption_down": F.col("absorption") & (F.col("close") < F.col("open"))})
        ago = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(False))
        some = lambda c: ago(c, 3) | ago(c, 4) | ago(c, 5)
        return d.withColumns({
            "strong_absorption": F.col("absorption") & ago("absorption", 1),
            "triple_a_long": some("absorption_up") & ago("contraction", 1) & F.col("expansion") & (F.col("close") > F.col("open")) & yes(F.col("smooth_delta") > 0),
            "triple_a_short": some("absorption_down") & ago("contraction", 1) & F.col("expansion") & (F.col("close") < F.col("open")) & yes(F.col("smooth_delta") < 0),
        }).drop("_avgv", "_avgr")

    return over_shards(bars, compute, 80, 1)


def exchange_session(bars: DataFrame, start: str = "09:30", end: str = "16:00", zone: str = "America/New_York") -> DataFrame:
    """Adds ``in_session`` (the bar begins in [start, end) by the exchange's clock) and ``session_change`` (the first such bar after one that isn't, or at all)."""
    minutes = lambda t: int(t[:2]) * 60 + int(t[3:])
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(timestamp / 1000 as decimal(18, 6)))"))
    at = F.hour(wall) * 60 + F.minute(wall)

    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("in_session", (at >= minutes(start)) & (at < minutes(end)))
        return d.withColumn("session_change", F.col("in_session") & ~F.coalesce(F.lag("in_session").over(w), F.lit(False)))

    return over_shards(bars.drop("event_idx"), compute, 1, 1)


def rolling_profile(bars: DataFrame, length: int = 50, rows: int = 24) -> DataFrame:
    """Adds ``poc``, ``vah`` and ``val`` of the last ``length`` bars: volume by the row their close lies in, between the lowest low and the highest high; null until there are so many bars.

    A close at the very top lies in no row. Ties of the area go up. Without a range all three are the price.
    """
    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = w.rowsBetween(-(length - 1), 0)
        full = F.count(F.lit(1)).over(f) >= length
        return d.withColumns({"_low": F.when(full, F.min("low").over(f)), "_high": F.when(full, F.max("high").over(f)), "_bars": F.collect_list(F.struct("close", "volume")).over(f)})

    d = materialize(over_shards(bars.drop("event_idx"), compute, length, 1), "profiled")
    step = (F.col("_high") - F.col("_low")) / rows
    # A row per bar and row of its profile: the session profile's operators do the rest, a bar being their session.
    near = d.filter("_low is not null").withColumn("_step", step)
    at = lambda x: F.when(F.col("_step") > 0, F.floor((x["close"] - F.col("_low")) / F.col("_step")))
    placed = F.transform("_bars", lambda x: F.struct(at(x).alias("i"), x["volume"].alias("v")))
    near = near.withColumn("_placed", placed).withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    volume = F.aggregate(F.filter("_placed", lambda x: x["i"] == F.col("bin_index")), F.lit(0.0), lambda acc, x: acc + x["v"])
    low = F.col("_low") + F.col("bin_index") * F.col("_step")
    bins = near.select("symbol", F.col("event_idx").alias("session_id"), "bin_index", low.alias("bin_low"), (low + F.col("_step")).alias("bin_high"), volume.alias("total_volume"))
    bins = materialize(bins, "rows")
    area = point_of_control(bins).join(value_area(bins, tie_up=True), ["symbol", "session_id"]).select(F.col("symbol").alias("_s"), F.col("session_id").alias("_i"), F.col("poc_price").alias("poc"), "vah", "val")
    return d.join(area, d["symbol"].eqNullSafe(area["_s"]) & (d["event_idx"] == area["_i"]), "left").drop("_s", "_i", "_low", "_high", "_bars", "event_idx")


def opening_range(bars: DataFrame, minutes: int = 30, bar_ms: int = 900_000, flag: str | None = None) -> DataFrame:
    """High and low of a session's first minutes (its first bar and as many after it as ``minutes`` hold), known from the last of them on, and the bars that close beyond them after the bar before did not.

    With ``flag`` only bars where it is true are of a session.
    """
    live = F.col(flag) if flag else F.lit(True)
    w = Window.partitionBy("symbol", "session_id", live.alias("_live")).orderBy("timestamp", "seq")
    last = minutes * 60_000 // bar_ms
    d = bars.withColumn("_n", F.row_number().over(w) - 1).withColumn("_prev", F.lag("close").over(Window.partitionBy("symbol", "session_id").orderBy("timestamp", "seq")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    early, known = F.col("_n") <= last, live & (F.col("_n") >= last)
    d = d.withColumns({"orb_high": F.when(known, F.max(F.when(early, F.col("high"))).over(so_far)), "orb_low": F.when(known, F.min(F.when(early, F.col("low"))).over(so_far))})
    return d.withColumns({
        "orb_long": F.coalesce((F.col("close") > F.col("orb_high")) & (F.col("_prev") <= F.col("orb_high")), F.lit(False)),
        "orb_short": F.coalesce((F.col("close") < F.col("orb_low")) & (F.col("_prev") >= F.col("orb_low")), F.lit(False)),
    }).drop("_prev", "_n")


def combined_signals(bars: DataFrame, band: float = 0.5) -> DataFrame:
    """``signal`` 1, -1 or 0 from the setups, filtered by the band around the average price. Columns ``val`` and ``vah``, if there are, add bounces off the value area."""
    d = bars.withColumns({c: F.lit(None).cast("double") for c in ("val", "vah") if c not in bars.columns})
    near = lambda x, edge: F.coalesce((F.col(x) <= F.col(edge) * 1.001) & (F.col(x) >= F.col(edge) * 0.999), F.lit(False))
    up = F.col("triple_a_long") | F.col("orb_long") | (near("low", "val") & F.col("absorption_up") & F.col("buyers_control"))
    down = F.col("triple_a_short") | F.col("orb_short") | (near("high", "vah") & F.col("absorption_down") & F.col("sellers_control"))
    above = F.coalesce(F.col("close") > F.col("vwap") - F.col("atr") * band, F.lit(False))
    below = F.coalesce(F.col("close") < F.col("vwap") + F.col("atr") * band, F.lit(False))
    return d.withColumn("signal", F.when(up & above, 1).when(down & below, -1).otherwise(0))


class _BarStrategy:
    """One position: stop one ATR beyond the bar, target at a multiple of the risk, a stop that follows once the price has moved far enough, no entries after so many losses in a session or outside of it.

    Distances are those of the signal's bar. In a bar the stop is looked at before the target, and the best price is noted after both.
    """

    def __init__(self, max_losses: int, reward: float, arm: float, follow: float) -> None:
        self.max_losses, self.reward, self.arm, self.follow = max_losses, reward, arm, follow
        self.pos, self.losses, self.session = None, 0, None

    def step(self, r: dict) -> list[dict]:
        out = []
        if r["session_id"] != self.session:
            self.session, self.losses = r["session_id"], 0
        p = self.pos
        if p is not None:
            s = p["side"]
            worst, best = (r["low"], r["high"]) if s > 0 else (r["high"], r["low"])
            trail = p["best"] - s * p["follow"] if s * (p["best"] - p["entry"]) >= p["arm"] else None
            stop = p["stop"] if trail is None else max(p["stop"], trail) if s > 0 else min(p["stop"], trail)
            reason = "trail" if stop != p["stop"] else "stop"
            price = stop if s * (worst - stop) <= 0 else p["target"] if s * (best - p["target"]) >= 0 else None
            if price is not None:
                pnl = s * (price - p["entry"])
                self.losses += pnl < 0
                out.append({"seq": r["seq"], "timestamp": r["timestamp"], "side": s, "entry": p["entry"], "exit": price, "pnl": pnl, "reason": reason if price == stop else "target"})
                self.pos = None
            else:
                p["best"] = max(p["best"], best) if s > 0 else min(p["best"], best)
        if self.pos is None and not out and r["signal"] and r["in_session"] and r["atr"] is not None and r["atr"] == r["atr"] and self.losses < self.max_losses:
            s = int(r["signal"])
            stop = (r["low"] if s > 0 else r["high"]) - s * r["atr"]
            self.pos = {"side": s, "entry": r["close"], "best": r["close"], "stop": stop, "target": r["close"] + (r["close"] - stop) * self.reward, "arm": self.arm * r["atr"], "follow": self.follow * r["atr"]}
        return out

    def finish(self) -> list[dict]:
        return []


def strategy_trades(bars: DataFrame, max_losses: int = 3, reward: float = 2.0, arm: float = 1.5, follow: float = 0.5) -> DataFrame:
    """Closed trades of the bar strategy on ``signal``. The stop follows at ``follow`` ATR once the price has moved by ``arm`` ATR. Bars without a column ``in_session`` are all of a session."""
    bars = bars if "in_session" in bars.columns else bars.withColumn("in_session", F.lit(True))
    return fold_by_symbol(bars, ["seq", "timestamp", "session_id", "high", "low", "close", "atr", "signal", "in_session"], lambda: _BarStrategy(max_losses, reward, arm, follow), "symbol string, seq long, timestamp long, side int, entry double, exit double, pnl double, reason string")
