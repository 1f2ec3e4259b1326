"""Sequential folds: the state machine of signals and the execution backtest.

What a step needs from the past beyond a few scalars (quantiles of the last rows, moving averages, causal thresholds) is computed by window
operators first; the fold itself keeps a small state and is the only part that runs one symbol after the other. ``fold_by_symbol`` feeds it Arrow batches of a
partition sorted by (symbol, timestamp, seq): a symbol of any size streams through, nothing is collected.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns
from tapewright.functions.expanding import expanding_quantiles
from tapewright.functions.halo import over_shards


def fold_by_symbol(df: DataFrame, columns: list[str], start: Callable[[], object], schema: str) -> DataFrame:
    """Run ``start()`` anew for each symbol: its ``step(row dict)`` and ``finish()`` give lists of output dicts (without symbol).

    One sorted stream per partition; symbols are spread by hash. Sequential by nature, so a symbol is one task, of constant memory.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fold, symbol, fresh = None, None, True
        for pdf in batches:
            rows: list[dict] = []
            cols = {c: pdf[c].tolist() for c in columns}
            for i, s in enumerate(pdf["symbol"].tolist()):
                if fresh or s != symbol:
                    if not fresh:
                        rows += [{"symbol": symbol, **r} for r in fold.finish()]
                    fold, symbol, fresh = start(), s, False
                rows += [{"symbol": s, **r} for r in fold.step({c: v[i] for c, v in cols.items()})]
            yield pd.DataFrame(rows, columns=names)
        if not fresh:
            yield pd.DataFrame([{"symbol": symbol, **r} for r in fold.finish()], columns=names)

    part = df.repartition("symbol").sortWithinPartitions("symbol", "timestamp", "seq")
    return part.select("symbol", *columns).mapInPandas(run, schema)


class RecentQuantile:
    """Quantiles (linear) of the last ``size`` values; ready when there are so many."""

    def __init__(self, size: int) -> None:
        self.size, self.order, self.ranked = size, deque(), []

    def ready(self) -> bool:
        return len(self.order) >= self.size

    def push(self, v: float) -> None:
        self.order.append(v)
        if v == v:
            insort(self.ranked, v)
        if len(self.order) > self.size:
            old = self.order.popleft()
            if old == old:
                del self.ranked[bisect_left(self.ranked, old)]

    def at(self, q: float) -> float:
        r = self.ranked
        if not r:
            return math.nan
        pos = q * (len(r) - 1)
        k = int(pos)
        return r[k] if k + 1 >= len(r) else r[k] + (r[k + 1] - r[k]) * (pos - k)


_AGAINST = {"up": "down", "down": "up"}
_SIDE = {"high": "up", "low": "down"}


class SignalMachine:
    """From context to confirmed resolution to a trade and its exit, one event at a time, from earlier events only.

    Phases: IDLE, CONTEXT, INTERACTION, RESOLUTION, CONFIRMED, IN_TRADE. An exit clears all short memory and skips the event it happens on.
    """

    def __init__(self, window: int = 100, max_events: int = 80, stop_pct: float = 0.001, patience: int = 3, zone_age: int = 50, confirm_timeout: int = 15, move_pct: float = 5e-5) -> None:
        self.max_events, self.stop_pct, self.patience, self.zone_age, self.timeout, self.move_pct = max_events, stop_pct, patience, zone_age, confirm_timeout, move_pct
        self.speeds, self.pressures = RecentQuantile(window), RecentQuantile(window)
        self.zones: dict[str, tuple[float, int]] = {}
        self.n = 0
        self.trade: dict | None = None
        self.clear()

    def clear(self) -> None:
        self.phase, self.context, self.kind, self.toward = "IDLE", None, "none", None
        self.sides: deque = deque(maxlen=3)
        self.streak, self.last_kind = 0, None
        self.before: dict | None = None
        self.undecided = self.confirmed_for = self.flips = self.absorbed = 0

    def save(self) -> dict:
        """The whole state in plain values, for a store between batches."""
        plain = {k: v for k, v in vars(self).items() if k not in ("speeds", "pressures", "sides")}
        return plain | {"speeds": (self.speeds.size, list(self.speeds.order)), "pressures": (self.pressures.size, list(self.pressures.order)), "sides": list(self.sides)}

    def restore(self, saved: dict) -> None:
        for k, v in saved.items():
            if k in ("speeds", "pressures"):
                memory = RecentQuantile(v[0])
                for x in v[1]:
                    memory.push(x)
                v = memory
            elif k == "sides":
                v = deque(v, maxlen=3)
            setattr(self, k, v)

    # -- judgements -----------------------------------------------------------------------------------

    def resolve(self, e: dict) -> tuple[str, str | None]:
        """What the interaction with the context came to: reversal, failure or continuation, and the side it speaks for."""
        mine, b = self.context, self.before
        if mine is None:
            return "none", None
        other = _AGAINST[mine]
        decided = [s for s in self.sides if s != "neutral"]
        if e["side"] == other and decided.count(other) >= 2 and self.pressures.ready() and abs(e["pressure"]) > self.pressures.at(0.7):
            return "reversal", other
        if b is not None:
            stalled = e["price"] <= b["price"] if mine == "up" else e["price"] >= b["price"]
            if abs(e["pressure"]) < abs(b["pressure"]) and stalled:
                return "failure", other
        turned = b is not None and b["absorbed"] != e["absorbed"] and e["absorbed"] and e["side"] == other
        if turned and (b is None or b["side"] != mine):
            return "failure", other
        if e["side"] != "neutral" and decided.count(e["side"]) >= 1:
            return "continuation", e["side"]
        return "none", None

    def steady(self, e: dict) -> bool:
        return e["side"] != "neutral" and bool(self.sides) and self.sides[-1] == e["side"]

    def spike(self, e: dict) -> bool:
        if not (self.speeds.ready() and self.pressures.ready()) or self.before is None or e["side"] != self.toward:
            return False
        if not (e["speed"] > max(self.speeds.at(0.9), self.speeds.at(0.5)) and abs(e["pressure"]) > self.pressures.at(0.8)):
            return False
        was = self.before["price"]
        return e["price"] > was + was * self.move_pct if self.toward == "up" else e["price"] < was - was * self.move_pct

    def leaves(self, e: dict) -> bool:
        t = self.trade
        flipped = e["side"] == _AGAINST[t["side"]]
        self.flips = self.flips + 1 if flipped else 0
        self.absorbed = self.absorbed + 1 if flipped and e["absorbed"] else 0
        stopped = e["price"] <= t["stop"] if t["side"] == "up" else e["price"] >= t["stop"]
        return self.flips >= 2 or self.absorbed >= 2 or e["regime"] != "trend" or stopped or t["events"] >= self.max_events

    # -- transitions ----------------------------------------------------------------------------------

    def note(self, kind: str, toward: str | None) -> None:
        self.streak = self.streak + 1 if kind == self.last_kind else 1
        self.kind = self.last_kind = kind
        self.toward = toward

    def back_to_interaction(self) -> None:
        self.phase, self.kind, self.toward, self.streak, self.last_kind, self.confirmed_for = "INTERACTION", "none", None, 0, None, 0

    def advance(self, e: dict, valid: bool) -> tuple[bool, bool]:
        """One transition; (spike, entry)."""
        if self.phase == "IDLE":
            if valid:
                self.phase, self.undecided = "CONTEXT", 0
                if self.steady(e):
                    self.context = e["side"]
            return False, False
        if not valid:
            self.clear()
            return False, False
        if self.phase == "CONTEXT":
            if self.steady(e):
                self.context = e["side"]
            elif self.context is None:
                self.undecided += 1
                if self.undecided >= self.patience:
                    self.context = e["side"]
            if self.context is not None:
                self.phase = "INTERACTION"
            return False, False
        if self.phase == "CONFIRMED":
            self.confirmed_for += 1
            if self.confirmed_for > self.timeout:
                self.back_to_interaction()
                return False, False
        kind, toward = self.resolve(e)
        if self.phase == "INTERACTION":
            if kind != "none":
                self.note(kind, toward)
                self.phase = "RESOLUTION"
        elif kind == "none":
            kept = self.confirmed_for
            self.back_to_interaction()
            self.confirmed_for = kept
        elif self.phase == "RESOLUTION":
            self.note(kind, toward)
            if self.streak >= 2:
                self.phase, self.confirmed_for = "CONFIRMED", 0
        elif kind != self.kind:
            self.last_kind = None
            self.note(kind, toward)
            self.phase, self.confirmed_for = "RESOLUTION", 0
        else:
            spike = self.spike(e)
            if spike and self.toward is not None:
                zone = self.zones.get(self.toward)
                fresh = zone is not None and self.n - zone[1] <= self.zone_age
                away = 1 - self.stop_pct if self.toward == "up" else 1 + self.stop_pct
                self.trade = {"side": self.toward, "stop": zone[0] if fresh else e["price"] * away, "events": 0}
                self.phase, self.flips, self.absorbed = "IN_TRADE", 0, 0
            return spike, spike
        return False, False

    def step(self, row: dict) -> list[dict]:
        self.n += 1
        e = {"price": float(row["price"]), "speed": float(row["speed_50"]), "pressure": float(row["pressure_50"]), "side": _SIDE.get(row["pressure_bin"], "neutral"), "absorbed": int(row["absorption_flag"]) == 1, "regime": row["regime"]}
        valid = e["regime"] == "trend" and row["location_bin"] in ("low", "high") and e["side"] != "neutral"
        if e["side"] != "neutral" and self.pressures.ready() and abs(e["pressure"]) > self.pressures.at(0.7):
            self.zones[_AGAINST[e["side"]]] = (e["price"], self.n)
        left = spike = entered = False
        if self.trade is not None:
            self.trade["events"] += 1
            if self.leaves(e):
                self.trade, left = None, True
                self.clear()
        elif not left:
            spike, entered = self.advance(e, valid)
        self.sides.append(e["side"])
        self.before = e
        self.speeds.push(e["speed"])
        self.pressures.push(abs(e["pressure"]))
        return [{
            "seq": int(row["seq"]), "state": self.phase, "context_valid": valid, "resolution_type": "none" if left else self.kind, "confirmed_direction": (None if left else self.toward) or "none",
            "aggression_spike_flag": int(spike), "entry_signal": int(entered), "entry_direction": self.trade["side"] if entered else "none", "in_trade": int(self.trade is not None), "exit_signal": int(left),
        }]

    def finish(self) -> list[dict]:
        return []


SIGNAL_COLUMNS = ["seq", "timestamp", "price", "speed_50", "pressure_50", "pressure_bin", "absorption_flag", "location_bin", "regime"]
SIGNAL_SCHEMA = "symbol string, seq long, state string, context_valid boolean, resolution_type string, confirmed_direction string, aggression_spike_flag int, entry_signal int, entry_direction string, in_trade int, exit_signal int"


def signal_stream(tagged: DataFrame, window: int = 100, max_events: int = 80) -> DataFrame:
    """The machine's output for every tagged feature row. Rows with a null in what it reads are left out first."""
    require_columns(tagged, ["symbol", *SIGNAL_COLUMNS])
    use = tagged.dropna(subset=SIGNAL_COLUMNS)
    return fold_by_symbol(use, SIGNAL_COLUMNS, lambda: SignalMachine(window, max_events), SIGNAL_SCHEMA)


# -- execution backtest -----------------------------------------------------------------------------------

TRADE_SCHEMA = (
    "symbol string, entry_idx long, exit_idx long, entry_timestamp long, exit_timestamp long, direction string, hard_stop_price double, state_regime string, state_pressure string, entry_price double, exit_price double, "
    "atr_entry double, structure_level double, trailing_stop_at_exit double, pnl double, gross_pnl double, entry_notional double, exit_notional double, fee double, net_pnl double, pnl_r double, pullback_depth_at_entry double, "
    "delta_norm_at_entry double, mae double, mfe double, mfe_time long, max_price_since_entry double, min_price_since_entry double, time_since_last_extreme long, duration_events long, exit_reason string"
)
EXECUTION_COLUMNS = ["seq", "timestamp", "price", "pressure_50", "regime", "event_idx", "atr", "atr_before", "price_before", "delta_norm", "threshold"]


class Execution:
    """Signal on strong pressure in a trend, pullback, entry on renewed flow, and a chain of exits. Long and short are one rule, mirrored by ``sign``."""

    def __init__(self, fee: float = 0.0004, depth: tuple[float, float] = (0.3, 1.8), flow_entry: float = 2.0, move_entry: float = 0.5, hard: float = 2.5, flow_exit: float = 1.0, flow_events: int = 3, trail: float = 2.0, arm: float = 0.5, decay: int = 200, follow: float = 0.5, follow_events: int = 5, longest: int = 20_000) -> None:
        self.p = dict(fee=fee, depth=depth, flow_entry=flow_entry, move_entry=move_entry, hard=hard, flow_exit=flow_exit, flow_events=flow_events, trail=trail, arm=arm, decay=decay, follow=follow, follow_events=follow_events, longest=longest)
        self.signal: dict | None = None
        self.pos: dict | None = None
        self.row: dict | None = None

    def record(self, r: dict, reason: str) -> dict:
        s, p = self.pos, self.p
        price, sign = r["price"], s["sign"]
        gain = sign * (price - s["price"])
        best = s["high"] if sign > 0 else s["low"]
        fee = (abs(s["price"]) + abs(price)) * p["fee"]
        return {
            "entry_idx": s["idx"], "exit_idx": r["event_idx"], "entry_timestamp": s["ts"], "exit_timestamp": r["timestamp"], "direction": "long" if sign > 0 else "short", "hard_stop_price": s["stop"], "state_regime": s["regime"],
            "state_pressure": "strong_up" if sign > 0 else "strong_down", "entry_price": s["price"], "exit_price": price, "atr_entry": s["atr"], "structure_level": s["level"], "trailing_stop_at_exit": best - sign * p["trail"] * s["atr"],
            "pnl": gain, "gross_pnl": gain, "entry_notional": abs(s["price"]), "exit_notional": abs(price), "fee": fee, "net_pnl": gain - fee, "pnl_r": gain / s["atr"] if s["atr"] > 0 else math.nan,
            "pullback_depth_at_entry": s["depth"], "delta_norm_at_entry": s["flow"], "mae": min(s["mae"], gain), "mfe": max(s["mfe"], gain), "mfe_time": s["mfe_time"], "max_price_since_entry": s["high"], "min_price_since_entry": s["low"],
            "time_since_last_extreme": s["idle"], "duration_events": r["event_idx"] - s["idx"], "exit_reason": reason,
        }

    def exit_reason(self, r: dict, adverse_flow: bool) -> str | None:
        """Judged by the state before this row. A hard stop is overwritten by a later reason that also holds, except structure."""
        s, p, sign, price = self.pos, self.p, self.pos["sign"], r["price"]
        best = s["high"] if sign > 0 else s["low"]
        held = r["event_idx"] - s["idx"]
        hit = sign * (price - s["stop"]) <= 0
        if not hit and sign * (price - s["level"]) < 0:
            return "structure"
        later = (
            ("flow", s["flows"] + adverse_flow >= p["flow_events"]),
            ("trailing", s["mfe"] >= p["arm"] * s["atr"] and sign * (price - (best - sign * p["trail"] * s["atr"])) < 0),
            ("no_follow_through", held > p["follow_events"] and s["mfe"] < p["follow"] * s["atr"]),
            ("decay", s["idle"] + 1 >= p["decay"]),
            ("safety", held >= p["longest"]),
        )
        return next((name for name, holds in later if holds), "hard_stop" if hit else None)

    def manage(self, r: dict) -> dict | None:
        s, sign, price = self.pos, self.pos["sign"], r["price"]
        adverse = sign * r["delta_norm"] < -self.p["flow_exit"]
        reason = self.exit_reason(r, adverse)
        if reason:
            out = self.record(r, reason)
            self.pos = self.signal = None
            return out
        gain = sign * (price - s["price"])
        s["mfe"], s["mae"] = max(s["mfe"], gain), min(s["mae"], gain)
        s["flows"] = s["flows"] + 1 if adverse else 0
        further = price > s["high"] if sign > 0 else price < s["low"]
        s["idle"], s["mfe_time"] = (0, r["timestamp"]) if further else (s["idle"] + 1, s["mfe_time"])
        s["high"], s["low"] = max(s["high"], price), min(s["low"], price)
        return None

    def seek(self, r: dict) -> None:
        price, p = r["price"], self.p
        if self.signal is None:
            if r["regime"] == "trend" and r["threshold"] == r["threshold"] and abs(r["pressure_50"]) >= r["threshold"]:
                self.signal = {"sign": 1 if r["pressure_50"] > 0 else -1, "top": price, "frozen": False, "turn": price}
            return
        g = self.signal
        sign = g["sign"]
        if not g["frozen"]:
            if sign * (price - g["top"]) >= 0:
                g["top"] = price
            else:
                g["frozen"], g["turn"] = True, price
            return
        g["turn"] = min(g["turn"], price) if sign > 0 else max(g["turn"], price)
        depth = sign * (g["top"] - price) / r["atr"]
        renewed = sign * r["delta_norm"] > p["flow_entry"] and sign * (price - r["price_before"]) > p["move_entry"] * r["atr_before"]
        strong = sign * r["pressure_50"] > r["threshold"]
        if strong and p["depth"][0] <= depth <= p["depth"][1] and renewed and sign * (price - (g["top"] + g["turn"]) / 2) > 0:
            self.pos = {
                "sign": sign, "idx": r["event_idx"], "ts": r["timestamp"], "price": price, "atr": r["atr"], "stop": price - sign * p["hard"] * r["atr"], "level": g["turn"], "regime": r["regime"], "depth": depth, "flow": r["delta_norm"],
                "mae": 0.0, "mfe": 0.0, "mfe_time": r["timestamp"], "flows": 0, "idle": 0, "high": price, "low": price,
            }
        if r["regime"] != "trend":
            self.signal = None

    def step(self, row: dict) -> list[dict]:
        self.row = row
        known = all(row[c] is not None and row[c] == row[c] for c in ("atr", "delta_norm", "atr_before"))
        if not known or row["atr_before"] <= 0:
            return []
        row["threshold"] = math.nan if row["threshold"] is None else row["threshold"]
        if self.pos is not None:
            done = self.manage(row)
            return [done] if done else []
        self.seek(row)
        return []

    def finish(self) -> list[dict]:
        return [self.record(self.row, "data_end")] if self.pos is not None else []


def execution_inputs(regime_rows: DataFrame, atr_window: int = 300, delta_window: int = 300, quantile: float = 0.70, least: int = 50) -> DataFrame:
    """Moving averages and the causal pressure threshold (over earlier trend rows) that the execution fold reads."""
    require_columns(regime_rows, ["symbol", "seq", "timestamp", "price", "delta", "pressure_50", "regime"])
    reach = max(atr_window, delta_window) + 2

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        d = df.withColumn("price_before", F.lag("price").over(w)).withColumn("_tr", F.abs(F.col("price") - F.col("price_before")))
        f, g = w.rowsBetween(-(atr_window - 1), 0), w.rowsBetween(-(delta_window - 1), 0)
        d = d.withColumn("atr", F.when(F.count("_tr").over(f) >= atr_window, F.avg("_tr").over(f))).withColumn("_sd", F.when(F.count("delta").over(g) >= delta_window, F.stddev_samp("delta").over(g)))
        return d.withColumn("atr_before", F.lag("atr").over(w)).withColumn("delta_norm", F.try_divide("delta", "_sd")).drop("_tr", "_sd")

    d = over_shards(regime_rows.drop("event_idx"), compute, reach, 1)
    d = d.withColumn("_trend", F.when(F.col("regime") == "trend", F.abs("pressure_50")))
    return expanding_quantiles(d, {"threshold": ("_trend", quantile, least)}).drop("_trend")


def execution_trades(regime_rows: DataFrame, atr_window: int = 300, delta_window: int = 300, quantile: float = 0.70, **parameters) -> DataFrame:
    """The log of trades. An open position is closed at the last row ('data_end'). No trend rows give no trades."""
    ready = execution_inputs(regime_rows, atr_window, delta_window, quantile)
    return fold_by_symbol(ready, EXECUTION_COLUMNS, lambda: Execution(**parameters), TRADE_SCHEMA)


def with_cum_pnl(trades: DataFrame) -> DataFrame:
    """Adds ``cum_pnl``: the running sum of pnl over a symbol's trades in order of their exit. A window over trades, not over events."""
    w = Window.partitionBy("symbol").orderBy("exit_idx", "entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("cum_pnl", F.sum(F.col("pnl").cast("decimal(28,8)")).over(w).cast("double"))


def summarize_trades(trades: DataFrame) -> DataFrame:
    """Count, win rate, means and the largest winner; one row with nulls if there are no trades."""
    win = (F.col("pnl") > 0).cast("double")
    return trades.agg(F.count(F.lit(1)).alias("trades"), F.avg(win).alias("win_rate"), F.avg("pnl").alias("avg_pnl"), F.avg("pnl").alias("expectancy"), F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"), F.avg("duration_events").alias("avg_duration"), F.max("pnl").alias("largest_winner"))
