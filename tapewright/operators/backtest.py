"""Bar backtests and performance metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import materialize
from tapewright.functions.halo import BUCKET_MS, over_shards, running
from tapewright.operators.folds import fold_by_symbol

DAYS = 252


def returns(bars: DataFrame, column: str = "close", name: str = "ret") -> DataFrame:
    """Relative change to the bar before, null for the first."""
    return over_shards(bars, lambda d, w: d.withColumn(name, F.try_divide(F.col(column), F.lag(column).over(w)) - 1), 1, 1)


def vectorized_backtest(bars: DataFrame, signal: Column, capital: float = 100_000.0, commission: float = 0.001) -> DataFrame:
    """Position is the signal of the bar before; cost is commission on its change; equity compounds from ``capital``.

    Adds ``position``, ``ret``, ``cost``, ``strategy_return``, ``equity`` (capital at the first bar, and from there over the bars whose return is known).
    """
    def compute(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_signal", signal.cast("double"))
        d = d.withColumn("position", F.lag("_signal").over(w)).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
        d = d.withColumn("cost", F.abs(F.col("position") - F.lag("position").over(w)) * commission)
        return d.withColumn("strategy_return", F.col("position") * F.col("ret") - F.col("cost")).drop("_signal")

    d = over_shards(bars, compute, 3, 1)
    d = compounded(d, "strategy_return", "equity").withColumn("equity", F.lit(capital) * F.col("equity"))
    return d.withColumn("equity", F.when(F.col("event_idx") == 0, F.lit(capital)).when(F.col("strategy_return").isNotNull(), F.col("equity")))


def compounded(d: DataFrame, r: str, name: str) -> DataFrame:
    """Adds the running product of 1 + ``r``: size as the exponential of a running sum, sign by the number of negative factors, 0 from the first 0 on. Bars without a return change nothing."""
    factor = 1 + F.coalesce(F.col(r), F.lit(0.0))
    d = running(d, {"_logs": F.log(F.when(factor != 0, F.abs(factor))), "_negative": (factor < 0).cast("long"), "_zero": (factor == 0).cast("long")})
    sign = F.when(F.pmod("_negative", F.lit(2)) == 1, -1.0).otherwise(1.0)
    return d.withColumn(name, F.when(F.col("_zero") > 0, 0.0).otherwise(F.coalesce(F.exp("_logs"), F.lit(1.0)) * sign)).drop("_logs", "_negative", "_zero")


def drawdowns(curve: DataFrame, column: str = "equity", order: tuple[str, ...] = ("event_idx",)) -> DataFrame:
    """Adds ``drawdown``: distance from the highest value so far, as a share of it."""
    d = running(curve, {}, {"_top": F.col(column)}, order=order)
    return d.withColumn("drawdown", F.try_divide(F.col(column), "_top") - 1).drop("_top")


def _with_previous(d: DataFrame, columns: dict[str, Column], order: tuple[str, ...] = ("event_idx",)) -> DataFrame:
    """Adds the values of the bar before under the given names, looked up in shards."""
    before = lambda x, w: x.withColumns({n: F.lag(c).over(w) for n, c in columns.items()})
    kept = d.withColumnRenamed("event_idx", "_at") if "event_idx" in d.columns else d
    out = over_shards(kept, before, 1, 1, order=tuple("_at" if o == "event_idx" else o for o in order)).drop("event_idx")
    return out.withColumnRenamed("_at", "event_idx")


def _ratio(mean: Column, std: Column, scale: float) -> Column:
    return F.when(std > 0, F.lit(math.sqrt(scale)) * mean / std).otherwise(0.0)


def backtest_summary(curve: DataFrame, capital: float = 100_000.0, compat: bool = False) -> DataFrame:
    """Total return, Sharpe ratio, largest drawdown, win rate and trades of ``vectorized_backtest``.

    A trade is a change of position; its result is the return of the bar after. ``compat`` also counts the bars at the
    head whose change is unknown as trades.
    """
    curve = materialize(curve, "curve")
    d = drawdowns(curve.filter("equity is not null or event_idx = 0"))
    marked = curve.withColumn("_change", F.col("cost") > 0).withColumn("_change", F.coalesce("_change", F.lit(compat)))
    marked = _with_previous(marked, {"_after": F.col("_change")}).withColumn("_after", F.coalesce("_after", F.lit(False)))
    r = F.col("strategy_return")
    stats = marked.groupBy("symbol").agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count_if("_change").alias("total_trades"), F.count_if(F.col("_after") & F.coalesce(r > 0, F.lit(False))).alias("_wins"), F.count_if("_after").alias("_n"))
    ends = d.groupBy("symbol").agg(F.max_by("equity", "event_idx").alias("_last"), F.min("drawdown").alias("max_drawdown"))
    return stats.join(ends, "symbol").select("symbol", (F.col("_last") / capital - 1).alias("total_return"), _ratio(F.col("m"), F.col("s"), DAYS).alias("sharpe_ratio"), "max_drawdown", F.coalesce(F.try_divide(F.col("_wins"), F.col("_n")), F.lit(0.0)).alias("win_rate"), "total_trades")


def performance(curve: DataFrame, column: str = "equity") -> DataFrame:
    """All metrics of an equity curve (symbol, event_idx, value), one row per symbol; one of no loss has a profit factor of infinity."""
    c = curve.filter(F.col(column).isNotNull()).select("symbol", "event_idx", F.col(column).alias("v"))
    c = _with_previous(c, {"_v": F.col("v")}).withColumn("r", F.try_divide("v", "_v") - 1)
    c = drawdowns(c, "v")
    r, up, down = F.col("r"), F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") < 0, F.col("r"))
    g = c.groupBy("symbol").agg(
        F.min_by("v", "event_idx").alias("a"), F.max_by("v", "event_idx").alias("b"), F.count(F.lit(1)).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.stddev_samp(down).alias("sd"), F.count(r).alias("nr"),
        F.count(up).alias("nu"), F.sum(up).alias("su"), F.sum(down).alias("sn"), F.min("drawdown").alias("mdd"), F.avg("drawdown").alias("add"),
    )
    col = F.col
    return g.select(
        "symbol", (col("b") / col("a") - 1).alias("total_return"), (F.pow(col("b") / col("a"), DAYS / col("n")) - 1).alias("annualized_return"), _ratio(col("m"), col("s"), DAYS).alias("sharpe_ratio"), _ratio(col("m"), col("sd"), DAYS).alias("sortino_ratio"),
        F.when(col("mdd") != 0, col("m") * DAYS / F.abs("mdd")).otherwise(0.0).alias("calmar_ratio"), col("mdd").alias("max_drawdown"), col("add").alias("average_drawdown"), F.coalesce(F.try_divide(col("nu"), col("nr")), F.lit(0.0)).alias("win_rate"),
        F.when(F.coalesce(col("sn"), F.lit(0.0)) != 0, F.abs(F.coalesce(col("su"), F.lit(0.0)) / col("sn"))).otherwise(float("inf")).alias("profit_factor"), (col("s") * math.sqrt(DAYS)).alias("annualized_volatility"), col("n").alias("total_days"),
    )


class BarBroker:
    """Bar by bar: buys with all cash or sells short its worth, flips, pays slippage and commission, marks equity at the close. ``log`` gives the trades instead, with the cash left by each."""

    def __init__(self, capital: float = 100_000.0, commission: float = 0.001, slippage: float = 0.0005, log: bool = False) -> None:
        self.log = log
        self.cash, self.size, self.commission, self.slippage = capital, 0.0, commission, slippage

    def step(self, r: dict) -> list[dict]:
        signal, actions = int(r["signal"] or 0), []
        price = r["close"] * (1 + self.slippage * signal)
        if signal and self.size * signal <= 0:
            if self.size:
                self.cash += self.size * price * (1 - self.commission)
                actions.append(("CLOSE_SHORT" if signal > 0 else "CLOSE_LONG", self.cash))
            self.size = signal * self.cash / price
            worth = abs(self.size) * price
            self.cash += -worth * (1 + self.commission) if signal > 0 else worth * (1 - self.commission)
            actions.append(("BUY" if signal > 0 else "SELL", self.cash))
        if self.log:
            return [{"seq": r["seq"], "timestamp": r["timestamp"], "action": a, "price": price, "equity": cash} for a, cash in actions]
        return [{"seq": r["seq"], "timestamp": r["timestamp"], "equity": self.cash + self.size * r["close"], "position": self.size, "actions": ",".join(a for a, _ in actions)}]

    def finish(self) -> list[dict]:
        return []


def loop_backtest(bars: DataFrame, capital: float = 100_000.0, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """Equity per bar of the broker that follows the column ``signal`` (-1, 0, 1); a strategy plug-in fills that column."""
    return fold_by_symbol(bars, ["seq", "timestamp", "close", "signal"], lambda: BarBroker(capital, commission, slippage), "symbol string, seq long, timestamp long, equity double, position double, actions string")


def loop_trades(bars: DataFrame, capital: float = 100_000.0, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """The trades of ``loop_backtest`` in order: action, price after slippage, and the cash after the trade."""
    return fold_by_symbol(bars, ["seq", "timestamp", "close", "signal"], lambda: BarBroker(capital, commission, slippage, log=True), "symbol string, seq long, timestamp long, action string, price double, equity double")


def loop_summary(equity: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Total return, Sharpe ratio per minute bar, largest drawdown, share of rising bars and number of trades."""
    e = _with_previous(equity, {"_e": F.col("equity")}, ("timestamp", "seq"))
    e = e.withColumn("r", F.try_divide("equity", "_e") - 1).withColumn("up", F.col("equity") > F.col("_e"))
    e = running(e, {}, {"_top": F.col("equity")}, order=("timestamp", "seq"), width=BUCKET_MS).withColumn("dd", F.col("equity") / F.col("_top") - 1)
    acts = F.when(F.col("actions") != "", F.size(F.split("actions", ","))).otherwise(0)
    g = e.groupBy("symbol").agg(F.max_by("equity", F.struct("timestamp", "seq")).alias("b"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("dd").alias("max_drawdown"), F.count_if("up").alias("u"), F.count(F.lit(1)).alias("n"), F.sum(acts).alias("total_trades"))
    return g.select("symbol", (F.col("b") / capital - 1).alias("total_return"), _ratio(F.col("m"), F.col("s"), DAYS * 390).alias("sharpe_ratio"), "max_drawdown", (F.col("u") / F.col("n")).alias("win_rate"), "total_trades")
