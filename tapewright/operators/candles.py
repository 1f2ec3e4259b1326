"""Time-bucket aggregation of trades, and single large trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns
from tapewright.sources.tape import exact_sum

TIMEFRAME_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000}


def timeframe_to_ms(timeframe: str) -> int:
    if timeframe not in TIMEFRAME_MS:
        raise ValueError(f"unsupported timeframe: {timeframe}")
    return TIMEFRAME_MS[timeframe]


def candles(trades: DataFrame, timeframe: str = "1m") -> DataFrame:
    """One candle per symbol and bucket that has trades, by one partially aggregated shuffle.

    Trades are in order of (timestamp, price, qty, seq), so in a tied millisecond open is the lowest price and close the
    highest. The largest trade is the first of the greatest quantity. Empty input gives no candle; rows with a null
    in timestamp or price are left out.
    """
    require_columns(trades, ["symbol", "seq", "timestamp", "price", "qty", "is_buyer_maker"])
    step = timeframe_to_ms(timeframe)
    t = trades.filter(F.col("timestamp").isNotNull() & F.col("price").isNotNull())
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    order = F.struct("timestamp", "price", "qty", "seq")
    buy = side == "buy"
    g = t.groupBy("symbol", (F.col("timestamp") - F.pmod("timestamp", F.lit(step))).alias("timestamp_ms")).agg(
        F.min(order)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(order)["price"].alias("close"),
        exact_sum(F.col("qty")).alias("volume"), exact_sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("buy_volume"), exact_sum(F.when(~buy, F.col("qty")).otherwise(0.0)).alias("sell_volume"),
        exact_sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("delta"),
        F.count(F.lit(1)).alias("trade_count"), F.count_if(buy).alias("buy_trade_count"), F.count_if(~buy).alias("sell_trade_count"),
        F.max("qty").alias("largest_trade_qty"), F.min_by(side, F.struct(-F.col("qty"), "timestamp", "price", "seq")).alias("largest_trade_side"),
    )
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return g.select(
        "symbol", F.lit(timeframe).alias("timeframe"), "timestamp_ms", "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "delta",
        "trade_count", "buy_trade_count", "sell_trade_count", "largest_trade_qty", F.when(F.col("largest_trade_qty") > 0, F.col("largest_trade_side")).otherwise("buy").alias("largest_trade_side"),
        (F.col("close") - F.col("open")).alias("price_change"), (F.col("high") - F.col("low")).alias("range"), F.abs(F.col("close") - F.col("open")).alias("body"),
        (F.col("high") - top).alias("upper_wick"), (bottom - F.col("low")).alias("lower_wick"),
    )


def order_bubbles(trades: DataFrame, min_qty: float | None = None, min_notional: float | None = None) -> DataFrame:
    """Trades that reach a quantity or a notional threshold, with score and tier. A narrow filter and projection."""
    if min_qty is None and min_notional is None:
        raise ValueError("at least one threshold is needed")
    if any(x is not None and x <= 0 for x in (min_qty, min_notional)):
        raise ValueError("thresholds must be above 0")
    notional = F.col("price") * F.col("qty")
    by_qty = F.col("qty") >= min_qty if min_qty is not None else F.lit(False)
    by_notional = notional >= min_notional if min_notional is not None else F.lit(False)
    r1 = F.col("qty") / min_qty if min_qty is not None else F.lit(None).cast("double")
    r2 = notional / min_notional if min_notional is not None else F.lit(None).cast("double")
    both = by_qty & by_notional
    mode = F.when(both, "qty+notional").when(by_qty, "qty").otherwise("notional")
    score = F.when(both, F.greatest(r1, r2)).when(by_qty, r1).otherwise(r2)
    value = F.when(both, F.when(r1 >= r2, F.lit(min_qty)).otherwise(F.lit(min_notional))).when(by_qty, F.lit(min_qty)).otherwise(F.lit(min_notional))
    return trades.filter(by_qty | by_notional).select(
        "symbol", "seq", F.lit("agg_trade").alias("bubble_type"), F.lit("confirmed").alias("bubble_status"), F.col("timestamp").alias("timestamp_ms"),
        (F.col("timestamp") - F.pmod("timestamp", F.lit(60_000))).alias("minute_bucket_ms"), "price", "qty", notional.alias("notional"),
        F.when(F.col("is_buyer_maker"), "sell").otherwise("buy").alias("aggressive_side"), mode.alias("threshold_mode"), value.cast("double").alias("threshold_value"),
        score.alias("bubble_size_score"), F.when(score >= 3.0, "extreme").when(score >= 1.75, "large").otherwise("medium").alias("bubble_tier"),
    )


def marker_sizes(bubbles: DataFrame) -> DataFrame:
    """Size of each bubble's marker: 8 + 8 x score, at most 40; without a score scaled by quantity; 8 if neither is known."""
    top = bubbles.filter(F.col("bubble_size_score").isNull()).agg(F.max("qty")).first()[0]  # one number
    by_qty = F.least(8 + 18 * (F.col("qty") / top), F.lit(40.0)) if top is not None and top > 0 else F.lit(8.0)
    size = F.when(F.col("bubble_size_score").isNotNull(), F.least(8 + 8 * F.col("bubble_size_score"), F.lit(40.0))).otherwise(by_qty)
    return bubbles.withColumn("marker_size", F.coalesce(size, F.lit(8.0)))
