"""Session volume profiles: bins, point of control, value area, density regions, watch zones and balance.

Everything per (symbol, session). Trades are aggregated to bins with map-side combine; all later windows run over the bins of a
session, whose number is a parameter, so no window ever sees a session's trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns
from tapewright.sources.tape import exact_sum, session_id

KEY = ["symbol", "session_id"]


def _bins_window() -> WindowSpec:
    """The bins of a session in order."""
    return Window.partitionBy(*KEY).orderBy("bin_index")


def _session_window() -> WindowSpec:
    return Window.partitionBy(*KEY)


def profile_bins(trades: DataFrame, n_bins: int = 50) -> DataFrame:
    """All ``n_bins`` bins of each session: edges, buy, sell and total volume, delta. Bins without trades are 0; with one price only, all trades are in bin 0."""
    if n_bins <= 0:
        raise ValueError("n_bins must be above 0")
    require_columns(trades, ["symbol", "timestamp", "price", "qty", "is_buyer_maker"])
    t = trades.filter(F.col("price").isNotNull() & F.col("timestamp").isNotNull()).withColumn("session_id", session_id(F.col("timestamp")))
    edges = t.groupBy(*KEY).agg(F.min("price").alias("session_low"), F.max("price").alias("session_high"))
    edges = edges.withColumn("bin_width", (F.col("session_high") - F.col("session_low")) / n_bins)
    placed = t.join(edges, KEY)
    at = F.floor(F.try_divide(F.col("price") - F.col("session_low"), F.col("bin_width"))).cast("int")
    placed = placed.withColumn("bin_index", F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(n_bins - 1)), F.lit(0)))
    buy = ~F.col("is_buyer_maker")
    sums = placed.groupBy(*KEY, "bin_index").agg(exact_sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("buy_volume"), exact_sum(F.when(~buy, F.col("qty")).otherwise(0.0)).alias("sell_volume"), exact_sum(F.col("qty")).alias("total_volume"))
    frame = edges.withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    full = frame.join(sums, [*KEY, "bin_index"], "left").fillna(0.0, ["buy_volume", "sell_volume", "total_volume"])
    low = F.col("session_low") + F.col("bin_index") * F.col("bin_width")
    return full.select(*KEY, "session_low", "session_high", "bin_width", "bin_index", low.alias("bin_low"), (low + F.col("bin_width")).alias("bin_high"), "buy_volume", "sell_volume", "total_volume", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"))


def point_of_control(bins: DataFrame) -> DataFrame:
    """The bin of most volume (the lowest of several) and its middle price, per session."""
    best = F.max_by(F.struct("bin_index", "bin_low", "bin_high", "total_volume"), F.struct("total_volume", -F.col("bin_index")))
    p = bins.groupBy(*KEY).agg(best.alias("b"))
    return p.select(*KEY, F.col("b.bin_index").alias("poc_bin_index"), ((F.col("b.bin_low") + F.col("b.bin_high")) / 2).alias("poc_price"), F.col("b.total_volume").alias("poc_volume"))


def value_area(bins: DataFrame, share: float = 0.7, tie_up: bool = False) -> DataFrame:
    """Low and high of the area grown from the point of control until it holds ``share`` of the volume.

    Growing towards the larger neighbour is a merge of two sequences by their heads, and that is the order of the running minimum
    of volume outwards: so windows over the bins replace the loop. Ties go down, or up with ``tie_up``.
    """
    b = bins.join(point_of_control(bins).select(*KEY, "poc_bin_index"), KEY)
    side = F.signum(F.col("bin_index") - F.col("poc_bin_index"))
    dist = F.abs(F.col("bin_index") - F.col("poc_bin_index"))
    b = b.withColumn("_side", side).withColumn("_dist", dist)
    outward = Window.partitionBy(*KEY, "_side").orderBy("_dist").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_m", F.min("total_volume").over(outward))
    order = Window.partitionBy(*KEY).orderBy((F.col("_dist") == 0).desc(), F.col("_m").desc(), F.col("_side").desc() if tie_up else F.col("_side").asc(), F.col("_dist").asc())
    v = F.col("total_volume").cast("decimal(28,8)")
    b = b.withColumn("_before", F.coalesce(F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,8)"))).withColumn("_total", F.sum(v).over(_session_window()))
    inside = (F.col("_dist") == 0) | (F.col("_before") < F.col("_total") * F.lit(share).cast("decimal(6,4)"))
    return b.filter(inside).groupBy(*KEY).agg(F.min("bin_low").alias("val"), F.max("bin_high").alias("vah"), F.min("bin_index").alias("val_bin"), F.max("bin_index").alias("vah_bin"))


def density(bins: DataFrame) -> DataFrame:
    """Bins with their smoothed volume (three bins, edges repeated), its share of the session's largest, and the regime hvn, lvn or neutral."""
    x = F.col("total_volume")
    smooth = (F.coalesce(F.lag("total_volume").over(_bins_window()), x) + x + F.coalesce(F.lead("total_volume").over(_bins_window()), x)) / 3.0
    d = bins.withColumn("smoothed", smooth)
    top = F.max("smoothed").over(_session_window())
    d = d.withColumn("density", F.when(top > 0, F.col("smoothed") / top).otherwise(0.0))
    return d.withColumn("regime", F.when(F.col("density") >= 0.65, "hvn").when(F.col("density") <= 0.20, "lvn").otherwise("neutral"))


def regions(bins: DataFrame) -> DataFrame:
    """Runs of high (hvn) and low (lvn) density. A low run counts only inside the profile and between clearly denser neighbours."""
    d = density(bins)
    d = d.withColumn("_start", (F.coalesce(F.lag("regime").over(_bins_window()), F.lit("")) != F.col("regime")).cast("int"))
    d = d.withColumn("_run", F.sum("_start").over(_bins_window())).withColumn("_left", F.lag("density").over(_bins_window())).withColumn("_right", F.lead("density").over(_bins_window()))
    dominant = F.max_by(F.struct("bin_index", "bin_low", "bin_high"), F.struct("total_volume", -F.col("bin_index")))
    r = d.filter("regime <> 'neutral'").groupBy(*KEY, "_run", "regime").agg(
        F.min("bin_index").alias("start_bin"), F.max("bin_index").alias("end_bin"), dominant.alias("_d"), F.max("density").alias("max_density"), F.avg("density").alias("mean_density"),
        F.min_by("_left", "bin_index").alias("_left"), F.max_by("_right", "bin_index").alias("_right"),
    )
    embedded = (F.col("_left") > F.col("mean_density") * 1.3) & (F.col("_right") > F.col("mean_density") * 1.3)
    r = r.filter((F.col("regime") == "hvn") | F.coalesce(embedded, F.lit(False)))
    return r.select(*KEY, "regime", "start_bin", "end_bin", F.col("_d.bin_index").alias("dominant_bin"), ((F.col("_d.bin_low") + F.col("_d.bin_high")) / 2).alias("dominant_price"), "max_density", "mean_density")


def _r(c: str, n: int) -> Column:
    return F.round(F.col(c), n).alias(c)


def session_profiles(trades: DataFrame, n_bins: int = 50) -> DataFrame:
    """One nested, rounded row per session, as exported: scalars, the bins, and the regions of high and low volume."""
    bins = profile_bins(trades, n_bins)
    rounded = F.struct("bin_index", _r("bin_low", 2), _r("bin_high", 2), _r("buy_volume", 3), _r("sell_volume", 3), _r("total_volume", 3), _r("delta", 3))
    head = bins.groupBy(*KEY).agg(F.first("session_low").alias("session_low"), F.first("session_high").alias("session_high"), F.first("bin_width").alias("bin_width"), F.count(F.lit(1)).cast("int").alias("bins"), F.sort_array(F.collect_list(rounded)).alias("volume_profile"))
    reg = F.struct("start_bin", "end_bin", "dominant_bin", _r("dominant_price", 2), _r("max_density", 4), _r("mean_density", 4))
    rs = regions(bins).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(F.col("regime") == "hvn", reg))).alias("hvn_regions"), F.sort_array(F.collect_list(F.when(F.col("regime") == "lvn", reg))).alias("lvn_regions"))
    out = head.join(point_of_control(bins), KEY).join(value_area(bins), KEY).join(rs, KEY, "left")
    return out.select(*KEY, _r("session_low", 2), _r("session_high", 2), _r("bin_width", 4), "bins", "poc_bin_index", _r("poc_price", 2), _r("poc_volume", 3), _r("val", 2), _r("vah", 2), "hvn_regions", "lvn_regions", "volume_profile")


def watch_zones(bins: DataFrame, areas: DataFrame, limit: int = 6) -> DataFrame:
    """Up to ``limit`` structurally interesting bins per session, most prominent first. ``bins`` as exported (rounded); ``areas``: val and vah."""
    b = bins.join(areas.select(*KEY, "val", "vah"), KEY)
    vol, dlt = F.col("total_volume"), F.abs("delta")

    def mean_of(offsets: list[int], what: Column) -> Column:
        near = [F.lag(what, k).over(_bins_window()) if k > 0 else F.lead(what, -k).over(_bins_window()) for k in offsets]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in near[1:]), F.coalesce(near[0], F.lit(0.0)))
        count = sum((x.isNotNull().cast("int") for x in near[1:]), near[0].isNotNull().cast("int"))
        return F.try_divide(total, count)

    b = b.withColumn("_m1", mean_of([1, -1], vol)).withColumn("_m2", mean_of([2, 1, -1, -2], vol)).withColumn("_d1", mean_of([1, -1], dlt))
    b = b.withColumn("_mean", F.sum("total_volume").over(_session_window()) / F.count(F.lit(1)).over(_session_window()))
    ranked = Window.partitionBy(*KEY).orderBy("total_volume", "bin_index")
    b = b.withColumn("_rn", F.row_number().over(ranked) - 1).withColumn("_cnt", F.count(F.lit(1)).over(_session_window()))
    b = b.withColumn("_q75", F.max(F.when(F.col("_rn") == F.floor(0.75 * (F.col("_cnt") - 1)), vol)).over(_session_window()))
    floor_ = F.lit(1e-12)
    prominence = vol / F.greatest("_m2", floor_)
    divergence = (vol - F.col("_m1")) / F.greatest("_m1", floor_)
    anomaly = (vol >= 1.35 * F.col("_m1")) & (vol >= 1.05 * F.col("_mean"))
    hit = (prominence >= 1.60) | (anomaly & (divergence >= 0.30)) | ((vol >= F.col("_q75")) & (prominence >= 1.20) & (divergence >= 0.12))
    near = lambda edge: (F.abs(F.col("bin_high") - F.col(edge)) <= F.col("bin_width")) | (F.abs(F.col("bin_low") - F.col(edge)) <= F.col("bin_width"))
    z = b.filter(F.col("_m1").isNotNull()).withColumns({
        "local_volume_anomaly": anomaly, "delta_asymmetry": dlt >= 1.5 * F.greatest("_d1", floor_), "edge_proximity": F.when(near("vah"), "VAH").when(near("val"), "VAL").otherwise("INSIDE_VALUE"),
        "neighbor_divergence": F.round(divergence, 3), "topology_prominence": F.round(prominence, 3), "_hit": hit,
    }).filter("_hit")
    best = Window.partitionBy(*KEY).orderBy(F.col("topology_prominence").desc(), F.col("neighbor_divergence").desc(), "bin_index")
    z = z.withColumn("zone_rank", F.row_number().over(best)).filter(F.col("zone_rank") <= limit)
    return z.select(*KEY, "zone_rank", "bin_index", F.col("bin_low").alias("price_low"), F.col("bin_high").alias("price_high"), "local_volume_anomaly", "delta_asymmetry", "edge_proximity", "neighbor_divergence", "topology_prominence")


def exported_bins(bins: DataFrame) -> DataFrame:
    """Bins rounded as exported: the input of ``watch_zones``."""
    return bins.select(*KEY, "bin_index", _r("bin_low", 2), _r("bin_high", 2), _r("bin_width", 4), _r("total_volume", 3), _r("delta", 3))


def auction_context(bins: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per session with its watch zones as an array, empty where there are none."""
    zone = F.struct("zone_rank", "bin_index", "price_low", "price_high", F.struct("local_volume_anomaly", "delta_asymmetry", "edge_proximity", "neighbor_divergence", "topology_prominence").alias("features"))
    z = watch_zones(bins, areas).groupBy(*KEY).agg(F.sort_array(F.collect_list(zone)).alias("watch_zones"))
    out = areas.select(*KEY).join(z, KEY, "left")
    return out.withColumn("watch_zones", F.coalesce("watch_zones", F.array().cast(z.schema["watch_zones"].dataType)))


def balance_state(candles: DataFrame, areas: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Candles against the value area of the calendar day before their session: inside is balance, outside imbalance.

    Without such a session the candle is left out, or 'unknown' with ``keep_unknown``. The areas are one row a session: an equi-join.
    """
    prev = areas.select(F.col("symbol").alias("_s"), F.date_format(F.date_add(F.to_date("session_id"), 1), "yyyy-MM-dd").alias("_next"), F.col("session_id").alias("previous_session_id"), F.col("val").alias("previous_val"), F.col("vah").alias("previous_vah"))
    c = candles.withColumn("session_id", session_id(F.col("timestamp_ms")))
    j = c.join(prev, (c["symbol"] == prev["_s"]) & (c["session_id"] == prev["_next"]), "left" if keep_unknown else "inner")
    known = F.col("previous_val").isNotNull()
    location = F.when(~known, "unknown").when(F.col("close") > F.col("previous_vah"), "above_vah").when(F.col("close") < F.col("previous_val"), "below_val").otherwise("inside")
    state = F.when(~known, "unknown").when((F.col("close") >= F.col("previous_val")) & (F.col("close") <= F.col("previous_vah")), "balance").otherwise("imbalance")
    return j.select("symbol", "timeframe", "timestamp_ms", "session_id", "close", "previous_session_id", "previous_val", "previous_vah", location.alias("location"), state.alias("balance_state"))


def profile_overlay(bins: DataFrame, areas: DataFrame, clamp: DataFrame, delta_share: float = 0.35) -> DataFrame:
    """Bins to draw beside the next session: cut to [clamp_low, clamp_high], flagged if strictly inside the value area, with widths as shares of the overlay (65 % volume, 35 % delta)."""
    b = bins.join(areas.select(*KEY, "val", "vah"), KEY).join(clamp.select(*KEY, "clamp_low", "clamp_high"), KEY)
    b = b.filter((F.col("bin_high") >= F.col("clamp_low")) & (F.col("bin_low") <= F.col("clamp_high")))
    b = b.withColumn("low", F.greatest("bin_low", "clamp_low")).withColumn("high", F.least("bin_high", "clamp_high")).filter("high > low")
    top_v, top_d = F.max(F.when(F.col("total_volume") > 0, F.col("total_volume"))).over(_session_window()), F.max(F.when(F.col("delta") != 0, F.abs("delta"))).over(_session_window())
    return b.select(
        *KEY, "bin_index", "low", "high", "total_volume", "delta", ((F.col("bin_low") > F.col("val")) & (F.col("bin_high") < F.col("vah"))).alias("in_value_area"),
        F.coalesce((1 - delta_share) * F.try_divide("total_volume", top_v), F.lit(0.0)).alias("volume_width"), F.coalesce(delta_share * F.try_divide(F.abs("delta"), top_d), F.lit(0.0)).alias("delta_width"),
    )


def overlay_window(start: Column, end: Column, ratio: float) -> tuple[Column, Column]:
    """Where an overlay of a profile is drawn: from its session's start over ``ratio`` (above 0, at most 1) of its duration."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be above 0 and at most 1: {ratio}")
    return start, start + F.round((end - start) * ratio).cast("long")
