"""Structured Streaming: candles as they close, order flow over a trailing window, sinks, and the signal machine as a stream.

Late trades: a trade older than the watermark is dropped; a bucket is emitted once, when the watermark has passed its end.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tapewright.functions.common import materialize, with_positions, work_path
from tapewright.functions.halo import BUCKET_MS, over_shards
from tapewright.operators.candles import timeframe_to_ms
from tapewright.operators.folds import SIGNAL_SCHEMA, SignalMachine
from tapewright.sources.tape import exact_sum


def candle_stream(trades: DataFrame, timeframe: str = "15m", delay: str = "1 minute") -> DataFrame:
    """Candles of a stream of canonical trades, in append mode: each once, closed. Buckets without trades are not emitted."""
    seconds = timeframe_to_ms(timeframe) // 1000
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    order = F.struct("timestamp", "price", "qty", "seq")
    t = trades.withColumn("ts", F.timestamp_millis("timestamp")).withWatermark("ts", delay)
    g = t.groupBy("symbol", F.window("ts", f"{seconds} seconds")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), exact_sum(F.col("qty")).alias("volume"),
        exact_sum(F.when(side == "buy", F.col("qty")).otherwise(0.0)).alias("buy_volume"), exact_sum(F.when(side == "sell", F.col("qty")).otherwise(0.0)).alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return g.select("symbol", F.lit(timeframe).alias("timeframe"), F.unix_millis("window.start").alias("timestamp_ms"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"), "trade_count")


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and give its output: written exactly once to the shared folder."""
    base = work_path(stream.sparkSession, label)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


class CandleAggregator:
    """Candles of one symbol, event by event: ``update`` gives the candle that an event closes, or None. Buckets without events are skipped."""

    def __init__(self, timeframe: str) -> None:
        self.timeframe, self.step = timeframe, timeframe_to_ms(timeframe)
        self.reset()

    def reset(self) -> None:
        self._now: dict | None = None

    def get_current_candle(self) -> dict | None:
        return dict(self._now) if self._now else None

    def update(self, event: dict) -> dict | None:
        start = event["timestamp"] // self.step * self.step
        closed = None
        if self._now is not None and start != self._now["start_time"]:
            closed, self._now = self._now, None
        price, qty = event["price"], event["quantity"]
        if self._now is None:
            self._now = {"timeframe": self.timeframe, "start_time": start, "end_time": start + self.step - 1, "open": price, "high": price, "low": price, "close": price, "volume": 0.0, "buy_volume": 0.0, "sell_volume": 0.0, "delta": 0.0, "trade_count": 0}
        c = self._now
        c["high"], c["low"], c["close"] = max(c["high"], price), min(c["low"], price), price
        c["volume"] += qty
        c["buy_volume" if event["side"] == "buy" else "sell_volume"] += qty
        c["delta"] = c["buy_volume"] - c["sell_volume"]
        c["trade_count"] += 1
        return closed


def _sessions(tape: DataFrame, gap_ms: int | None, connection: str | None) -> DataFrame:
    """Adds ``_session`` (numbered per symbol) and ``_since`` (its first instant). Counted over time buckets, so no symbol is one task."""
    if gap_ms is None and connection is None:
        d = tape.withColumn("_session", F.lit(0).cast("long"))
    else:
        def begins(d: DataFrame, w) -> DataFrame:
            new = F.lit(False)
            if gap_ms is not None:
                new = new | (F.col("timestamp") - F.lag("timestamp").over(w) > gap_ms)
            if connection is not None:
                new = new | ~F.lag(connection).over(w).eqNullSafe(F.col(connection))
            return d.withColumn("_new", (F.coalesce(new, F.lit(False)) & (F.row_number().over(w) > 1)).cast("long"))

        d = over_shards(tape, begins, 1, 1).drop("event_idx")
        d = with_positions(d, ["symbol"], ["timestamp", "seq"], F.floor(F.col("timestamp") / F.lit(BUCKET_MS)), F.col("_new"))
        d = d.withColumn("_session", F.col("_before") + F.col("_new")).drop("_new", "_before", "_pos", "_bucket")
    d = materialize(d, "sessions")
    since = d.groupBy(F.col("symbol").alias("_s"), F.col("_session").alias("_n")).agg(F.min("timestamp").alias("_since"))
    return d.join(since, d["symbol"].eqNullSafe(since["_s"]) & (d["_session"] == since["_n"])).drop("_s", "_n")


def order_flow(tape: DataFrame, window_ms: int = 5_000, gap_ms: int | None = None, connection: str | None = None) -> DataFrame:
    """Flow of the trailing ``window_ms`` at each trade: volumes, delta, pressure, rates and price range; and the delta since the session began.

    A session begins at a pause longer than ``gap_ms``, and where the column ``connection`` changes (a reconnect); with neither a symbol is one session. No window reaches back over a
    session's beginning, and ``warm`` says that its window is full. Which trades are absorbed is a caller's rule.
    Tape: symbol, seq, timestamp, price, quantity, delta. The trailing frame is within (symbol, time shard), with the window before each shard as halo; the session's delta comes from
    sums per time bucket.
    """
    d = _sessions(tape, gap_ms, connection)
    d = with_positions(d, ["symbol", "_session"], ["timestamp", "seq"], F.floor(F.col("timestamp") / F.lit(BUCKET_MS)), F.col("delta"), weight_type="decimal(28,8)")
    d = d.withColumn("session_cum_delta", (F.col("_before") + F.coalesce(F.col("delta"), F.lit(0.0)).cast("decimal(28,8)")).cast("double")).drop("_before", "_pos", "_bucket")
    width = max(600_000, 4 * window_ms)
    shard = F.floor(F.col("timestamp") / F.lit(width))
    copies = F.filter(F.array(shard, F.when(F.pmod("timestamp", F.lit(width)) >= width - window_ms, shard + 1)), lambda x: x.isNotNull())
    d = d.withColumn("_own", shard).withColumn("_shard", F.explode(copies))
    w = Window.partitionBy("symbol", "_session", "_shard").orderBy("timestamp").rangeBetween(-(window_ms - 1), 0)
    dec = lambda c: F.sum(c.cast("decimal(28,8)")).over(w).cast("double")
    seconds = window_ms / 1000
    d = d.withColumns({
        "buy_volume": dec(F.greatest("delta", F.lit(0.0))), "sell_volume": dec(F.greatest(-F.col("delta"), F.lit(0.0))), "window_cum_delta": dec(F.col("delta")),
        "_n": F.count(F.lit(1)).over(w), "price_range": F.max("price").over(w) - F.min("price").over(w),
    })
    d = d.filter(F.col("_own") == F.col("_shard"))
    total = F.col("buy_volume") + F.col("sell_volume")
    return d.select(
        "symbol", "seq", "timestamp", "price", "delta", "window_cum_delta", "session_cum_delta", "buy_volume", "sell_volume", F.try_divide("window_cum_delta", total).alias("pressure"), (total / seconds).alias("volume_per_sec"),
        (F.col("window_cum_delta") / seconds).alias("delta_per_sec"), (F.col("_n") / seconds).alias("trade_intensity"), "price_range", (F.col("timestamp") - F.col("_since") >= window_ms).alias("warm"),
    )


FLOW_SCHEMA = (
    "symbol string, seq long, timestamp long, price double, delta double, window_cum_delta double, session_cum_delta double, buy_volume double, sell_volume double, pressure double, volume_per_sec double, "
    "delta_per_sec double, trade_intensity double, price_range double, warm boolean"
)


#: Trades that the streaming flow computes at once, at least; more where a window holds more.
FLOW_ROWS = 65_536


def _added(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of pairs, and what rounding took from each."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _slice_sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``x[lo:hi]`` for each pair of bounds, and what rounding took from it; values are not below 0. Differences of running sums, with their rounding errors summed beside them: values before a slice leave no trace in it."""
    v = np.where(np.isfinite(x), x, 0.0)
    run = np.concatenate([[0.0], np.cumsum(v)])
    lost = np.concatenate([[0.0], np.cumsum(_added(run[:-1], v)[1])])
    out, rest = _added(run[hi], -run[lo])
    for value, rows in ((np.inf, np.isinf(x)), (np.nan, np.isnan(x))):
        if rows.any():
            n = np.concatenate([[0], np.cumsum(rows)])
            out[n[hi] > n[lo]] = value
    return out, rest + (lost[hi] - lost[lo])


def _slice_max(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximum of ``x[lo:hi]`` for each pair of bounds (none empty), missing values aside: two overlapping runs of the largest power of two that fits, by doubling."""
    out, level, m = np.empty(len(lo)), np.frexp(hi - lo)[1] - 1, x
    for k in range(level.max(initial=-1) + 1):
        at, width = np.flatnonzero(level == k), 1 << k
        out[at] = np.fmax(m[lo[at]], m[hi[at] - width])
        m = np.fmax(m[:-width], m[width:])
    return out


class FlowWindow:
    """The flow of one symbol, event by event: what ``order_flow`` gives, trades of the same instant being seen one after the other. ``reset`` begins a session."""

    def __init__(self, window_ms: int = 5_000, gap_ms: int | None = None) -> None:
        self.window_ms, self.gap_ms = window_ms, gap_ms
        self.reset()

    def reset(self) -> None:
        self.events: list[tuple[int, float, float]] = []
        self.since: int | None = None
        self.total = 0.0

    def update(self, timestamp: int, price: float, delta: float) -> dict:
        if self.events and self.gap_ms is not None and timestamp - self.events[-1][0] > self.gap_ms:
            self.reset()
        self.since = timestamp if self.since is None else self.since
        self.events = [e for e in self.events if e[0] > timestamp - self.window_ms] + [(timestamp, price, delta)]
        self.total += delta
        buy, sell = sum(max(d, 0.0) for _, _, d in self.events), sum(max(-d, 0.0) for _, _, d in self.events)
        prices, seconds = [p for _, p, _ in self.events], self.window_ms / 1000
        return {
            "window_cum_delta": buy - sell, "session_cum_delta": self.total, "buy_volume": buy, "sell_volume": sell, "pressure": (buy - sell) / (buy + sell) if buy + sell else None, "volume_per_sec": (buy + sell) / seconds,
            "delta_per_sec": (buy - sell) / seconds, "trade_intensity": len(self.events) / seconds, "price_range": max(prices) - min(prices), "warm": timestamp - self.since >= self.window_ms,
        }

    def update_many(self, t: np.ndarray, price: np.ndarray, delta: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """``update`` of trades in order of time, all at once, with a ``reset`` before those that ``begins`` marks. The cost of a trade doesn't grow with the window. Trades seen before may be later than these; missing prices don't count."""
        n, new = len(t), begins.copy()
        new[0] |= self.since is None
        if self.gap_ms is not None:
            new[1:] |= np.diff(t) > self.gap_ms
            new[0] |= bool(self.events) and t[0] - self.events[-1][0] > self.gap_ms
        firsts, end = np.flatnonzero(new), np.arange(1, n + 1)
        carried = int(firsts[0]) if len(firsts) else n
        began = np.maximum.accumulate(np.where(new, end - 1, 0))
        since = np.where(end <= carried, 0 if self.since is None else self.since, t[began])
        lo = np.maximum(np.searchsorted(t, t - self.window_ms, "right"), began)
        with np.errstate(divide="ignore", invalid="ignore"):
            sums = [_slice_sums(np.maximum(d, 0.0), lo, end) for d in (delta, -delta)]
            high, low, count = _slice_max(price, lo, end), -_slice_max(-price, lo, end), end - lo
            if carried and self.events:
                # What earlier calls left in the window of the first trades here.
                seen = sorted(self.events, key=lambda e: e[0])
                at = np.searchsorted(np.array([e[0] for e in seen], "int64"), t[:carried] - self.window_ms, "right")
                at = at[at < len(seen)]
                k, last = len(at), np.full(len(at), len(seen))
                p, d = (np.array([e[i] for e in seen], "float64") for i in (1, 2))
                for (whole, rest), x in zip(sums, (d, -d)):
                    more, also = _slice_sums(np.maximum(x, 0.0), at, last)
                    whole[:k], lost = _added(whole[:k], more)
                    rest[:k] += lost + also
                high[:k], low[:k] = np.fmax(high[:k], _slice_max(p, at, last)), np.fmin(low[:k], -_slice_max(-p, at, last))
                count[:k] += last - at
            buy, sell = (np.where(np.isfinite(whole), whole + rest, whole) for whole, rest in sums)
            total = np.empty(n)
            for a, b in zip([0, *firsts[firsts > 0]], [*firsts[firsts > 0], n]):
                total[a:b] = np.cumsum(np.concatenate([[0.0 if new[a] else self.total], delta[a:b]]))[1:]
            both, seconds = buy + sell, self.window_ms / 1000
            rows = {
                "window_cum_delta": buy - sell, "session_cum_delta": total, "buy_volume": buy, "sell_volume": sell, "pressure": np.where(both == 0, np.nan, (buy - sell) / both), "volume_per_sec": both / seconds,
                "delta_per_sec": (buy - sell) / seconds, "trade_intensity": count / seconds, "price_range": high - low, "warm": t - since >= self.window_ms,
            }
        kept = [] if len(firsts) else [e for e in self.events if e[0] > t[-1] - self.window_ms]
        self.events = kept + list(zip(*(x[lo[-1] :].tolist() for x in (t, price, delta))))
        self.since, self.total = int(since[-1]), float(total[-1])
        return rows


def order_flow_stream(trades: DataFrame, window_ms: int = 5_000, gap_ms: int | None = None, connection: str | None = None) -> DataFrame:
    """``order_flow`` of a stream (symbol, seq, timestamp, price, delta and, if named, a connection number): the window of each symbol is the engine's state. Trades of a batch are taken in order.

    A batch of a symbol is one task, which holds its trades as numbers (32 bytes each, 40 with a connection, and as much again while they are joined) and gives its rows a part at a time.
    """
    import json

    kinds = {"timestamp": "int64", "seq": None, "price": "float64", "delta": "float64"} | ({connection: None} if connection else {})

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flow, last = FlowWindow(window_ms, gap_ms), None
        if state.exists:
            events, flow.since, flow.total, last = json.loads(state.get[0])
            flow.events = [tuple(e) for e in events]
        parts = {c: [] for c in kinds}
        for pdf in pdfs:
            for c, kind in kinds.items():
                parts[c].append((pdf[c].astype(kind) if kind else pdf[c]).to_numpy(copy=True))
        d = {c: np.concatenate(parts.pop(c)) for c in kinds}
        order = np.lexsort((d["seq"], d["timestamp"]))
        for c in kinds:
            d[c] = d[c][order]
        begins = np.zeros(len(order), bool)
        if connection:
            at = d[connection]
            begins[1:], begins[0], last = at[1:] != at[:-1], last is not None and at[0] != last, at[-1]
        a = 0
        while a < len(order):
            part = slice(a, a + max(FLOW_ROWS, len(flow.events)))
            rows = flow.update_many(*[d[c][part] for c in ("timestamp", "price", "delta")], begins[part])
            yield pd.DataFrame({"symbol": key[0], **{c: d[c][part] for c in ("seq", "timestamp", "price", "delta")}, **rows}, columns=[x.split()[0] for x in FLOW_SCHEMA.split(", ")])
            a = part.stop
        state.update((json.dumps([flow.events, flow.since, flow.total, last if last is None else int(last)]),))

    return trades.groupBy("symbol").applyInPandasWithState(step, FLOW_SCHEMA, "window string", "append", "NoTimeout")


def record(stream: DataFrame, path: str, fmt: str = "json", every: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Append a stream to JSON lines or parquet files; null rows can't occur. ``every`` buffers for so long, None runs over what is there now."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    place = checkpoint or work_path(stream.sparkSession, "recorder")
    return stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", place).trigger(**trigger).start(path)


def dispatch(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Give each micro-batch to all sinks in turn, read once. A sink must bear the same batch number twice (after a failure)."""
    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    place = checkpoint or work_path(stream.sparkSession, "dispatch")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", place).trigger(**trigger).start()


def signal_machine_stream(tagged: DataFrame, window: int = 100, max_events: int = 80) -> DataFrame:
    """The signal machine over a stream of tagged features: its state per symbol is kept by the engine between batches."""
    import pickle

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = SignalMachine(window, max_events)
        if state.exists:
            machine.restore(pickle.loads(state.get[0]))
        rows = []
        for pdf in pdfs:
            for r in pdf.sort_values(["timestamp", "seq"], kind="stable").to_dict("records"):
                rows += [{"symbol": key[0], **o} for o in machine.step(r)]
        state.update((pickle.dumps(machine.save()),))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SIGNAL_SCHEMA.split(", ")])

    return tagged.groupBy("symbol").applyInPandasWithState(step, SIGNAL_SCHEMA, "machine binary", "append", "NoTimeout")


class StreamStatistics(StreamingQueryListener):
    """Rows, batches and failures per query, kept while streams run: ``spark.streams.addListener(StreamStatistics())``."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)
        self.batches.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception


def collect_until(queries: list[StreamingQuery], stop: threading.Event, every_s: float = 1.0) -> None:
    """Run streams until ``stop`` is set, then let each end its batch and stop it. A stream that fails ends all and its error is raised."""
    try:
        while not stop.wait(every_s):
            for q in queries:
                if q.exception() is not None:
                    raise q.exception()
    finally:
        for q in queries:
            while q.isActive and q.status["isTriggerActive"] and q.status["isDataAvailable"]:
                time.sleep(0.05)
            q.stop()
