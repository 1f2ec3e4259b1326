"""A live stream of exchange messages as a Structured Streaming source: lines from a TCP feed, with reconnects.

Lines are spooled to a folder before the engine sees them, so a batch can be read again after a failure though the feed can't. Each row bears the number of its connection: it rises with
every reconnect, which is where sessions begin (``order_flow_stream(..., connection="connection")``).
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tapewright.functions.common import work_path
from tapewright.sources.tape import parse_exchange_message

SCHEMA = "n long, connection int, message string"


class _Feed(SimpleDataSourceStreamReader):
    """Offsets count lines. ``read`` gives what the feed has sent within ``wait_s``, at most ``most`` lines."""

    def __init__(self, options: dict) -> None:
        self.at = (options["host"], int(options["port"]))
        self.spool, self.retry, self.wait, self.most = options["spool"], float(options.get("reconnect_s", 5)), float(options.get("wait_s", 1)), int(options.get("max_lines", 10_000))
        self.line: socket.socket | None = None
        self.rest, self.connection, self.next_try = b"", -1, 0.0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.spool)

    def _connect(self) -> None:
        if self.line is None and time.monotonic() >= self.next_try:
            try:
                self.line = socket.create_connection(self.at, timeout=self.wait)
                if self.connection < 0:
                    self.connection = self._spooled_connection()
                self.connection += 1
                self.rest = b""
            except OSError:
                self.next_try = time.monotonic() + self.retry

    def _spooled_connection(self) -> int:
        """The last connection an earlier run of this stream has seen, -1 if there was none."""
        return max((c for _, c, _ in self._read(0, None)), default=-1)

    def _lines(self) -> list[bytes]:
        """Whole lines that arrive within the wait. A lost connection gives up its unfinished line."""
        found, until = [], time.monotonic() + self.wait
        while len(found) < self.most and time.monotonic() < until:
            self._connect()
            if self.line is None:
                time.sleep(min(0.05, self.wait))
                continue
            try:
                self.line.settimeout(max(until - time.monotonic(), 0.01))
                data = self.line.recv(65_536)
            except TimeoutError:
                break
            except OSError:
                data = b""
            if not data:
                self.line.close()
                self.line, self.next_try = None, time.monotonic() + self.retry
                break
            *whole, self.rest = (self.rest + data).split(b"\n")
            found += [x for x in whole if x.strip()]
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        connection = max(self.connection, 0)
        lines = self._lines()
        connection = max(self.connection, connection)
        rows = [(start["n"] + i, connection, x.decode("utf-8", "replace")) for i, x in enumerate(lines)]
        if rows:
            files, root = self._files()
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{start['n']:020d}.jsonl") as out:
                out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        return iter(rows), {"n": start["n"] + len(rows)}

    def _read(self, start: int, end: int | None) -> list[tuple]:
        from pyarrow import fs

        files, root = self._files()
        rows = []
        for f in sorted(files.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.base_name):
            with files.open_input_stream(f.path) as source:
                rows += [tuple(json.loads(x)) for x in source.read().decode().splitlines()]
        return [r for r in rows if r[0] >= start and (end is None or r[0] < end)]

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._read(start["n"], end["n"]))


class ExchangeFeed(DataSource):
    """Format ``exchange_feed``: options host, port, spool (a folder that outlives the driver), reconnect_s (5), wait_s (1), max_lines (10,000)."""

    @classmethod
    def name(cls) -> str:
        return "exchange_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Feed(dict(self.options))


def message_stream(spark: SparkSession, host: str, port: int, spool: str | None = None, **options) -> DataFrame:
    """``n``, ``connection``, ``message`` of a feed of lines."""
    spark.dataSource.register(ExchangeFeed)
    reader = spark.readStream.format("exchange_feed").options(host=host, port=str(port), spool=spool or work_path(spark, "spool"), **{k: str(v) for k, v in options.items()})
    return reader.load()


def trade_stream(messages: DataFrame, symbol: str) -> DataFrame:
    """Canonical trades with ``connection`` and ``delta``; messages that are no trades are left out."""
    e = messages.select("n", "connection", parse_exchange_message(F.col("message")).alias("e")).filter("e is not null")
    sell = F.col("e.side") == "sell"
    return e.select(
        F.lit(symbol).alias("symbol"), F.col("n").alias("seq"), F.col("e.timestamp").alias("timestamp"), F.col("e.price").alias("price"), F.col("e.quantity").alias("qty"), sell.alias("is_buyer_maker"),
        F.when(sell, -F.col("e.quantity")).otherwise(F.col("e.quantity")).alias("delta"), "connection",
    )
