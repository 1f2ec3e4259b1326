"""The live source against a feed on this machine that drops its connection."""

import json
import socket
import threading
import time

from tapewright.sources.exchange import message_stream, trade_stream
from tapewright.streaming import live


def message(i):
    return json.dumps({"T": 1_700_000_000_000 + 400 * i, "p": str(100 + i), "q": "2", "m": i % 2 == 1}) if i != 3 else "no json"


def serve(server):
    """Two connections of six lines; the first ends in the middle of a line."""
    for part in (range(0, 6), range(6, 12)):
        line, _ = server.accept()
        for i in part:
            line.sendall((message(i) + "\n").encode())
        line.sendall(b'{"T": 1')
        time.sleep(0.3)
        line.close()


def test_reconnect_begins_a_session(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=serve, args=(server,), daemon=True).start()
    trades = trade_stream(message_stream(spark, *server.getsockname()[:2], spool=f"file://{tmp_path}/spool", reconnect_s=0.1, wait_s=0.4), "A")
    q = live.order_flow_stream(trades, 1000, connection="connection").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start(f"{tmp_path}/out")
    until = time.time() + 60
    while time.time() < until:
        time.sleep(1)
        if q.exception():
            raise q.exception()
        if (tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema(live.FLOW_SCHEMA).parquet(f"{tmp_path}/out").count() >= 11:
            break
    q.stop()
    server.close()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [r["seq"] for r in got] == [i for i in range(12) if i != 3]
    assert [r["session_cum_delta"] for r in got] == [2.0, 0.0, 2.0, 4.0, 2.0, 2.0, 0.0, 2.0, 0.0, 2.0, 0.0]
    assert [r["warm"] for r in got][5] is False


def test_spooled_lines_can_be_read_again(tmp_path):
    from tapewright.sources.exchange import _Feed

    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=serve, args=(server,), daemon=True).start()
    host, port = server.getsockname()[:2]
    options = {"host": host, "port": str(port), "spool": f"file://{tmp_path}/spool", "reconnect_s": "0.1", "wait_s": "0.3"}
    feed, at, rows = _Feed(options), {"n": 0}, []
    for _ in range(20):
        got, at = feed.read(at)
        rows += got
    assert [r[2] for r in rows] == [message(i) for i in range(12)] and [r[1] for r in rows] == [0] * 6 + [1] * 6
    assert list(_Feed(options).readBetweenOffsets({"n": 2}, {"n": 9})) == rows[2:9]
    assert _Feed(options)._spooled_connection() == 1
    server.close()


def test_streams_are_counted_and_stopped(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = live.StreamStatistics()
    spark.streams.addListener(counts)
    q = live.record(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", every="200 milliseconds", checkpoint=f"{tmp_path}/c")
    stop = threading.Event()
    threading.Timer(6, stop.set).start()
    live.collect_until([q], stop, 0.2)
    assert not q.isActive and spark.read.schema("id long").json(f"{tmp_path}/out").count() == 50
    until = time.time() + 10
    while counts.rows.get(str(q.id)) != 50 and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(counts)
    assert counts.rows[str(q.id)] == 50 and counts.batches[str(q.id)] >= 1


def test_features_of_files_that_lack_columns(spark, tmp_path):
    from tapewright.sources.tape import read_features

    spark.createDataFrame([(1, 2.0, 3.0, "BUY"), (2, 2.0, -1.0, "sell"), (3, None, 1.0, "sell")], "timestamp long, price double, quantity double, side string").write.parquet(f"{tmp_path}/p/a")
    spark.createDataFrame([(4, 2.0)], "timestamp long, price double").write.parquet(f"{tmp_path}/p/b")
    rows, stats = read_features(spark, f"{tmp_path}/p/*", "A")
    assert [(r["timestamp"], r["side"], r["delta"]) for r in rows.collect()] == [(1, "buy", 3.0)]
    assert (stats.first()["total"], stats.first()["parsed"], stats.first()["bad"]) == (4, 1, 3)
