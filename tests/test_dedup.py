import random
import shutil

import pytest
from pyspark.sql import functions as F

from tapewright.functions.common import epoch_ms
from tapewright.operators import dedup
from tapewright.operators.dedup import StateChanged, compact, deliver, deliver_once, load_state

SCHEMA = "delivery_id long, symbol string, trade_id long, timestamp long, message string"


def make(n=1500):
    r = random.Random(5)
    rows = []
    for i in range(n):
        t = 1_454_284_817_133 + r.randrange(0, 3) * 7
        unit = r.choice([1, 1000, 1_000_000])
        rows.append((i, r.choice(["abc", "ABC", "x", None]) if i % 3 else "ABC", r.choice([1, 2, 300, None]) if i % 3 else 7, t * unit + (r.randrange(0, unit) if unit > 1 else 0), "clash"))
    return rows


def truth(rows):
    seen, out = set(), set()
    for i, s, t, ts, _ in rows:
        if s is None or t is None:
            continue
        ms = ts if ts < 10**14 else ts // 1000 if ts < 10**17 else ts // 10**6
        k = (s.upper(), t, ms)
        (out.add(i) if k in seen else seen.add(k))
    return out


def key():
    return [F.upper("symbol"), F.col("trade_id"), epoch_ms(F.col("timestamp"))]


def test_one_batch_and_nulls(spark):
    rows = make()
    kept, repeated = deliver_once(spark.createDataFrame(rows, SCHEMA), key(), "delivery_id", shards=8)
    assert {r[0] for r in repeated.select("delivery_id").collect()} == truth(rows)
    assert kept.count() + repeated.count() == len(rows)


def test_batches_share_state(spark, tmp_path):
    rows, root, got = make(), f"file://{tmp_path}/seen", set()
    assert load_state(spark, root).number == 0
    for a in range(0, len(rows), 500):
        _, repeated = deliver_once(spark.createDataFrame(rows[a : a + 500], SCHEMA), key(), "delivery_id", root, shards=4)
        got |= {r[0] for r in repeated.select("delivery_id").collect()}
    assert got == truth(rows)
    state = load_state(spark, root)
    words = state.arrivals(spark)
    ones = state.bitmaps(spark).agg(F.sum(F.bitmap_count("seen"))).first()[0]
    assert ones == words.count() == words.select("_shard", "code").distinct().count()
    packed = compact(spark, state)
    assert packed == load_state(spark, root) and len(packed.versions) == 1
    assert deliver(spark.createDataFrame(rows, SCHEMA), key(), "delivery_id", packed)[0].count() == 0


def test_segments_of_one_log(spark):
    rows = make()
    for batches in (2, 5):
        _, repeated = deliver_once(spark.createDataFrame(rows, SCHEMA), key(), "delivery_id", shards=4, batches=batches)
        assert {r[0] for r in repeated.select("delivery_id").collect()} == truth(rows)


def test_the_bits_decide(spark, tmp_path):
    """Without a stored bitmap its identifiers count as unseen again."""
    rows, root = make(300), f"file://{tmp_path}/seen"
    df = spark.createDataFrame(rows, SCHEMA)
    first, state = deliver(df, key(), "delivery_id", load_state(spark, root, 2))
    assert deliver(df, key(), "delivery_id", state)[0].count() == 0
    for v in state.versions:
        shutil.rmtree(tmp_path / "seen" / v / "bitmaps")
        spark.createDataFrame([], "_shard int, _bucket int, seen binary").write.parquet(f"{root}/{v}/bitmaps")
    assert {r[0] for r in deliver(df, key(), "delivery_id", load_state(spark, root))[0].collect()} == {r[0] for r in first.collect()}


def test_failure_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    rows, root = make(300), f"file://{tmp_path}/seen"
    df = spark.createDataFrame(rows, SCHEMA)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(dedup, "_switch", fail)
        with pytest.raises(OSError):
            deliver(df, key(), "delivery_id", load_state(spark, root), "b1")
    assert load_state(spark, root).number == 0
    kept, _ = deliver(df, key(), "delivery_id", load_state(spark, root), "b1")
    again, state = deliver(df, key(), "delivery_id", load_state(spark, root), "b1")
    assert sorted(kept.collect()) == sorted(again.collect()) and kept.count() > 0 and state.number == 1


def test_two_writers(spark, tmp_path):
    rows, root = make(200), f"file://{tmp_path}/seen"
    a = b = load_state(spark, root)
    deliver(spark.createDataFrame(rows[:100], SCHEMA), key(), "delivery_id", a)
    with pytest.raises(StateChanged):
        deliver(spark.createDataFrame(rows[100:], SCHEMA), key(), "delivery_id", b)
    assert load_state(spark, root).number == 1


def test_empty(spark):
    kept, repeated = deliver_once(spark.createDataFrame([], SCHEMA), key(), "delivery_id")
    assert kept.count() == repeated.count() == 0


def test_epoch_units(spark):
    df = spark.createDataFrame([(1454284817,), (1454284817133,), (1454284817133999,), (1454284817133999999,), (None,)], "t long")
    assert [r[0] for r in df.select(epoch_ms(F.col("t"))).collect()] == [1454284817000, 1454284817133, 1454284817133, 1454284817133, None]
