import random

from tapewright.operators.intervals import merge_ranges, periods_and_gaps

SCHEMA = "symbol string, session_id string, min_ts long, max_ts long, kind string"


def brute(rows, tol):
    out = set()
    by = {}
    for s, d, a, b, _ in rows:
        if a is not None and b is not None and a <= b:
            by.setdefault((s, d), []).append((a, b))
    for k, v in by.items():
        periods = []
        for a, b in sorted(v):
            if periods and a <= periods[-1][1] + tol:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out |= {(*k, "period", a, b) for a, b in periods}
        out |= {(*k, "gap", p[1], q[0]) for p, q in zip(periods, periods[1:])}
    return out


def check(spark, rows, tol, shard):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["symbol", "session_id"], "min_ts", "max_ts", tol, shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, tol)


def test_random_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for _ in range(600):
        a = r.randrange(0, 60_000)
        rows.append((r.choice(["A", "B", None]), r.choice(["x", None]), a if r.random() > 0.05 else None, a + r.choice([0, 1, 50, 400, 5000, -3]), "clash"))
    rows += rows[:50]
    for tol, shard in ((0, 1_000), (1, 700), (100, 5_000), (100, 10**9)):
        check(spark, rows, tol, shard)


def test_touching_instants_and_negative_times(spark):
    check(spark, [("A", "d", 0, 0, ""), ("A", "d", 1000, 1000, ""), ("A", "d", 2001, 2001, ""), ("A", "d", -5000, -4000, ""), ("A", "d", 5, None, "")], 1000, 3_600_000)


def test_one_range_spans_many_shards(spark):
    check(spark, [("A", "d", 0, 100_000, "")] + [("A", "d", i * 1000, i * 1000 + 1, "") for i in range(120)], 10, 5_000)


def test_empty_and_counts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ["symbol", "session_id"], "min_ts", "max_ts").count() == 0
    df = spark.createDataFrame([("A", "d", 0, 10, ""), ("A", "d", 5, 20, ""), ("A", "d", 0, 10, "")], SCHEMA)
    assert merge_ranges(df, ["symbol"], "min_ts", "max_ts").collect()[0]["n_ranges"] == 3


def test_bounds_far_from_today(spark):
    top, low, far = 2**63 - 1, -(2**63), 253_402_300_800_000
    rows = [("A", "d", far, far + 5, ""), ("A", "d", far + 2000, top, ""), ("A", "d", top, top, ""), ("A", "d", low, low, ""), ("A", "d", low + 900, 7, ""), ("A", "d", 5000, far - 5000, "")]
    check(spark, rows, 1000, 3_600_000)
    check(spark, [("B", "d", low, top, ""), ("B", "d", 3, 4, "")], 0, 3_600_000)
