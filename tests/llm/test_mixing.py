import pytest

pytest.importorskip("tapewright.llm")

from tapewright.llm.mixing import mix_sources, plan_mixture, schedule  # noqa: E402

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=6000):
    import random

    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else r.choice(["b", "c", None, "other"]), int(r.lognormvariate(4, 1)), "clash") for i in range(n)]
    return spark.createDataFrame(rows + [(1, "hot", None, "clash")], "doc_id long, source string, n_tokens long, copies string")


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("hot", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 4), ("none", 0.05, 3)], TARGETS)
    copies, report = mix_sources(docs(spark), targets)
    limit = {"hot": 1, "b": 4, "c": 4}
    rows = copies.collect()
    assert len(rows) == docs(spark).filter("source in ('hot', 'b', 'c')").count()
    assert all(0 <= r["copies"] <= limit[r["source"]] for r in rows)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["none"]["status"] == "empty" and rep["none"]["mixed_tokens"] == 0
    for s, w in (("hot", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(rep[s]["actual_share"] - w / 0.95) < 0.01
    assert sum(r["n_tokens"] * r["copies"] for r in rows) == sum(r["mixed_tokens"] for r in rep.values())


def test_total_out_of_reach_and_empty(spark):
    targets = spark.createDataFrame([("hot", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    _, report = mix_sources(docs(spark), targets, total=10**9)
    assert {r["status"] for r in report.collect()} == {"out of reach"}
    copies, report = mix_sources(docs(spark).limit(0), targets)
    assert copies.count() == 0 and all(r["actual_share"] is None for r in report.collect())


def test_schedule_is_even_at_every_prefix(spark):
    plan = plan_mixture([("a", 0.7, 1), ("b", 0.2, 1), ("c", 0.1, 1)], {"a": 700_000, "b": 200_000, "c": 100_000})
    rows = schedule(spark, plan).orderBy("slot").collect()
    share, seen = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0, "b": 0, "c": 0}
    for k, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        if k >= 16:
            assert all(abs(seen[s] - share[s] * k) < 12 for s in share)


def test_every_source_counts_unless_told():
    targets, available = [("a", 0.95, 1), ("b", 0.05, 1)], {"a": 950_000, "b": 100}
    assert plan_mixture(targets, available).status == {"a": "reached", "b": "reached"}
    assert plan_mixture(targets, available, leave_out=0.1).status == {"a": "reached", "b": "out of reach"}


def test_blocks_stop_growing():
    assert plan_mixture([("a", 1.0, 1)], {"a": 10**13}).block == 1_000_000
