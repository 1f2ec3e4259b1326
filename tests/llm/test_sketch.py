import pytest

pytest.importorskip("tapewright.llm")

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from tapewright.llm.sketch import merge_states, percentiles, rank_error, rank_errors, sketch_states  # noqa: E402

Q = [0.01, 0.25, 0.5, 0.75, 0.99]


def test_error_bound_and_merging(spark):
    r = np.random.default_rng(1)
    n = 60_000
    d = pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, "hot", "cold"), "day": np.arange(n) % 5, "v": np.round(r.lognormal(0, 2, n), 2), "v_n": 1})
    d.loc[::100, "v"] = np.nan
    df = spark.createDataFrame(pd.concat([d, d.iloc[:2000]])).repartition(7)
    by_day = sketch_states(df, ["g", "day"], ["v"], row_id="id", k=512)
    for answers in (percentiles(merge_states(by_day, ["g"], ["v"]), ["g"], ["v"], Q), percentiles(sketch_states(df, ["g"], ["v"], row_id="id", k=512), ["g"], ["v"], Q)):
        for x in answers.collect():
            v = np.sort(d.loc[(d["g"] == x["g"]) & d["v"].notna(), "v"].to_numpy())
            assert x["n"] == len(v)
            for q, a in zip(Q, x["answers"]):
                lo, hi = np.searchsorted(v, a, "left") / len(v), np.searchsorted(v, a, "right") / len(v)
                assert max(lo - q, q - hi, 0) <= rank_error(512)


def test_small_groups_are_exact_and_empty_defined(spark):
    df = spark.createDataFrame([("a", 5.0, 1), ("a", 5.0, 2), (None, None, 3), (None, float("nan"), 4), ("b", 1.0, None), ("b", 3.0, None)], "g string, v double, id long")
    got = {x["g"]: x for x in percentiles(sketch_states(df, ["g"], ["v"], row_id="id"), ["g"], ["v"], [0.5]).collect()}
    assert got["a"]["answers"] == [5.0] and got[None]["answers"] is None and got[None]["n"] == 0 and got["b"]["n"] == 2
    assert percentiles(sketch_states(df.limit(0), ["g"], ["v"]), ["g"], ["v"], Q).count() == 0


def test_check_counts_rows_as_the_sketch_does(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", 2.0, None), ("a", 3.0, None)], "g string, v double, id long")
    got = percentiles(sketch_states(df, ["g"], ["v"], row_id="id"), ["g"], ["v"], [0.5])
    assert got.first()["n"] == rank_errors(df, got, ["g"], row_id="id").first()["n"] == 3
