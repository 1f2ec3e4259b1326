import json
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators.drift import consistent_records, dump, ingest, load_lenient, load_strict, name_likeness, read_object, record_profile, replay, schema_changes

SCHEMA = "record_id long, feed string, feed_kind string, file_no int, payload string, name string"


def feed(name, files, n=20, seed=1):
    """files: list of functions (random) -> record."""
    r = random.Random(seed)
    return [(i + 1000 * k, name, "raw", k + 1, json.dumps(make(r)), "clash") for k, make in enumerate(files) for i in range(n)]


base = lambda r: {"timestamp": 1454000000000 + r.randrange(10**6), "price": round(2300 + r.random(), 4), "quantity": round(r.lognormvariate(0, 1), 5), "side": r.choice(["buy", "sell"])}


def changed(**names):
    def make(r):
        b = base(r)
        return {names.get(k, k): v for k, v in b.items() if names.get(k, k)}

    return make


BASE = {"price": ("double", ["price"]), "quantity": ("double", ["quantity"]), "side": ("string", ["side"]), "flow_price": ("double", ["flow.price"]), "ts": ("bigint", ["ts"])}


def profiled(df, base=BASE):
    typed = ingest(df, "payload", base)
    return typed, record_profile(typed, base)


def changes(spark, rows, base=BASE):
    return {tuple(x) for x in schema_changes(profiled(spark.createDataFrame(rows, SCHEMA), base)[1]).collect()}


def test_rename_add_remove_retype(spark):
    def typed(r):
        b = changed(quantity="qty")(r)
        b["price"] = str(b["price"])
        b["latency"] = r.randrange(5, 200)
        return b

    rows = feed("f", [base, changed(quantity="qty"), typed, lambda r: {k: v for k, v in typed(r).items() if k != "side"} | {"spread": round(r.random(), 4)}])
    assert changes(spark, rows) == {
        ("f", 2, "renamed", "quantity", "qty"), ("f", 3, "retyped", "price", "price"), ("f", 3, "added", "", "latency"), ("f", 4, "removed", "side", ""), ("f", 4, "added", "", "spread"),
    }


def test_nested_and_parent_rename(spark):
    a = lambda r: {"ts": 1454000000000, "flow": {"price": round(50 + r.random(), 4), "delta": round(r.gauss(0, 2), 5)}}
    b = lambda r: {"ts": 1454000000000, "f": {"px": round(50 + r.random(), 4), "delta": round(r.gauss(0, 2), 5)}}
    c = lambda r: {"ts": 1454000000000.0, "f": [50.1, 1.0]}
    assert changes(spark, feed("g", [a, b, c])) == {("g", 2, "renamed", "flow", "f"), ("g", 2, "renamed", "flow.price", "f.px"), ("g", 3, "retyped", "f", "f"), ("g", 3, "retyped", "ts", "ts")}


def test_names_side_by_side_are_two_quantities(spark):
    both = lambda r: base(r) | {"bid": round(2300 + r.random(), 4)}
    rows = feed("a", [both, both]) + feed("b", [base, changed(price="bid")], seed=2)
    assert changes(spark, rows) == {("b", 2, "removed", "price", ""), ("b", 2, "added", "", "bid")}


def test_odd_payloads_and_empty(spark):
    rows = [(1, "f", "raw", 1, None, ""), (2, "f", "raw", 1, "[1]", ""), (3, "f", "raw", 1, "{broken", ""), (4, "f", "raw", 2, '{"a":null,"b":5.0}', ""), (5, "f", "raw", None, '{"z":1}', ""), (6, None, "raw", 1, '{"a":1}', "")]
    assert changes(spark, rows) == {("f", 2, "added", "", "b")}
    assert changes(spark, []) == set()


def test_the_report_does_not_depend_on_what_was_typed(spark):
    rows = feed("f", [base, changed(quantity="qty"), lambda r: base(r) | {"price": str(base(r)["price"]), "side": None}])
    assert changes(spark, rows) == changes(spark, rows, {"x": ("string", ["none"])}) == {("f", 2, "renamed", "quantity", "qty"), ("f", 3, "renamed", "qty", "quantity"), ("f", 3, "retyped", "price", "price"), ("f", 3, "removed", "side", "")}


def test_rescue_promote_replay(spark):
    """Promotion reads typed columns and ``_rescued`` only; a chain of renames is followed."""
    rows = feed("f", [base, changed(quantity="qty"), changed(quantity="amount"), lambda r: base(r) | {"side": {"value": "buy"}, "note": "x"}])
    typed, profile = profiled(spark.createDataFrame(rows, SCHEMA))
    typed = typed.drop("payload")
    assert typed.filter("file_no = 2 and quantity is null and _rescued like '%qty%'").count() == 20
    done = consistent_records(typed, BASE, profile, schema_changes(profile), {"price": ("double", ["price"]), "quantity": ("double", ["quantity"]), "side": ("string", ["side"])})
    assert done.filter("quantity is null or side is null or price is null or _rescued is not null").count() == 0
    assert done.filter("file_no = 4 and note = 'x'").count() == 20
    assert not {"qty", "amount"} & set(done.columns)


def test_a_rename_says_nothing_about_another_kind(spark):
    """px goes on as p in one kind; in another p is something else and stays a column of its own."""
    deals = feed("f", [lambda r: {"px": round(2300 + r.random(), 4)}, lambda r: {"p": round(2300 + r.random(), 4)}])
    others = [(i + 10**6, f, "other", n, p, c) for i, f, _, n, p, c in feed("g", [lambda r: {"px": round(2300 + r.random(), 4)}, lambda r: {"z": 1}, lambda r: {"p": r.choice(["open", "shut"])}])]
    typed, profile = profiled(spark.createDataFrame(deals + others, SCHEMA))
    done = consistent_records(typed, BASE, profile, schema_changes(profile), {"price": ("double", ["px"])})
    assert done.filter("feed = 'f' and price is null").count() == 0
    assert done.filter("feed = 'g' and file_no = 3 and price is null and p in ('open', 'shut')").count() == 20


def test_names():
    assert name_likeness("Price", "price") == name_likeness("agg_trade_id", "aggTradeId") == 1.0
    assert name_likeness("buy_volume", "bv") > name_likeness("buy_volume", "sv")


def test_a_column_per_quantity(spark):
    def flow(pressure, text=False):
        def make(r):
            inner = {"price": round(50 + r.random(), 4), "delta": round(r.gauss(0, 2), 5), pressure: round(r.uniform(-1, 1), 6)}
            return {"ts": 1454000000000 + r.randrange(10**6), "flow": json.dumps(inner) if text else inner}

        return make

    fee = lambda name: lambda r: base(r) | {name: round(0.1 + r.random(), 5), "tags": ["a", "b"]}
    flows = [(i + 10**6, f, "flow", n, p, c) for i, f, _, n, p, c in feed("f", [flow("pressure"), flow("pr"), flow("pr", text=True)])]
    df = spark.createDataFrame(flows + feed("r", [fee("fee"), fee("commission")]), SCHEMA)
    typed, profile = profiled(df)
    target = {"price": ("double", ["price", "flow.price"]), "delta": ("double", ["flow.delta"])}
    done = consistent_records(typed, BASE, profile, schema_changes(profile), target)
    assert {"flow_pressure", "fee", "tags", "side", "quantity"} <= set(done.columns) and not {"commission", "flow_pr", "pr"} & set(done.columns)
    assert dict(done.dtypes)["tags"] == "array<string>" and dict(done.dtypes)["timestamp"] == "bigint"
    assert done.filter("price is null").count() == 0
    assert done.filter("feed = 'f' and (delta is null or flow_pressure is null or ts is null)").count() == 0
    assert done.filter("feed = 'r' and (fee is null or size(tags) <> 2 or side is null or _rescued is not null)").count() == 0


LOAD = {"price": ("double", ["price", "px"]), "n": ("bigint", ["n"]), "tags": ("array<string>", ["tags"])}


def test_what_no_column_took_is_rescued(spark):
    """(payload, values of the columns, what stays rescued): nothing is lost."""
    cases = [
        ('{"price":[1.5,2.5]}', (None, None, None), {"price": [1.5, 2.5]}), ('{"price":{"value":1.5,"unit":"usd"}}', (None, None, None), {"price": {"value": 1.5, "unit": "usd"}}),
        ('{"price":1.5,"px":2.5}', (1.5, None, None), {"px": 2.5}), ('{"price":[1.5]}', (1.5, None, None), None), ('{"price":{"value":"1.5"}}', (1.5, None, None), None), ('{"price":null,"px":1}', (1.0, None, None), None),
        ('{"n":7.0000001}', (None, None, None), {"n": 7.0000001}), ('{"n":"7.0"}', (None, 7, None), None), ('{"n":9223372036854775807}', (None, 2**63 - 1, None), None), ('{"n":9223372036854775808}', (None, None, None), {"n": 2**63}),
        ('{"price":0.12345678901234567891}', (None, None, None), "0.12345678901234567891"), ('{"tags":["a",1]}', (None, None, ["a", "1"]), None), ('{"tags":"a|b"}', (None, None, ["a", "b"]), None), ('{"tags":[["a"]]}', (None, None, None), {"tags": [["a"]]}),
        ('{"price":1.5,"price":2.5}', (None, None, None), '"{'), ("[1]", (None, None, None), '"[1]"'), (None, (None, None, None), None),
        ('{"a":' + "[" * 200_000, (None, None, None), '"{'), ('{"a":' + "[" * 3000 + "]" * 3000 + "}", (None, None, None), "[[["),
    ]
    df = spark.createDataFrame([(i, "f", "raw", 1, p, "") for i, (p, _, _) in enumerate(cases)], SCHEMA)
    single = {"price": ("double", ["price"]), "n": ("bigint", ["n"])}
    got = replay(ingest(df, "payload", single).drop("payload"), single, LOAD).orderBy("record_id").collect()
    for (payload, values, rest), row in zip(cases, got):
        assert (row["price"], row["n"], row["tags"]) == values, payload
        if isinstance(rest, str):
            assert rest in row["_rescued"]
        else:
            assert (row["_rescued"] and json.loads(row["_rescued"])) == rest, payload


def leaves(v):
    if isinstance(v, dict):
        return [x for w in v.values() for x in leaves(w)]
    return [x for w in v for x in leaves(w)] if isinstance(v, list) else [] if v is None else [str(v)]


def test_every_value_is_kept(spark, sf):
    """Values in = typed values + rescued values, over all records of the smallest table."""
    from tapewright.plans.quality import P6_SCHEMA

    df = spark.read.parquet(f"{sf}/drift_records.parquet")
    typed = ingest(df, "payload", P6_SCHEMA)
    for r in typed.collect():
        record = read_object(r["payload"])
        typed_ = [r[c] for c in P6_SCHEMA if r[c] is not None]
        assert len(leaves(record)) == len(typed_) + len(leaves(read_object(r["_rescued"]) or {}))
        assert json.loads(dump(record)) == json.loads(r["payload"])


@pytest.mark.parametrize("v, type_, strict, lenient", [(True, "bigint", None, None), ("true", "boolean", None, True), (" 2 ", "double", None, 2.0), ("nan", "double", None, None), ("x", "string", "x", "x"), ({"value": [1.5]}, "double", None, 1.5)])
def test_loading(v, type_, strict, lenient):
    assert load_strict(v, type_) == strict and load_lenient(v, type_) == lenient


def test_empty_table(spark):
    typed, profile = profiled(spark.createDataFrame([], SCHEMA))
    assert typed.count() == 0 and profile.count() == 0
    done = consistent_records(typed, BASE, profile, schema_changes(profile), {"price": ("double", ["price"])})
    assert done.count() == 0 and "price" in done.columns
    assert done.filter(F.col("_rescued").isNotNull()).count() == 0
