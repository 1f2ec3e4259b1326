import csv
import io
import itertools
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.operators.lineparse import json_structure, min_cost_json, min_cost_parse, parse_line, parse_lines, split_fields, structure


def states(classes):
    """Well-formed or not, and number of fields: by the plain grammar."""
    state, fields = "start", 1
    for c in classes:
        if c == ",":
            if state == "quoted":
                continue
            state, fields = "start", fields + 1
        elif c == '"':
            if state == "plain":
                return None
            state = {"start": "quoted", "quoted": "closed", "closed": "quoted"}[state]
        else:
            if state == "closed":
                return None
            state = "plain" if state in ("start", "plain") else state
    return None if state == "quoted" else fields


def test_reason_is_exact_for_all_short_structures():
    for n in range(0, 9):
        for t in itertools.product('",x', repeat=n):
            s = "".join(t)
            if "xx" in s:
                continue
            q, d, edits = min_cost_parse(s)
            fields = states(s)
            assert (q > 0) == (fields is None), s
            if fields is not None:
                assert d == abs(fields - 5) and len(edits) == d, s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",;\n x', max_size=6), min_size=5, max_size=5))
def test_round_trip(fields):
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="").writerow(fields)
    line = buffer.getvalue()
    q, d, _ = min_cost_parse(structure(line))
    assert (q, d) == (0, 0)
    assert split_fields(line) == fields


CASES = [
    ("trade_csv", None, "empty"), ("trade_csv", " \t", "empty"), ("trade_csv", '1,2,3,buy,"a', "malformed"), ("trade_csv", '1,2,3,b"buy",', "malformed"), ("trade_csv", '1,2,3,"buy" ,', "malformed"),
    ("trade_csv", "1,2,3,buy", "column_count"), ("trade_csv", "a,\"b\",c,\"d\",e,\"f\"", "column_count"), ("trade_csv", ",,,,", "bad_ts"), ("trade_csv", "1700000000000.0,+1.5e3, 2 ,BUY,", None),
    ("trade_csv", "1.5,1,1,buy,", "bad_ts"), ("trade_csv", "9223372036854775808,1,1,buy,", "bad_ts"), ("trade_csv", "9223372036854775807,1,1,buy,", None), ("trade_csv", "1,-0.0,1,buy,", "bad_price"), ("trade_csv", "1,1,１２.5,buy,", "bad_quantity"),
    ("trade_csv", "1,1,inf,buy,", "bad_quantity"), ("trade_csv", '"1","1","1","sell","say ""x"", y"', None), ("trade_csv", "1,1,1,byu,", "bad_side"), ("trade_csv", "1,1e-999999999,1,buy,", None),
    ("trade_jsonl", "[1]", "malformed"), ("trade_jsonl", '{"timestamp":1}{"a":2}', "malformed"), ("trade_jsonl", '{"timestamp":NaN,"price":1,"quantity":1,"side":"buy"}', "malformed"), ("trade_jsonl", '{"timestamp":1,"price":1,"quantity":1}', "missing_field"),
    ("trade_jsonl", '{"timestamp":1,"price":true,"quantity":1,"side":"buy"}', "bad_price"), ("trade_jsonl", '{"timestamp":"1","price":" 2 ","quantity":"3","side":"Sell"}\r', None), ("trade_jsonl", '{"timestamp":1,"price":1,"quantity":1,"side":1}', "bad_side"),
    ("flow_jsonl", '{"ts":1,"flow":[1]}', "missing_field"), ("flow_jsonl", '{"ts":1,"flow":{"price":1,"delta":-0.0}}', "bad_quantity"), ("flow_jsonl", '{"ts":1,"flow":{"price":1,"delta":-2}}', None), ("flow_jsonl", '{"ts":1,"flow":{"price":1,"delta":' + "[" * 100_000, "malformed"),
    ("other", "x", "malformed"),
]


def test_reasons():
    for f, t, reason in CASES:
        assert parse_line(f, t)[0] == reason, (f, t)
    assert parse_line("flow_jsonl", '{"ts":1,"flow":{"price":1,"delta":-2}}')[2] == (1, 1.0, 2.0, "sell")


def is_object(text):
    try:
        return isinstance(json.loads(text, parse_constant=lambda _: 1 / 0), dict)
    except (ValueError, ZeroDivisionError):
        return False


def test_json_costs_nothing_only_for_objects():
    """All texts of up to 5 symbols of a small alphabet."""
    for n in range(0, 6):
        for t in itertools.product('{}]",:1' if n == 5 else '{}[]",:1', repeat=n):
            s = "".join(t)
            cost, edits = min_cost_json(json_structure(s))
            assert (cost == 0) == is_object(s) and len(edits) == cost, s


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet='a"\\\\{}[],: \n\t1', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k"\\\\:', max_size=3), x, max_size=3), max_leaves=8), st.integers(0, 10**6), st.sampled_from('{}[]",:x\\\\ 1'))
def test_json_edits(value, at, symbol):
    text = json.dumps({"a": value}, ensure_ascii=bool(at % 2))
    assert min_cost_json(json_structure(text)) == (0, [])
    k = at % len(text)
    for broken in (text[:k] + text[k + 1 :], text[:k] + symbol + text[k:]):
        cost, edits = min_cost_json(json_structure(broken))
        assert (cost == 0) == is_object(broken) and len(edits) == cost


def test_edits_are_stated_whole():
    assert parse_line("trade_csv", ",".join("x" * 60))[1] == "delete_delimiter*55"
    assert parse_line("trade_jsonl", '{"timestamp":1,"price":1,"quantity":1,"side":"buy"')[1] == "insert_brace"
    assert parse_line("trade_jsonl", '{"timestamp":1,"price":1"quantity":1,"side":"buy"}')[1] == "insert_comma"
    assert parse_line("trade_jsonl", '{"timestamp":1,"price":1,"quantity":1,"side":"buy}')[1] == "insert_quote"
    assert parse_line("trade_jsonl", '{"timestamp":1,"price":1,"quantity":1,"side":"buy"},')[1] == "delete_comma"
    assert parse_line("trade_jsonl", '{"timestamp":1}')[:2] == ("missing_field", "insert_field:price,insert_field:quantity,insert_field:side")
    assert parse_line("trade_csv", "1,-1,1,buy,")[1] == "replace_value:price"


def test_deep_nesting_loads():
    deep = "[" * 200_000 + "]" * 200_000
    for body in (f'{{"a":{deep},"timestamp":1,"price":2,"quantity":3,"side":"buy"}}', f'{{"timestamp":1,"price":2,"quantity":3,"b":{{"side":{deep}}},"side":"buy"}}'):
        assert parse_line("trade_jsonl", body) == (None, None, (1, 2.0, 3.0, "buy"))
    assert parse_line("flow_jsonl", f'{{"ts":1,"flow":{{"x":{deep},"price":2,"delta":-3,"y":{{"price":9}}}}}}') == (None, None, (1, 2.0, 3.0, "sell"))
    assert parse_line("flow_jsonl", f'{{"ts":1,"flow":{{"price":2,"delta":{deep}}}}}')[0] == "bad_quantity"


def test_long_lines():
    assert parse_line("trade_csv", "1,1,1,buy," + "x" * 2_000_000)[0] is None
    assert parse_line("trade_csv", "1,1,1,buy," + '"' * 20_001)[0] == "malformed"
    assert parse_line("trade_jsonl", json.dumps({"timestamp": 1, "price": 1, "quantity": 1, "side": "buy", "note": "y" * 2_000_000}))[0] is None


def test_frame(spark):
    df = spark.createDataFrame([(i, f, t, "clash") for i, (f, t, _) in enumerate(CASES)] + [(0, *CASES[0][:2], "clash")], "line_id long, line_format string, line_text string, reason string")
    got = [(r["line_id"], r["reason"]) for r in parse_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(i, c[2]) for i, c in enumerate(CASES)] + [(0, "empty")], key=str)
    assert parse_lines(df.limit(0)).count() == 0
