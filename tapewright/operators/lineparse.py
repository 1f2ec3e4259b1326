"""Rows that fail to parse: load the valid ones, set the others apart with the reason.

Method: minimum-cost error parse. A dynamic program finds the cheapest edits (insert or delete a quote, insert or
delete a delimiter) that turn a line into a well-formed record. A
line of cost zero whose values have their types loads; the edits of any other line state the
reason.

Delimited lines: cost is (edits that mend quoting, edits that change the number of fields), compared in this
order: so a line whose quoting is sound is never blamed on its quotes, however many fields it has,
and a line whose quoting is broken always is. The program runs over classes (quote, delimiter, run of other characters), not
characters: its length is that of a line's structure, and lines of one structure share one run.

JSON lines: the same over quotes, commas, colons, brackets and values, with the open brackets as part of the state. A line costs zero if and only if it
is one JSON object. As most lines are, a JSON reader recognizes those of cost zero and gives their values; the program judges every line
that the reader refuses, nested to any depth.
"""

from __future__ import annotations

import itertools
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns

CSV_COLUMNS = ("timestamp", "price", "quantity", "side", "note")

# States between classes: at the start of a field, in an unquoted one, in a quoted one, after its closing quote.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)

_CLASSES = re.compile(r'[^",]+')
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def structure(line: str) -> str:
    """The line's classes: '"' and ',' as they are, 'x' for a run of anything else."""
    return _CLASSES.sub("x", line)


def _moves(state: int, symbol: str) -> list[tuple[int, int, tuple[int, int], str | None]]:
    """Ways to read one class: (state after, fields begun, cost, edit)."""
    free, quote, delim = (0, 0), (1, 0), (0, 1)
    if symbol == ",":
        if state == _QUOTED:
            return [(_QUOTED, 0, free, None)]
        return [(_START, 1, free, None), (state, 0, delim, "delete_delimiter")]
    if symbol == '"':
        if state == _START:
            return [(_QUOTED, 0, free, None), (_PLAIN, 0, quote, "delete_quote")]
        if state == _PLAIN:  # a quote inside an unquoted field: drop it, or begin a field before it
            return [(_PLAIN, 0, quote, "delete_quote"), (_QUOTED, 1, quote, "insert_delimiter_at_quote")]
        if state == _QUOTED:  # the closing quote, or the first of a pair
            return [(_CLOSED, 0, free, None), (_QUOTED, 0, quote, "delete_quote"), (_QUOTED, 0, quote, "insert_quote")]
        return [(_QUOTED, 0, free, None)]  # the second of a pair
    if state in (_START, _PLAIN):
        return [(_PLAIN, 0, free, None)]
    if state == _QUOTED:
        return [(_QUOTED, 0, free, None)]
    # Text after a closing quote: begin a field before it, or double the quote.
    return [(_PLAIN, 1, quote, "insert_delimiter_at_quote"), (_QUOTED, 0, quote, "insert_quote")]


_MOVES = {(s, c): _moves(s, c) for s in range(4) for c in '",x'}


def min_cost_parse(classes: str, columns: int = 5) -> tuple[int, int, list[str]]:
    """(edits of quotes, edits of delimiters, the edits in order) of the cheapest reading as ``columns`` fields.

    Fields missing at the end are inserted delimiters. Exact: every state and number of fields is kept. Ties go
    to the edit listed first.
    """
    # best[(state, fields)] = (quotes, delimiters, chain of edits)
    best: dict[tuple[int, int], tuple] = {(_START, 1): (0, 0, None)}
    for symbol in classes:
        after: dict[tuple[int, int], tuple] = {}
        for (state, fields), (q, d, chain) in best.items():
            for to, begun, (cq, cd), edit in _MOVES[state, symbol]:
                n = fields + begun
                cost = (q + cq, d + cd)
                if n > columns:
                    # A surplus field is merged into the last one by deleting its delimiter, whatever its quoting.
                    n, cost, edit = columns, (cost[0], cost[1] + 1), edit or "delete_delimiter"
                key = (to, n)
                old = after.get(key)
                if old is None or cost < (old[0], old[1]):
                    after[key] = (*cost, (chain, edit) if edit else chain)
        best = after
    final = None
    for (state, fields), (q, d, chain) in best.items():
        if state == _QUOTED:  # a quote left open
            q, chain = q + 1, (chain, "insert_quote")
        d += columns - fields
        for _ in range(columns - fields):
            chain = (chain, "insert_delimiter")
        if final is None or (q, d) < (final[0], final[1]):
            final = (q, d, chain)
    q, d, chain = final
    edits = []
    while chain:
        chain, edit = chain
        edits.append(edit)
    return q, d, edits[::-1]


def split_fields(line: str) -> list[str]:
    """Fields of a line of cost zero."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j = i + 1
            while True:
                j = line.index('"', j)
                if j + 1 < n and line[j + 1] == '"':
                    j += 2
                    continue
                break
            out.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


class _Number(str):
    """A JSON number, as written."""


def _reject(_: str):
    raise ValueError("no JSON")


_BLANK = " \t\n\r"


def json_reader() -> json.JSONDecoder:
    """A strict reader that keeps numbers as written."""
    return json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_reject, strict=True)


#: Classes of a JSON line: brackets, ',', ':' and '"' as they are; e: escape; b: backslash that begins none; t: tab or line end; c: other control character; n: number, true, false or null; x: other text.
_JSON_CLASSES = re.compile(r'''(?P<p>[{}\[\]:,"])|(?P<e>\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|(?P<b>\\)|(?P<t>[\t\n\r]+)|(?P<s>[ ]+)|(?P<c>[\x00-\x1f]+)|(?P<x>[^{}\[\]:,"\\\x00-\x20]+)''')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def json_structure(line: str) -> str:
    """The line's classes; blanks are left out."""
    out = []
    for m in _JSON_CLASSES.finditer(line):
        kind = m.lastgroup
        if kind == "p":
            out.append(m.group())
        elif kind == "x":
            out.append("n" if _SCALAR.fullmatch(m.group()) else "x")
        elif kind != "s":
            out.append(kind)
    return "".join(out)


# States of a JSON line, by what may come next: the object, a first key or its end, a key, a colon, a value, a first value or the list's end, a comma or an end, nothing.
_OBJECT, _FIRST_KEY, _KEY, _COLON, _VALUE, _FIRST_VALUE, _NEXT, _END = range(8)
#: While a string is open its state is that of what follows it, plus this.
_STRING = 8
#: Readings that cost this much more than the cheapest so far are given up. It bounds the work for a class of a line; a reading of cost zero is never given up.
_SLACK = 3


class _Stacks:
    """Open brackets as numbers, 0 being none: equal stacks have one number, whatever their depth."""

    def __init__(self) -> None:
        self.top, self.rest, self.depth, self.known = [""], [0], [0], {}

    def push(self, bracket: str, stack: int) -> int:
        found = self.known.get((bracket, stack))
        if found is None:
            found = self.known[bracket, stack] = len(self.top)
            self.top.append(bracket)
            self.rest.append(stack)
            self.depth.append(self.depth[stack] + 1)
        return found


def _json_read(s: _Stacks, state: int, stack: int, symbol: str) -> tuple[int, int] | None:
    """The state and open brackets after reading ``symbol`` without an edit, or None."""
    if state >= _STRING:
        if symbol == '"':
            return state - _STRING, stack
        return None if symbol in "btc" else (state, stack)
    if symbol == "t":
        return state, stack
    if symbol == '"':
        if state in (_FIRST_KEY, _KEY):
            return _COLON + _STRING, stack
        return (_NEXT + _STRING, stack) if state in (_VALUE, _FIRST_VALUE) else None
    if symbol == "n":
        return (_NEXT, stack) if state in (_VALUE, _FIRST_VALUE) else None
    if symbol == "{":
        return (_FIRST_KEY, s.push("{", stack)) if state in (_OBJECT, _VALUE, _FIRST_VALUE) else None
    if symbol == "[":
        return (_FIRST_VALUE, s.push("[", stack)) if state in (_VALUE, _FIRST_VALUE) else None
    if symbol == ":":
        return (_VALUE, stack) if state == _COLON else None
    if symbol == "," and state == _NEXT:
        return _KEY if s.top[stack] == "{" else _VALUE, stack
    if symbol in "}]":
        return _json_close(s, state, stack, "{" if symbol == "}" else "[")
    return None


def _json_close(s: _Stacks, state: int, stack: int, bracket: str) -> tuple[int, int] | None:
    if s.top[stack] != bracket or state not in (_NEXT, _FIRST_KEY if bracket == "{" else _FIRST_VALUE):
        return None
    return (_NEXT if s.rest[stack] else _END), s.rest[stack]


def _json_inserts(s: _Stacks, state: int, stack: int) -> list[tuple[int, int, str]]:
    """(state, stack, edit) after each edit that reads nothing; the last one leads to the object's end."""
    if state >= _STRING:
        return [(state - _STRING, stack, "insert_quote")]
    if state == _OBJECT:
        return [(_FIRST_KEY, s.push("{", stack), "insert_brace")]
    out = []
    if state in (_FIRST_KEY, _KEY):
        out.append((_COLON + _STRING, stack, "insert_quote"))
    if state in (_VALUE, _FIRST_VALUE):
        out += [(_NEXT + _STRING, stack, "insert_quote"), (_NEXT, stack, "insert_value")]
    if state == _COLON:
        out.append((_VALUE, stack, "insert_colon"))
    if state == _NEXT:
        out.append((_KEY if s.top[stack] == "{" else _VALUE, stack, "insert_comma"))
    closed = _json_close(s, state, stack, s.top[stack]) if stack else None
    if closed:
        out.append((*closed, _CLOSE[s.top[stack]]))
    return out


_CLOSE = {"{": "insert_brace", "[": "insert_bracket"}
_JSON_NAMES = {"{": "brace", "}": "brace", "[": "bracket", "]": "bracket", ",": "comma", ":": "colon", '"': "quote", "n": "value", "e": "escape", "b": "backslash", "c": "control", "t": "control"}


def _offer(into: dict, key: tuple[int, int], cost: int, chain) -> None:
    old = into.get(key)
    if old is None or cost < old[0]:
        into[key] = (cost, chain)


def _widen(s: _Stacks, now: dict) -> dict:
    """All inserts from here, cheapest first, and only what is within the slack."""
    least = min(c for c, _ in now.values())
    for cost in range(least, least + _SLACK):
        for (state, stack), (_, chain) in [x for x in now.items() if x[1][0] == cost]:
            for to, rest, edit in _json_inserts(s, state, stack):
                _offer(now, (to, rest), cost + 1, (chain, edit))
    return {k: v for k, v in now.items() if v[0] <= least + _SLACK}


def min_cost_json(classes: str) -> tuple[int, list[str]]:
    """(number of edits, the edits in order) of the cheapest reading as one object. 0 if and only if the classes are those of an object.

    The line is read without an edit as far as it goes; the program starts up to 64 classes before the place where it breaks, as the edit may lie there. It keeps every
    reading within ``_SLACK`` edits of the cheapest at its place.
    """
    s = _Stacks()
    at, done = (_OBJECT, 0), len(classes)
    for i, symbol in enumerate(classes):
        after = _json_read(s, *at, symbol)
        if after is None:
            done = i
            break
        at = after
    if at == (_END, 0) and done == len(classes):
        return 0, []
    start, at = max(done - 64, 0), (_OBJECT, 0)
    for symbol in classes[:start]:
        at = _json_read(s, *at, symbol)
    # best[(state, stack)] = (cost, chain of edits)
    best: dict = {at: (0, None)}
    for symbol in classes[start:]:
        after: dict = {}
        for (state, stack), (cost, chain) in _widen(s, best).items():
            read = _json_read(s, state, stack, symbol)
            if read is not None:
                _offer(after, read, cost, chain)
            if read is None or symbol != "t":
                _offer(after, (state, stack), cost + 1, (chain, f"delete_{_JSON_NAMES.get(symbol, 'text')}"))
        best = after
    # What is open at the end is completed, then closed bracket by bracket.
    ends = []
    for (state, stack), (cost, chain) in _widen(s, best).items():
        while state not in (_NEXT, _END):
            state, stack, edit = _json_inserts(s, state, stack)[-1]
            cost, chain = cost + 1, (chain, edit)
        ends.append((cost + s.depth[stack], len(ends), stack, chain))
    cost, _, stack, chain = min(ends, key=lambda x: x[:2])
    while stack:
        chain, stack = (chain, _CLOSE[s.top[stack]]), s.rest[stack]
    edits = []
    while chain:
        chain, edit = chain
        edits.append(edit)
    return cost, edits[::-1]


def stated(edits: list[str]) -> str:
    """All edits in order, repeats of one as 'edit*count'."""
    return ",".join(e if n == 1 else f"{e}*{n}" for e, n in ((e, len(list(g))) for e, g in itertools.groupby(edits)))


_TOKENS = re.compile(r'''"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+''')


def _outline(text: str, reader: json.JSONDecoder) -> dict:
    """The object's fields down to the second level, deeper values as an empty list: for objects nested beyond the reader, without recursion."""
    depth, top, inner, key, names = 0, {}, None, None, [None, None, None]
    for m in _TOKENS.finditer(text):
        t = m.group()
        if t in "{[":
            depth += 1
            if depth == 2:
                inner = {} if t == "{" else []
                top[names[1]] = inner
            elif depth == 3 and isinstance(inner, dict):
                inner[names[2]] = []
            expect_key, opened = t == "{", t
            key = expect_key
        elif t in "}]":
            depth -= 1
            key = False
        elif t == ",":
            key = depth == 1 or (depth == 2 and isinstance(inner, dict))
        elif t == ":":
            key = False
        elif key and depth <= 2:
            names[depth] = reader.decode(t)
        elif depth == 1:
            top[names[1]] = reader.decode(t)
        elif depth == 2 and isinstance(inner, dict):
            inner[names[2]] = reader.decode(t)
    return top


def _read_object(text: str, reader: json.JSONDecoder, cache: dict | None = None) -> tuple[dict | None, list[str]]:
    """(the object, no edits), or (None, the edits that would make one)."""
    body = text.strip(_BLANK)
    try:
        value, end = reader.raw_decode(body)
        if end == len(body) and isinstance(value, dict):
            return value, []
    except (ValueError, RecursionError):
        pass
    classes = json_structure(body)
    found = cache.get(("json", classes)) if cache is not None else None
    if found is None:
        found = min_cost_json(classes)
        if cache is not None and len(cache) < 10_000 and len(classes) < 10_000:
            cache["json", classes] = found
    return (None, found[1]) if found[0] else (_outline(body, reader), [])


def _decimal(v) -> Decimal | None:
    """A plain ASCII decimal, as a JSON number or as text."""
    if not isinstance(v, str):
        return None
    text = v.strip()
    if not _NUMBER.fullmatch(text):
        return None
    mantissa, _, exponent = text.lower().partition("e")
    if len(exponent.lstrip("+-")) > 6:  # beyond any double: 0 or too large, by the sign of the exponent
        exponent = "-999999" if exponent.startswith("-") else "999999"
        text = f"{mantissa}e{exponent}"
    return Decimal(text)


def _timestamp(v) -> int | None:
    x = _decimal(v)
    if x is None or x <= 0 or x.adjusted() > 19 or x != x.to_integral_value():
        return None
    return int(x) if x < 2**63 else None


def _side(v) -> str | None:
    side = v.strip().lower() if isinstance(v, str) and not isinstance(v, _Number) else None
    return side if side in ("buy", "sell") else None


def _typed(names: tuple[str, ...], ts, price, quantity, side=None) -> tuple[str | None, str | None, tuple | None]:
    """(reason, edit, None) or (None, None, record); ``names`` are the fields' own. Without a side, quantity is a delta, which has a sign and gives the side."""
    signed = len(names) == 3
    t = _timestamp(ts)
    if t is None:
        return "bad_ts", f"replace_value:{names[0]}", None
    p = _decimal(price)
    if p is None or p <= 0:
        return "bad_price", f"replace_value:{names[1]}", None
    q = _decimal(quantity)
    if q is None or (q == 0 if signed else q <= 0):
        return "bad_quantity", f"replace_value:{names[2]}", None
    s = ("buy" if q > 0 else "sell") if signed else _side(side)
    if s is None:
        return "bad_side", f"replace_value:{names[3]}", None
    return None, None, (t, float(p), float(abs(q)), s)


_TRADE, _FLOW = ("timestamp", "price", "quantity", "side"), ("ts", "flow.price", "flow.delta")


def parse_line(line_format: str | None, text: str | None, cache: dict | None = None, reader: json.JSONDecoder | None = None) -> tuple[str | None, str | None, tuple | None]:
    """(reason, detail, record): reason is None for a line that loads; detail names all edits that would make it load, in order.

    Null and blank text is 'empty'; a line of an unknown format is 'malformed'.
    """
    if text is None or not text.strip():
        return "empty", None, None
    if line_format == "trade_csv":
        classes = structure(text)
        if cache is None or classes not in cache:
            q, d, edits = min_cost_parse(classes, len(CSV_COLUMNS))
            reason = "malformed" if q else "column_count" if d else None
            found = (reason, stated(edits) or None)
            if cache is not None and len(cache) < 10_000 and len(classes) < 10_000:
                cache[classes] = found
        else:
            found = cache[classes]
        if found[0]:
            return (*found, None)
        ts, price, quantity, side, _ = split_fields(text)
        return _typed(_TRADE, ts, price, quantity, side)
    if line_format not in ("trade_jsonl", "flow_jsonl"):
        return "malformed", "unknown format", None
    value, edits = _read_object(text, reader or json_reader(), cache)
    if value is None:
        return "malformed", stated(edits), None
    if line_format == "flow_jsonl":
        flow = value.get("flow")
        inside = flow if isinstance(flow, dict) else {}
        names, values = _FLOW, (value.get("ts"), inside.get("price"), inside.get("delta"))
    else:
        names, values = _TRADE, tuple(map(value.get, _TRADE))
    missing = [f"insert_field:{n}" for n, v in zip(names, values) if v is None]
    if missing:
        return "missing_field", ",".join(missing), None
    return _typed(names, *values)


_OUT = "_id long, reason string, detail string, timestamp long, price double, quantity double, side string, reconstructed boolean"


def parse_lines(df: DataFrame, line_id: str = "line_id", line_format: str = "line_format", line_text: str = "line_text") -> DataFrame:
    """Every line with its outcome: ``line_id``, ``reason`` (null: it loads), ``detail``, ``timestamp``, ``price``, ``quantity``, ``side``, ``reconstructed``.

    Narrow: no shuffle, one Arrow batch at a time, so any file and any line may be of any size an Arrow batch holds.
    Defined results: null, empty and blank text is 'empty'; repeated lines each have their row; an empty table
    gives none; other columns are ignored. A price beyond a double loads as infinite or 0.
    """
    require_columns(df, [line_id, line_format, line_text])

    def run(batches):
        cache: dict = {}
        reader = json_reader()
        for pdf in batches:
            rows = []
            for i, f, t in zip(pdf["_id"], pdf["_format"], pdf["_text"]):
                reason, detail, record = parse_line(f, t, cache, reader)
                rows.append((i, reason, detail, *(record or (None,) * 4), None if record is None else f == "flow_jsonl"))
            out = pd.DataFrame(rows, columns=["_id", "reason", "detail", "timestamp", "price", "quantity", "side", "reconstructed"], dtype=object)
            yield out.astype({"timestamp": "Int64", "price": "float64", "quantity": "float64"})

    src = df.select(F.col(line_id).cast("long").alias("_id"), F.col(line_format).alias("_format"), F.col(line_text).alias("_text"))
    return src.mapInPandas(run, _OUT).withColumnRenamed("_id", "line_id")


def split_lines(df: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(loaded records, rejected lines with reason and edits) of ``parse_lines``."""
    all_lines = parse_lines(df, **names)
    loaded = all_lines.filter(F.col("reason").isNull()).drop("reason", "detail")
    return loaded, all_lines.filter(F.col("reason").isNotNull()).select("line_id", "reason", "detail")
