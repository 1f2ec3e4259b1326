"""Schemas that drift between files: one consistent table of all records, and a report of each change.

Method: rescue-column ingestion. ``ingest`` enforces a target schema record by record: a field of the schema whose value has
exactly the schema's JSON type becomes a typed column, everything else (unknown fields, values of another type) is kept
as JSON in a rescue column. From there on the payload isn't read again. The report profiles the typed columns and the rescued
fields; approved fields are promoted by ``replay``, which moves rescued values into typed columns and leaves in the rescue column
only what no column took. No value is lost on the way: each is in a typed column or in ``_rescued``.

Records are taken apart in Arrow batches: a JSON reader that keeps numbers as written is cheaper here than VARIANT
expressions (a tenth of the CPU time, measured). Statistics are summed per file and field inside each task.

Each file is compared with the previous one of its feed. A field that
vanishes and one that appears together are the same quantity under another name if no file of the kind ever
holds both names and their values go on alike (magnitude, spread, sign, precision, words);
the spelling of the names decides between several candidates.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from json.encoder import encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tapewright.functions.common import materialize, require_columns

_TOKEN = re.compile(r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?|[^\W\d]\w*")
_KEYS = re.compile(r'"(?:[^"\\]|\\.)*"\s*:')
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,6})?")

#: Least likeness of the values of two names of one quantity.
MIN_LIKENESS = 0.2
#: Files and fields whose statistics a task sums before it passes them on.
FLUSH = 20_000

_STATS = ["n", "n_text", "n_bool", "n_list", "n_obj", "n_num", "n_dec", "tokens", "numbers", "m1", "m2", "neg", "zero", "places", "lo_word", "hi_word"]

#: {column: (SQL type, paths)}. A path is a field or 'parent.field', or (path, kinds) if it holds only in records of these kinds.
Target = dict[str, tuple[str, list]]


# -- JSON -------------------------------------------------------------------------------------------------


class Number(str):
    """A JSON number, as written."""

    __slots__ = ()


def _reject(_: str):
    raise ValueError("no JSON")


def _pairs(pairs: list) -> dict:
    d = dict(pairs)
    if len(d) != len(pairs):
        raise ValueError("a name occurs twice")
    return d


class _Reader(json.JSONDecoder):
    """Strict, numbers as written. Travels to executors by being made anew."""

    def __init__(self) -> None:
        super().__init__(parse_int=Number, parse_float=Number, parse_constant=_reject, object_pairs_hook=_pairs)

    def __reduce__(self):
        return _Reader, ()


_READER = _Reader()


def read_object(text: str | None) -> dict | None:
    """The JSON object in ``text``; None for anything else, for an object that holds a name twice, and for one nested deeper than the reader goes."""
    try:
        value = _READER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def dump(v) -> str:
    """JSON text of a value; numbers as they were written."""
    t = type(v)
    if t is Number:
        return str(v)
    if t is str:
        return encode_basestring(v)
    if t is dict:
        return "{" + ",".join(f"{encode_basestring(k)}:{dump(x)}" for k, x in v.items()) + "}"
    if t is list:
        return "[" + ",".join(map(dump, v)) + "]"
    if t is float:
        return repr(v)
    return "null" if v is None else "true" if v is True else "false" if v is False else str(v)


# -- typed columns ----------------------------------------------------------------------------------------


def _exact_double(text: str) -> float | None:
    """The number as a double if that loses no digit."""
    x = float(text)
    if math.isinf(x):
        return None
    return x if len(text) <= 16 or Decimal(repr(x)) == Decimal(text) else None


def load_strict(v, type_: str):
    """``v`` as ``type_`` if it has exactly that JSON type, else None."""
    if isinstance(v, Number):
        if type_ == "bigint" and v.lstrip("-").isdigit():
            x = int(v)
            return x if -(2**63) <= x < 2**63 and v != "-0" else None
        if type_ == "double" and not v.lstrip("-").isdigit():
            return _exact_double(v)
        return None
    if isinstance(v, bool):
        return v if type_ == "boolean" else None
    if isinstance(v, str):
        return v if type_ == "string" else None
    if isinstance(v, list) and type_ == "array<string>":
        return v if all(isinstance(x, str) and not isinstance(x, Number) for x in v) else None
    return None


def _scalar_text(v) -> str | None:
    if isinstance(v, str):
        return str(v)
    return None if v is None or isinstance(v, (dict, list)) else dump(v)


def load_lenient(v, type_: str):
    """``v`` as ``type_`` if no part of it is lost: numbers in text, a list or {"value": ...} that holds just one value, text for a list cut at '|'; else None."""
    if isinstance(v, dict):
        return load_lenient(v["value"], type_) if list(v) == ["value"] else None
    if type_ == "array<string>":
        if isinstance(v, list):
            texts = [_scalar_text(x) for x in v]
            return None if None in texts else texts
        return v.split("|") if isinstance(v, str) and not isinstance(v, Number) and not v.startswith("{") else None
    if isinstance(v, list):
        return load_lenient(v[0], type_) if len(v) == 1 and not isinstance(v[0], list) else None
    if v is None:
        return None
    if type_ == "string":
        return _scalar_text(v)
    if type_ == "boolean":
        return v if isinstance(v, bool) else {"true": True, "1": True, "false": False, "0": False}.get(v.lower()) if isinstance(v, str) else None
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        if type_ == "double":
            return float(v) if float(v) == v else None
        return int(v) if v == int(v) and -(2**63) <= v < 2**63 else None
    text = v.strip()
    if not _DECIMAL.fullmatch(text):
        return None
    if type_ == "double":
        return _exact_double(text)
    d = Decimal(text)
    return int(d) if d.adjusted() < 20 and d == d.to_integral_value() and -(2**63) <= d < 2**63 else None


class Places:
    """Where the columns of a target lie in records of one kind: {name: (column, rank)} at the top, {parent: {name: (column, rank)}} below."""

    def __init__(self, target: Target, kind: str | None) -> None:
        self.types = [t for t, _ in target.values()]
        self.top: dict[str, tuple[int, int]] = {}
        self.inner: dict[str, dict[str, tuple[int, int]]] = {}
        for c, (_, paths) in enumerate(target.values()):
            for rank, path in enumerate(paths):
                path, kinds = (path, None) if isinstance(path, str) else path
                if kinds is None or kind in kinds:
                    parent, _, name = path.rpartition(".")
                    (self.inner.setdefault(parent, {}) if parent else self.top).setdefault(name, (c, rank))

    def split(self, record: dict, load) -> tuple[list, dict]:
        """(a value per column, what no column took). Of several fields of one column the first in its list of paths that loads counts."""
        best: dict[int, tuple] = {}
        top, inner, types = self.top, self.inner, self.types

        def offer(place, v, at):
            c, rank = place
            held = best.get(c)
            if v is not None and (held is None or rank < held[0]):
                x = load(v, types[c])
                if x is not None:
                    best[c] = (rank, x, at)

        parts = {}
        for name, v in record.items():
            place = top.get(name)
            if place is not None:
                offer(place, v, (name, None))
            below = inner.get(name)
            if below:
                inside = v if isinstance(v, dict) else read_object(v) if load is load_lenient and isinstance(v, str) and v.lstrip().startswith("{") else None
                if inside:
                    parts[name] = inside
                    for n, w in inside.items():
                        place = below.get(n)
                        if place is not None:
                            offer(place, w, (name, n))
        taken = {at for _, _, at in best.values()}
        rest = {}
        for name, v in record.items():
            if v is None or (name, None) in taken:
                continue
            if name in parts and any((name, n) in taken for n in parts[name]):
                v = {n: w for n, w in parts[name].items() if w is not None and (name, n) not in taken}
                if not v:
                    continue
            rest[name] = v
        return [best[c][1] if c in best else None for c in range(len(types))], rest


def _split_udf(target: Target, load, rebuild):
    """Arrow function (source, kind) to a struct of the target's columns and ``_rescued``. ``rebuild`` makes (record, text) of a source value: text if it is no record."""
    ddl = ", ".join([*(f"`{c}` {t}" for c, (t, _) in target.items()), "_rescued string"])
    schema = to_arrow_type(StructType.fromDDL(ddl))
    names = list(target)

    @F.arrow_udf(ddl)
    def split(source: pa.Array, kind: pa.Array) -> pa.Array:
        places: dict = {}
        columns: list[list] = [[] for _ in range(len(names) + 1)]
        for value, k in zip(source.to_pylist(), kind.to_pylist()):
            record, text = rebuild(value)
            if record is None:
                row, rescued = [None] * len(names), None if text is None else dump(text)
            else:
                if k not in places:
                    places[k] = Places(target, k)
                row, rest = places[k].split(record, load)
                try:
                    rescued = dump(rest) if rest else None
                except RecursionError:
                    row, rescued = [None] * len(names), dump(text)
            for column, x in zip(columns, [*row, rescued]):
                column.append(x)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema))

    return split


def ingest(df: DataFrame, payload: str, target: Target, kind: str | None = None) -> DataFrame:
    """Enforce ``target`` on a column of JSON objects: adds a typed column per entry, and ``_rescued``.

    ``_rescued`` is a JSON object of all fields that no column took: unknown ones, those whose value hasn't exactly the column's JSON type
    (a whole number isn't loaded as double), and what is left of an object of which fields were taken.

    Defined results: a null payload gives null columns and null ``_rescued``; a payload that is no object, holds a name twice or is nested
    deeper than the reader goes is rescued whole, as a JSON text; a field that is null
    is absent; of several fields of one column the first in its list that loads counts and the others are rescued;
    a column of ``df`` with a target's name is replaced; an empty table gives an empty one.
    """
    require_columns(df, [payload, *([kind] if kind else [])])

    def rebuild(text):
        return read_object(text), text

    return _attach(df, target, _split_udf(target, load_strict, rebuild)(F.col(payload), F.col(kind) if kind else F.lit(None).cast("string")))


def _attach(df: DataFrame, target: Target, split, drop=()) -> DataFrame:
    keep = [f"`{c}`" for c in df.columns if c not in target and c not in drop and c not in ("_rescued", "_tw_split")]
    return df.select(*keep, split.alias("_tw_split")).select(*keep, "_tw_split.*")


def replay(table: DataFrame, base: Target, target: Target, kind: str | None = None) -> DataFrame:
    """The table of ``ingest`` under another target: rescued values that its columns can hold without loss move there.

    Works on the typed columns of ``base`` and on ``_rescued`` alone; a typed value goes with its path, which ``base`` must state once per column. Text that
    holds a number, an object given as JSON text, and a list or {"value": ...} of one value are taken apart. Same defined results as ``ingest``.
    """
    require_columns(table, [*base, "_rescued", *([kind] if kind else [])])
    paths = [(c, *spec[1][0].rpartition(".")[::2]) for c, spec in base.items()]
    if any(len(spec[1]) != 1 for spec in base.values()):
        raise ValueError("a column of the base must have one path")

    def rebuild(value):
        rest = read_object(value["_rescued"])
        if rest is None and value["_rescued"] is not None:
            return None, json.loads(value["_rescued"])
        record = dict(rest or {})
        for c, parent, name in paths:
            v = value[c]
            if v is not None:
                if parent:
                    inner = record.get(parent)
                    inner = record[parent] = dict(inner) if isinstance(inner, dict) else {}
                    inner[name] = v
                else:
                    record[name] = v
        return record, value["_rescued"]

    split = _split_udf(target, load_lenient, rebuild)(F.struct(*[F.col(f"`{c}`") for c in base], F.col("_rescued")), F.col(kind) if kind else F.lit(None).cast("string"))
    return _attach(table, target, split, drop=base)


def derive_target(profile: DataFrame, changes: DataFrame, seeds: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[str, list]]:
    """A target for ``replay`` with one column per quantity over all kinds: ``seeds`` ({column: (SQL type, paths)}) first, then every other field of the profile.

    Names of a kind (and, in an object, of that object) are one quantity if the report says that one was renamed to the other, over any number of renames, most frequent
    first; never if a file holds both side by side, or if they would join two seeds. A rename of another kind or level counts only if the values of the two names are alike in the feeds of this one too. Across kinds a quantity goes by its most frequent name (of equals, that of the earliest file); a field of an object is called
    object_field. Objects have no column of their own, their fields have; numbers without a fraction load as bigint.

    Only the vocabulary (names, pairs of names) comes to the driver; it doesn't grow with records or files.
    """
    profile = profile.filter("name is not null")
    sums = [F.sum(c).alias(c) for c in _STATS if c not in ("places", "lo_word", "hi_word")]
    words = {(r["kind"], r["parent"], r["name"]): r.asDict() for r in profile.groupBy("kind", "parent", "name").agg(*sums, F.max("places").alias("places"), F.min("file_no").alias("first")).collect()}
    kind_of = profile.select(F.col("feed").alias("_f"), F.col("file_no").alias("_n"), "kind").distinct()
    told = changes.filter("change = 'renamed'").join(kind_of, F.col("feed").eqNullSafe(F.col("_f")) & (F.col("file_no") == F.col("_n")))
    told = sorted(told.groupBy("kind", "old_name", "new_name").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (-r["n"], str(r["kind"]), r["old_name"], r["new_name"]))
    sets = profile.groupBy("feed", "kind", "file_no", "parent").agg(F.sort_array(F.collect_set("name")).alias("names")).select("kind", "parent", "names").distinct()
    pairs = sets.select("kind", (F.col("parent") != "").alias("deep"), "names", F.explode("names").alias("a")).select("kind", "deep", "a", F.explode("names").alias("b")).filter("a < b").distinct()
    together = {tuple(r) for r in pairs.collect()}
    leaf = lambda x: x.rpartition(".")[2]
    elsewhere = _alike(profile, sorted({(leaf(r["old_name"]), leaf(r["new_name"])) for r in told}))
    seed_of = {path: column for column, (_, paths) in seeds.items() for path in paths}

    def groups(kind, deep: bool, names: set[str], renames: list[tuple[str, str]], before: list[str]) -> list[set[str]]:
        of = {n: {n} for n in names}
        seed = lambda g: {seed_of[p + n] for n in g for p in before if p + n in seed_of}
        for a, b in [*renames, *((a, b) for k, d, a, b in elsewhere if (k, d) == (kind, deep))]:
            x, y = of.get(a), of.get(b)
            if x is None or y is None or x is y or len(seed(x | y)) > 1 or any((kind, deep, min(m, n), max(m, n)) in together for m in x for n in y):
                continue
            x |= y
            of.update(dict.fromkeys(y, x))
        return sorted({id(g): g for g in of.values()}.values(), key=sorted)

    def total(rows: list[dict]) -> dict:
        return {c: sum(r[c] for r in rows) for c in rows[0] if c in _STATS and c != "places"} | {"places": max(r["places"] or 0 for r in rows)}

    often: dict[tuple[bool, str], tuple[int, int]] = {}  # records, negative for sorting, and first file
    for (_, parent, name), r in words.items():
        n, first = often.get((parent != "", name), (0, r["first"]))
        often[parent != "", name] = (n - r["n"], min(first, r["first"]))
    by_use = lambda g, deep: sorted(g, key=lambda n: (often[deep, n], n))
    found: dict[str, list[tuple[list[str], object, list[dict]]]] = {c: [] for c in seeds}
    for kind in sorted({k for k, _, _ in words}, key=str):
        top = {n for k, p, n in words if k == kind and not p}
        mine = [(r["old_name"], r["new_name"]) for r in told if r["kind"] == kind]
        for g in groups(kind, False, top, [x for x in mine if x[0] in top and x[1] in top], [""]):
            rows = [words[kind, "", n] for n in g]
            if file_type(total(rows)) != "object":
                by_seed = [seed_of[n] for n in sorted(g) if n in seed_of]
                found.setdefault(by_seed[0] if by_seed else by_use(g, False)[0], []).append((by_use(g, False), kind, rows))
                continue
            parents = by_use(g, False)
            fields = {n for k, p, n in words if k == kind and p in g}
            cut = lambda x: next((x[len(p) + 1 :] for p in parents if x.startswith(p + ".") and x[len(p) + 1 :] in fields), None)
            for h in groups(kind, True, fields, [(cut(a), cut(b)) for a, b in mine], [p + "." for p in parents]):
                rows = [words[kind, p, n] for p in parents for n in h if (kind, p, n) in words]
                by_seed = [seed_of[f"{p}.{n}"] for p in parents for n in sorted(h) if f"{p}.{n}" in seed_of]
                paths = [f"{p}.{n}" for n in by_use(h, True) for p in parents]
                found.setdefault(by_seed[0] if by_seed else f"{parents[0]}_{by_use(h, True)[0]}", []).append((paths, kind, rows))
    out: dict[str, tuple[str, list]] = {c: (t, []) for c, (t, _) in seeds.items()}
    for column, parts in found.items():
        type_ = seeds[column][0] if column in seeds else column_type(total([r for _, _, rows in parts for r in rows]))
        out[column] = (type_, [(p, [kind]) for paths, kind, _ in parts for p in paths])
        if column in seeds and not parts:
            out[column] = seeds[column]
    return out


def _alike(profile: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple]:
    """(kind, whether in an object, a, b) of the pairs of names whose values are alike in the feeds of a kind that hold both, by the mean over these feeds."""
    if not pairs:
        return []
    at = ["feed", "kind", "deep"]
    per = profile.withColumn("deep", F.col("parent") != "").groupBy(*at, "name").agg(F.struct(*[{"places": F.max(c), "lo_word": F.min(c), "hi_word": F.max(c)}.get(c, F.sum(c)).alias(c) for c in _STATS]).alias("s"))
    asked = F.broadcast(profile.sparkSession.createDataFrame(pairs, "a string, b string"))  # names of the vocabulary
    left = per.join(asked, per["name"] == asked["a"]).select(*[F.col(c).alias(f"_{c}") for c in at], "a", "b", F.col("s").alias("x"))
    on = left["_feed"].eqNullSafe(per["feed"]) & left["_kind"].eqNullSafe(per["kind"]) & (left["_deep"] == per["deep"]) & (left["b"] == per["name"])
    both = left.join(per, on).select("kind", "deep", "a", "b", "x", F.col("s").alias("y"))

    def run(batches):
        for pdf in batches:
            yield pdf[["kind", "deep", "a", "b"]].assign(like=[likeness(x, y) for x, y in zip(pdf["x"], pdf["y"])])

    like = both.mapInPandas(run, "kind string, deep boolean, a string, b string, like double")
    return sorted((tuple(r)[:4] for r in like.groupBy("kind", "deep", "a", "b").agg(F.avg("like").alias("like")).filter(F.col("like") >= MIN_LIKENESS).collect()), key=str)


def column_type(s: dict) -> str:
    """The SQL type that a quantity of these statistics loads as."""
    kind = file_type(s)
    if kind in ("list", "boolean"):
        return {"list": "array<string>", "boolean": "boolean"}[kind]
    if kind == "text" and (s["tokens"] != s["numbers"] or s["tokens"] != s["n"]):
        return "string"
    return "bigint" if not s["places"] and s["m1"] >= 0 else "double"


def consistent_records(table: DataFrame, base: Target, profile: DataFrame, changes: DataFrame, seeds: dict[str, tuple[str, list[str]]], kind: str = "feed_kind") -> DataFrame:
    """All ingested records in one table with a column per quantity (``derive_target``), values replayed from what was rescued."""
    whole = derive_target(profile, changes, seeds)
    taken = {c.lower() for c in [*(c for c in table.columns if c not in base), *seeds, "_rescued"]}
    named = {}
    for column, spec in whole.items():  # names that differ in letter case only, or are a column of the records already
        name = column
        while column not in seeds and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        named[name] = spec
    return replay(table, base, named, kind)


# -- profile and report -----------------------------------------------------------------------------------


def _number(stats: dict, text: str) -> None:
    """Add one number to the statistics of its field."""
    x = float(text)
    stats["numbers"] += 1
    if x == 0:
        stats["zero"] += 1
    elif not math.isinf(x):
        log = math.log(abs(x))
        stats["m1"] += log
        stats["m2"] += log * log
        if x < 0:
            stats["neg"] += 1
    point = text.find(".")
    if point >= 0 and "e" not in text and "E" not in text:
        places = len(text.rstrip("0")) - point - 1
        if places > stats["places"]:
            stats["places"] = places


def _note(stats: dict, v) -> None:
    """Add one value to the statistics of its field."""
    stats["n"] += 1
    t = type(v)
    if t is Number or t is float or t is int:
        text = v if t is Number else repr(v)
        stats["n_num"] += 1
        stats["tokens"] += 1
        if not (t is int or (t is Number and v.lstrip("-").isdigit())):
            stats["n_dec"] += 1
        _number(stats, text)
        return
    if t is bool:
        stats["n_bool"] += 1
        stats["tokens"] += 1
        _number(stats, "1" if v else "0")
        return
    if t is str:
        stats["n_text"] += 1
        body = v
    else:
        stats["n_list" if t is list else "n_obj"] += 1
        body = dump(v)
    for token in _TOKEN.findall(_KEYS.sub("", body) if '"' in body else body):
        stats["tokens"] += 1
        if token[0] == "-" or token[0].isdigit():
            _number(stats, token)
            continue
        word = token.lower()
        if word in ("true", "false"):
            _number(stats, "1" if word == "true" else "0")
            continue
        if stats["lo_word"] is None or word < stats["lo_word"]:
            stats["lo_word"] = word
        if stats["hi_word"] is None or word > stats["hi_word"]:
            stats["hi_word"] = word


_FIELD = ["parent", "name", *_STATS]
_PROFILE = "feed string, kind string, file_no long, parent string, name string, n long, n_text long, n_bool long, n_list long, n_obj long, n_num long, n_dec long, tokens long, numbers long, m1 double, m2 double, neg long, zero long, places int, lo_word string, hi_word string"


def record_profile(table: DataFrame, base: Target, feed: str = "feed", kind: str = "feed_kind", file_no: str = "file_no") -> DataFrame:
    """Statistics per file and field of an ingested table, written. One pass over the records; a row with a null name stands for the file itself.

    Fields are those of the typed columns and of ``_rescued``, one level of objects deep.
    """
    require_columns(table, [feed, kind, file_no, "_rescued", *base])
    paths = [(f"_c{i}", *spec[1][0].rpartition(".")[::2]) for i, spec in enumerate(base.values())]
    src = table.filter(F.col(file_no).isNotNull()).select(F.col(feed).alias("feed"), F.col(kind).alias("kind"), F.col(file_no).cast("long").alias("file_no"), "_rescued", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(base)])
    schema = pa.schema(list(to_arrow_type(StructType.fromDDL(_PROFILE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict] = {}

        def field(at, parent, name, v):
            stats = found.get((*at, parent, name))
            if stats is None:
                stats = found[*at, parent, name] = dict.fromkeys(_STATS[:-2], 0) | {"m1": 0.0, "m2": 0.0, "lo_word": None, "hi_word": None}
            if name is not None:
                _note(stats, v)

        def batch():
            rows = [dict(zip(("feed", "kind", "file_no", "parent", "name"), k)) | v for k, v in found.items()]
            found.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for b in batches:
            feeds, kinds, files, rescued = (b.column(c).to_pylist() for c in ("feed", "kind", "file_no", "_rescued"))
            columns = [(b.column(c).to_pylist(), parent, name) for c, parent, name in paths]
            for i, at in enumerate(zip(feeds, kinds, files)):
                field(at, None, None, None)
                record = (read_object(rescued[i]) or {}) if rescued[i] else {}
                inside = {p: v for p, v in record.items() if isinstance(v, dict)}
                for values, parent, name in columns:
                    v = values[i]
                    if v is None:
                        continue
                    if parent:
                        inside.setdefault(parent, {})[name] = v
                    else:
                        record[name] = v
                for name, v in record.items():
                    if name not in inside:
                        field(at, "", name, v)
                for parent, fields in inside.items():
                    field(at, "", parent, fields)
                    for name, v in fields.items():
                        if v is not None:
                            field(at, parent, name, v)
            if len(found) >= FLUSH:
                yield batch()
        yield batch()

    parts = src.mapInArrow(run, _PROFILE)
    keys = ["feed", "kind", "file_no", "parent", "name"]
    largest = {"places": F.max("places").alias("places"), "lo_word": F.min("lo_word").alias("lo_word"), "hi_word": F.max("hi_word").alias("hi_word")}
    return materialize(parts.groupBy(*keys).agg(*[largest.get(c, F.sum(c).alias(c)) for c in _STATS]), "profile")


def file_type(s: dict) -> str:
    """The type of a field in a file: the most frequent one, a number being decimal if any is."""
    counts = [("text", s["n_text"]), ("boolean", s["n_bool"]), ("list", s["n_list"]), ("object", s["n_obj"]), ("decimal" if s["n_dec"] else "integer", s["n_num"])]
    return max(counts, key=lambda x: x[1])[0]


def likeness(a: dict, b: dict) -> float:
    """How alike the values of two fields are, 0 to 1."""
    na, nb = a["numbers"], b["numbers"]
    wa, wb = a["tokens"] - na, b["tokens"] - nb
    if (wa > na) != (wb > nb):
        return 0.0
    if wa > na:
        same = (a["lo_word"] == b["lo_word"]) + (a["hi_word"] == b["hi_word"])
        return (0.1, 0.6, 1.0)[same]
    ta, tb = max(a["tokens"], 1) / max(a["n"], 1), max(b["tokens"], 1) / max(b["n"], 1)
    if (ta > 2) != (tb > 2):
        return 0.0
    da, db = na - a["zero"], nb - b["zero"]
    flag = lambda s, d: d == 0 or (abs(s["m1"]) < 1e-9 and s["m2"] < 1e-9)
    if flag(a, da) or flag(b, db):  # only zeros and ones
        return 1.0 if flag(a, da) and flag(b, db) else 0.0
    ma, mb = a["m1"] / da, b["m1"] / db
    sa = math.sqrt(max(a["m2"] / da - ma * ma, 0.0))
    sb = math.sqrt(max(b["m2"] / db - mb * mb, 0.0))
    far = abs(ma - mb) / max((sa + sb) / 2, 0.15)
    far += abs(math.log((sa + 0.05) / (sb + 0.05)))
    far += 4 * abs(a["neg"] / na - b["neg"] / nb) if (a["neg"] == 0) != (b["neg"] == 0) else 0.0
    far += 0.7 * min(abs((a["places"] or 0) - (b["places"] or 0)), 4)
    return math.exp(-far / 2)


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p]


def name_likeness(a: str, b: str) -> float:
    """How alike two names are spelled, 0 to 1: same letters, initials, a name in the other, shared words."""
    pa, pb = _parts(a), _parts(b)
    ja, jb = "".join(pa), "".join(pb)
    if not ja or not jb:
        return 0.0
    if ja == jb:
        return 1.0
    short, long, words = (ja, jb, pb) if len(ja) <= len(jb) else (jb, ja, pa)
    if short == "".join(w[0] for w in words):
        return 0.9
    rest = iter(long)
    inside = short[0] == long[0] and all(c in rest for c in short)
    shared = len(set(pa) & set(pb)) / max(len(set(pa) | set(pb)), 1)
    return max(0.6 if inside else 0.0, shared)


def _assign(gone: dict[str, dict], new: dict[str, dict], banned: set[tuple[str, str]]) -> dict[str, str]:
    """Old name to new name of the fields that go on, each used once, best pairs first."""
    pairs = []
    for a, sa in gone.items():
        for b, sb in new.items():
            names = name_likeness(a, b)
            if (a, b) in banned and names < 1.0:
                continue
            values = likeness(sa, sb)
            if names == 1.0 and values > 0.02:
                values = max(values, 0.9)
            if values >= MIN_LIKENESS:
                pairs.append((values + 0.8 * names, a, b))
    out, used = {}, set()
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in out and b not in used:
            out[a] = b
            used.add(b)
    return out


def compare_files(prev: dict[tuple[str, str], dict], cur: dict[tuple[str, str], dict], banned: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Changes (change, old_name, new_name) between two files, given as {(parent, name): statistics}."""
    out = []

    def level(old: dict[str, dict], new: dict[str, dict], before: str, after: str) -> dict[str, str]:
        pa, pb = (before + "." if before else ""), (after + "." if after else "")
        kept = {k: k for k in old if k in new}
        renamed = _assign({k: v for k, v in old.items() if k not in new}, {k: v for k, v in new.items() if k not in old}, banned)
        for a, b in renamed.items():
            out.append(("renamed", pa + a, pb + b))
        same = {**kept, **renamed}
        for a, b in same.items():
            if file_type(old[a]) != file_type(new[b]):
                out.append(("retyped", pa + a, pb + b))
        out.extend(("removed", pa + a, "") for a in old if a not in same)
        out.extend(("added", "", pb + b) for b in new if b not in set(same.values()))
        return same

    at = lambda d, parent: {n: s for (p, n), s in d.items() if p == parent}
    top = level(at(prev, ""), at(cur, ""), "", "")
    for a, b in top.items():
        if file_type(prev["", a]) == "object" and file_type(cur["", b]) == "object":
            level(at(prev, a), at(cur, b), a, b)
    return out


def schema_changes(profile: DataFrame) -> DataFrame:
    """Each change between a file and the previous one of its feed: ``feed``, ``file_no``, ``change``, ``old_name``, ``new_name``; from ``record_profile``.

    Fields inside an object are named parent.field, one level deep; deeper objects are values. Defined results: a
    feed's first file has no change; files without records are absent, so the previous file is the last present one; records whose payload
    is null or no object hold no field; a null feed is a feed of its own; rows without a file_no are left out; ties
    between candidates go to the names in order; an empty table gives no row.
    """
    keys = ["feed", "kind", "file_no"]
    # Rows of files and their fields, no records. A file without any field is still there, by its own row.
    files = profile.groupBy(*keys).agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct(*_FIELD))).alias("fields"))
    in_feed = Window.partitionBy("feed").orderBy("file_no", "kind")
    steps = files.withColumn("before", F.lag("fields").over(in_feed)).filter(F.col("before").isNotNull())
    steps = steps.withColumn("_step", F.struct("feed", "kind", "file_no"))
    banned = _held_together(profile.filter("name is not null"), steps, keys)
    joined = steps.join(banned, steps["_step"] == banned["_step"], "left").select("feed", "file_no", "before", "fields", "banned")
    schema = "feed string, file_no long, change string, old_name string, new_name string"

    def run(batches):
        for pdf in batches:
            rows = []
            for f, n, before, fields, ban in zip(pdf["feed"], pdf["file_no"], pdf["before"], pdf["fields"], pdf["banned"]):
                prev = {(x["parent"], x["name"]): x for x in before}
                cur = {(x["parent"], x["name"]): x for x in fields}
                no = {(x["a"], x["b"]) for x in ban} if ban is not None else set()
                rows.extend((f, n, *c) for c in compare_files(prev, cur, no))
            yield pd.DataFrame(rows, columns=["feed", "file_no", "change", "old_name", "new_name"])

    return joined.mapInPandas(run, schema).withColumn("file_no", F.col("file_no").cast("int")).distinct()


def _held_together(profile: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per step, the pairs (vanished, appeared) of names that some file of the kind holds side by side.

    Two names beside each other in one file are two quantities. Work is on candidate pairs of names and on
    files, never on records.
    """
    names = lambda c: F.transform(c, lambda x: F.struct((x["parent"] != "").alias("deep"), x["name"].alias("name")))
    cand = steps.select("_step", F.col("kind"), F.array_except(names("before"), names("fields")).alias("x"), F.array_except(names("fields"), names("before")).alias("y"))
    cand = cand.select("_step", "kind", F.explode("x").alias("x"), "y").select("_step", "kind", "x", F.explode("y").alias("y")).filter("x.deep = y.deep")
    cand = cand.select("_step", "kind", F.col("x.deep").alias("deep"), F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    wanted = cand.select("kind", "deep", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    held = profile.select(*keys, "parent", "name").withColumn("deep", F.col("parent") != "").withColumn("_at", F.struct(*keys, "parent"))
    first = held.select(F.col("kind").alias("_k"), F.col("deep").alias("_d"), F.col("name").alias("_n"), "_at")
    hits = wanted.join(first, wanted["kind"].eqNullSafe(first["_k"]) & (wanted["deep"] == first["_d"]) & (wanted["lo"] == first["_n"])).select("kind", "deep", "lo", "hi", "_at")
    second = held.select(F.col("_at").alias("_at2"), F.col("name").alias("_n2"))
    both = hits.join(second, (hits["_at"] == second["_at2"]) & (hits["hi"] == second["_n2"]), "left_semi").select("kind", "deep", "lo", "hi").distinct()
    both = both.select(F.col("kind").alias("_k"), F.col("deep").alias("_d"), "lo", "hi")
    on = cand["kind"].eqNullSafe(both["_k"]) & (cand["deep"] == both["_d"]) & (F.least(cand["a"], cand["b"]) == both["lo"]) & (F.greatest(cand["a"], cand["b"]) == both["hi"])
    return cand.join(both, on, "left_semi").groupBy("_step").agg(F.collect_set(F.struct("a", "b")).alias("banned"))
