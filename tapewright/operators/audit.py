"""Data-quality audits of tapes, collections of files and enriched records. Reports are DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions.common import finite, materialize, with_positions
from tapewright.functions.halo import BUCKET_MS, over_shards, running


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field``, ``nulls``: one pass, one row per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def invalid_counts(df: DataFrame, price: str = "price", qty: str = "qty", side: str | None = None, sides: tuple = (-1, 1)) -> DataFrame:
    """Prices and quantities that are not above 0, and sides other than ``sides`` (null included)."""
    bad_side = F.count_if(~F.coalesce(F.col(side).isin(*sides), F.lit(False))) if side else F.lit(0).cast("long")
    return df.agg(bad_side.alias("side_invalid"), F.count_if(F.col(price) <= 0).alias("price_non_positive"), F.count_if(F.col(qty) <= 0).alias("qty_non_positive"))


def duplicate_counts(df: DataFrame, identifier: str, file: str) -> DataFrame:
    """Exact repeats of an identifier: inside files, and over all (rows with one less distinct ones). Counted after map-side combine by identifier."""
    per = df.filter(F.col(identifier).isNotNull()).groupBy(identifier, file).agg(F.count(F.lit(1)).alias("n"))
    by_id = per.groupBy(identifier).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("within"))
    return by_id.agg(F.coalesce(F.sum("within"), F.lit(0)).alias("within_files"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("overall"))


def disorder(df: DataFrame, file: str, order: str, column: str) -> DataFrame:
    """Files in which ``column`` falls from one row to the next in order, and how often. Neighbours are looked up in shards of a file."""
    d = df.select(F.col(file).alias("_file"), F.col(order).cast("long").alias("_o"), F.col(column).alias("_v"))
    steps = over_shards(d, lambda x, w: x.withColumn("_prev", F.lag("_v").over(w)), 1, 1, keys=("_file",), order=("_o",))
    return steps.groupBy(F.col("_file").alias(file)).agg(F.count_if(F.col("_v") < F.col("_prev")).alias("falls")).filter("falls > 0")


def _by_start(ranges: DataFrame, keys: list[str], start: str, end: str, name: str, neighbour: Callable) -> DataFrame:
    """Ranges with both bounds and ``_near``, a value of the neighbouring range in order of start, end and name: looked up in shards, so no key is one task."""
    clean = ranges.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    return over_shards(clean, lambda x, w: x.withColumn("_near", neighbour(w)), 1, 1, keys=tuple(keys), order=(start, end, name)).drop("event_idx")


def timeline_segments(ranges: DataFrame, keys: list[str], start: str = "min_ts", end: str = "max_ts", name: str = "file_name", gap_ms: int = 300_000) -> DataFrame:
    """Files in order of their start, cut where the next starts more than ``gap_ms`` after the end of the one before: ``segment``, files, from, to."""
    d = _by_start(ranges, keys, start, end, name, lambda w: F.lag(end).over(w))
    new = F.coalesce((F.col(start) - F.col("_near") > gap_ms).cast("long"), F.lit(0).cast("long"))
    d = running(d, {"segment": new}, keys=tuple(keys), order=(start, end, name), width=BUCKET_MS)
    return d.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("files"), F.min(start).alias("from_ts"), F.max(end).alias("to_ts"))


def boundary_checks(ranges: DataFrame, keys: list[str], start: str = "min_ts", end: str = "max_ts", name: str = "file_name") -> DataFrame:
    """Of neighbouring files: how many step back, meet exactly, leave more than a second; the largest of each."""
    d = _by_start(ranges, keys, start, end, name, lambda w: F.lead(start).over(w))
    d = d.withColumn("_d", F.col("_near") - F.col(end)).filter("_d is not null")
    return d.groupBy(*keys).agg(F.count_if(F.col("_d") < 0).alias("backwards"), F.count_if(F.col("_d") == 0).alias("exact"), F.count_if(F.col("_d") > 1000).alias("gaps_over_1s"), F.least(F.min("_d"), F.lit(0)).alias("max_backward_ms"), F.greatest(F.max(F.when(F.col("_d") > 1000, F.col("_d"))), F.lit(0)).alias("max_forward_ms"))


def gap_stats(tape: DataFrame, key: str = "symbol") -> DataFrame:
    """Milliseconds between neighbouring trades: smallest, median, 95th percentile (nearest rank), largest, how many above 1, 5, 10 and 60 s, and how many share a timestamp."""
    d = over_shards(tape, lambda x, w: x.withColumn("_gap", F.col("timestamp") - F.lag("timestamp").over(w)), 1, 1, keys=(key,))
    d = materialize(d.select(key, "_gap"), "gaps")
    over = {f"gaps_over_{s}s": F.count_if(F.col("_gap") > s * 1000) for s in (1, 5, 10, 60)}
    g = d.groupBy(key).agg(F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), *[v.alias(k) for k, v in over.items()], F.count_if(F.col("_gap") == 0).alias("duplicate_ts"))
    q = order_statistics(d, key, "_gap", {"p50_gap": 0.5}, {"p95_gap": 0.95}).drop("n").withColumnRenamed(key, "_kq")
    return g.join(q, g[key].eqNullSafe(q["_kq"]), "left").drop("_kq")


def order_statistics(values: DataFrame, key: str, value: str, linear: dict[str, float], nearest: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, with the number of values ``n``: ``linear`` between the neighbouring ranks, ``nearest`` at rank int(q (n - 1)). Ranks by distributed positions; null, NaN and infinite values are left out."""
    good = values.filter(finite(F.col(value).cast("double"))).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    size = F.floor(F.log2(F.abs("_v") + F.lit(2.0**-40)) * 8)
    placed = with_positions(good, ["_k"], ["_v"], F.when(F.col("_v") < 0, -(size + 400)).otherwise(size + 400).cast("long"))
    n = good.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_k", "_kn")
    j = placed.join(n, placed["_k"].eqNullSafe(n["_kn"]))
    at = lambda rank: F.max(F.when(F.col("_pos") == rank, F.col("_v")))
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    picks = [at(F.floor(place(q))).alias(name) for name, q in nearest.items()]
    for name, q in linear.items():
        low, high = at(F.floor(place(q))), at(F.ceil(place(q)))
        share = F.max(place(q) - F.floor(place(q)))
        picks.append((low + (high - low) * share).alias(name))
    return j.groupBy(F.col("_k").alias(key)).agg(F.max("_n").alias("n"), *picks)


def nearest_rank(values: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Values at rank int(q (n - 1)) of the ascending order: no interpolation."""
    return order_statistics(values, key, value, {}, quantiles)


def iqr_outliers(values: DataFrame, key: str, value: str) -> DataFrame:
    """Fences of 1.5 interquartile ranges and how many values lie outside; groups of fewer than 8 values have null fences and count 0."""
    q = nearest_rank(values, key, value, {"q1": 0.25, "q3": 0.75}).withColumn("_iqr", F.col("q3") - F.col("q1"))
    q = q.select(F.col(key).alias("_q"), "n", F.when(F.col("n") >= 8, F.col("q1") - 1.5 * F.col("_iqr")).alias("low"), F.when(F.col("n") >= 8, F.col("q3") + 1.5 * F.col("_iqr")).alias("high"))
    v = values.filter(finite(F.col(value)))
    j = v.join(q, v[key].eqNullSafe(q["_q"]))
    return j.groupBy(key).agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), F.count_if((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).alias("outliers"))


def forward_returns(rows: DataFrame, key: str, horizons_ms: tuple[int, ...] = (3_000, 10_000), carry: tuple[str, ...] = ()) -> DataFrame:
    """Relative price change to the first later row at least a horizon ahead. Rows without such a row, and rows of price 0, have null.

    Input: ``key``, ``seq``, ``timestamp``, ``price``. Of several rows at the target instant the first (by seq) counts. As-of join by time buckets: a row looks into the
    bucket of its target and, through one row per bucket, at the first row of the next bucket that has one; no key is one task.
    """
    out = rows.select(F.col(key).alias("_k"), "seq", "timestamp", "price", *carry)
    width = 60_000
    first = out.groupBy("_k", "timestamp").agg(F.min_by("price", "seq").alias("_p")).withColumn("_b", F.floor(F.col("timestamp") / F.lit(width)))
    heads = first.groupBy("_k", "_b").agg(F.min(F.struct("timestamp", "_p")).alias("_head"))
    for h in horizons_ms:
        asked = out.withColumn("_at", F.col("timestamp") + h).withColumn("_b", F.floor(F.col("_at") / F.lit(width)))
        # In each bucket, rows and questions in one order; an answer is the next row at or after the question.
        marks = asked.select("_k", "_b", F.col("_at").alias("_t"), F.lit(0).alias("_kind"), F.struct("seq", "timestamp", "price", *[c for c in asked.columns if c not in ("_k", "_b", "_at", "seq", "timestamp", "price")]).alias("_q"), F.lit(None).cast("double").alias("_p"))
        facts = first.select("_k", "_b", F.col("timestamp").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_q"].dataType).alias("_q"), "_p")
        # Backwards in time, so that the frame only grows: its cost is one step a row.
        w = Window.partitionBy("_k", "_b").orderBy(F.col("_t").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
        both = marks.unionByName(facts).withColumn("_in", F.last("_p", ignorenulls=True).over(w)).filter("_kind = 0")
        buckets = both.select("_k", "_b").distinct().join(heads.select(F.col("_k").alias("_hk"), F.col("_b").alias("_hb"), "_head"), F.col("_k").eqNullSafe(F.col("_hk")) & (F.col("_b") == F.col("_hb")), "left").select("_k", "_b", "_head")
        later = heads.select("_k", "_b", "_head").unionByName(buckets.filter("_head is null")).withColumn("_next", F.last("_head._p", ignorenulls=True).over(Window.partitionBy("_k").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)))
        later = later.select(F.col("_k").alias("_lk"), F.col("_b").alias("_lb"), "_next")
        j = both.join(later, both["_k"].eqNullSafe(later["_lk"]) & (both["_b"] == later["_lb"]), "left")
        target = F.coalesce("_in", "_next")
        out = j.select("_k", "_q.*", F.try_divide(target - F.col("_q.price"), F.col("_q.price")).alias(f"ret_{h // 1000}s"))
    return out.withColumnRenamed("_k", key)


def directional_accuracy(rows: DataFrame, signal: str, ret: str, threshold: float = 0.6) -> DataFrame:
    """Of rows with a strong signal and a known return: how many, and how many returns had its sign (no return is no hit)."""
    strong = rows.filter((F.abs(signal) >= threshold) & F.col(ret).isNotNull())
    return strong.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.signum(signal) == F.signum(ret)).alias("hits"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the rows where both are known; null below 3 rows or without variance."""
    both = rows.filter(finite(F.col(x)) & finite(F.col(y)))
    g = both.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return g.select("n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("r")).alias("corr"))


#: Rows of a block of the permutation test.
BLOCK_ROWS = 4096


def permutation_pvalue(rows: DataFrame, group: str, value: str, n_iter: int = 2000, seed: int = 42) -> DataFrame:
    """p-value of the difference of means of two groups (boolean ``group``) under random permutations of the labels: (as extreme + 1) / (n_iter + 1). Null below 2 rows in a group.

    Every iteration is a permutation: exactly as many rows bear the label as do. Rows are put in an order of their own values and cut into blocks; how many labels a block gets is drawn
    block after block from the hypergeometric distribution (a row per block), which rows of the block get them inside the block. Random streams follow
    the seed and the block, so the result doesn't depend on partitions.
    """
    good = rows.filter(finite(F.col(value)) & F.col(group).isNotNull()).select(F.col(group).cast("boolean").alias("g"), F.col(value).cast("double").alias("v"))
    hashed = good.withColumn("h", F.xxhash64("v", "g"))
    placed = with_positions(hashed, [], ["h", "v", "g"], F.shiftright("h", 48)).select("g", "v", F.floor(F.col("_pos") / F.lit(BLOCK_ROWS)).alias("block"))
    placed = materialize(placed, "blocks")
    facts = placed.agg(F.count_if("g").alias("na"), F.count_if(~F.col("g")).alias("nb"), F.avg(F.when(F.col("g"), F.col("v"))).alias("ma"), F.avg(F.when(~F.col("g"), F.col("v"))).alias("mb"), F.sum("v").alias("sv")).first()
    na, nb = facts["na"], facts["nb"]
    if min(na, nb) < 2:
        return rows.sparkSession.createDataFrame([(None,)], "p_value double")

    def draw(batches):
        import numpy as np

        left = np.full(n_iter, na), np.full(n_iter, nb)
        for pdf in batches:
            out = []
            for block, n in zip(pdf["block"].tolist(), pdf["n"].tolist()):
                got = np.random.default_rng([seed, 0, block]).hypergeometric(left[0], left[1], n)
                left = left[0] - got, left[1] - (n - got)
                out.append(got.tolist())
            yield pdf[["block"]].assign(labels=out)

    # One row per block, streamed through one task.
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions("block")
    labels = sizes.mapInPandas(draw, "block long, labels array<int>")

    def sums(pdf: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        block = int(pdf["block"].iloc[0])
        v = np.sort(pdf["v"].to_numpy())
        rng = np.random.default_rng([seed, 1, block])
        count = np.asarray(drawn["labels"].iloc[0])
        total = np.array([v[rng.permutation(len(v))[:k]].sum() for k in count])
        return pd.DataFrame({"i": np.arange(n_iter), "t": total})

    per = placed.groupBy("block").cogroup(labels.groupBy("block")).applyInPandas(sums, "i int, t double").groupBy("i").agg(F.sum("t").alias("t"))
    distance = F.abs(F.col("t") / na - (F.lit(facts["sv"]) - F.col("t")) / nb)
    return per.agg(((F.count_if(distance >= abs(facts["ma"] - facts["mb"])) + 1) / (n_iter + 1)).alias("p_value"))


def schema_variants(spark: SparkSession, path: str) -> DataFrame:
    """Columns and types over the parquet files at ``path``: ``field``, ``dtype``, ``files`` (how many hold the field with that type), ``n_files`` and ``layouts`` (different lists of columns in all).

    Footers are read on the executors, one file at a time.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                system, place = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                schema = pq.read_schema(place, filesystem=system)
                rows += [(p, n, str(t), "|".join(schema.names)) for n, t in zip(schema.names, schema.types)]
            yield pd.DataFrame(rows, columns=["path", "field", "dtype", "layout"])

    f = found.mapInPandas(footers, "path string, field string, dtype string, layout string")
    f = materialize(f, "footers")
    whole = f.agg(F.count_distinct("path").alias("n_files"), F.count_distinct("layout").alias("layouts")).first()
    return f.groupBy("field", "dtype").agg(F.count(F.lit(1)).alias("files")).withColumns({"n_files": F.lit(whole["n_files"]), "layouts": F.lit(whole["layouts"])})


def tape_report(tape: DataFrame) -> DataFrame:
    """The audit of a tape in one table (``symbol``, ``metric``, ``value``): rows, first and last instant, duration, rate, gaps."""
    base = tape.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))
    base = base.withColumn("duration_s", (F.col("ts_max") - F.col("ts_min")) / 1000).withColumn("rows_per_s", F.try_divide("rows", "duration_s"))
    g = gap_stats(tape).withColumnRenamed("symbol", "_s")
    whole = base.join(g, base["symbol"].eqNullSafe(g["_s"])).drop("_s")
    names = [c for c in whole.columns if c != "symbol"]
    return whole.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("symbol", "m.*")


# -- rules over enriched records --------------------------------------------------------------------------

# The fields of an enriched record, and below the names of the rules.
NUMERIC = ["timestamp", "price", "delta", "window_cum_delta", "session_cum_delta", "buy_volume", "sell_volume", "pressure", "volume_per_sec", "delta_per_sec", "trade_intensity", "price_range"]
BOOLEAN = ["absorption", "warm"]


def rule_violations(lines: DataFrame, line_no: str = "line_no", text: str = "line_text", examples: int = 10) -> DataFrame:
    """Rules that enriched JSON lines break: ``rule``, ``count``, and the first ``examples`` line numbers.

    As soon as a line breaks a rule of shape, the rules that need that shape are not asked. Lines are VARIANT values; each is read once.
    """
    v = F.try_parse_json(F.col(text))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("NONE"))
    get = lambda p: F.try_variant_get(F.col("_v"), p, "variant")
    d = lines.select(F.col(line_no).alias("line_no"), F.trim(text).alias("_t"), v.alias("_v"))
    d = d.withColumns({"_ts": get("$.ts"), "_flow": get("$.flow"), "_kind": kind(F.col("_v"))})
    d = d.withColumns({"_kts": kind(F.col("_ts")), "_kf": kind(F.col("_flow"))})
    d = d.withColumns({f"k_{c}": kind(F.try_variant_get("_flow", f"$.{c}", "variant")) for c in NUMERIC + BOOLEAN} | {c: F.try_variant_get("_flow", f"$.{c}", "double") for c in NUMERIC} | {f"b_{c}": F.try_variant_get("_flow", f"$.{c}", "boolean") for c in BOOLEAN} | {"ts": F.try_variant_get("_v", "$.ts", "bigint")})
    empty = F.coalesce(F.col("_t"), F.lit("")) == ""
    shape = (
        F.when(empty, "empty_line").when(F.col("_v").isNull(), "json_parse_error").when(~F.col("_kind").startswith("OBJECT"), "top_level_not_object").when(F.col("_kts") == "NONE", "missing_top_ts").when(F.col("_kf") == "NONE", "missing_top_flow")
        .when(F.col("_kts") != "BIGINT", "ts_not_int").when(~F.col("_kf").startswith("OBJECT"), "flow_not_object")
    )
    missing = [F.when(F.col(f"k_{c}") == "NONE", F.lit(f"missing_flow_{c}")) for c in NUMERIC + BOOLEAN]
    any_missing = reduce(lambda a, b: a | b, [F.col(f"k_{c}") == "NONE" for c in NUMERIC + BOOLEAN])
    is_num = lambda c: F.col(f"k_{c}").rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    total = F.col("buy_volume") + F.col("sell_volume")
    content = [F.when(~is_num(c), F.lit(f"non_numeric_{c}")) for c in NUMERIC] + [F.when(F.col(f"k_{c}") != "BOOLEAN", F.lit(f"{c}_not_bool")) for c in BOOLEAN] + [
        F.when(F.col("timestamp") != F.col("ts").cast("double"), F.lit("flow_timestamp_mismatch_top_ts")), F.when(F.col("price") <= 0, F.lit("price_non_positive")),
        F.when((F.col("buy_volume") < 0) | (F.col("sell_volume") < 0), F.lit("negative_volume")), F.when(F.col("price_range") < 0, F.lit("negative_price_range")),
        F.when(F.abs("pressure") > 1.000001, F.lit("pressure_out_of_bounds")), F.when(total <= 0, F.lit("non_positive_total_volume")),
        F.when((total > 0) & (F.abs(F.try_divide("window_cum_delta", total) - F.col("pressure")) > 2e-6), F.lit("pressure_formula_mismatch")), F.when(~F.col("b_warm"), F.lit("warm_false_in_saved_file")),
    ]
    rules = F.when(shape.isNotNull(), F.array(shape)).when(any_missing, F.array(*missing)).otherwise(F.array(*content))
    hits = d.select("line_no", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("count"))
    # A rank limit is applied before the shuffle as well, so a rule broken by any number of lines sends a few per task.
    first = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("rule").orderBy("line_no"))).filter(F.col("_rn") <= examples)
    first = first.groupBy("rule").agg(F.sort_array(F.collect_list("line_no")).alias("first_lines"))
    return counts.join(first, "rule")


def field_histogram(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """How often each field of the flow object (or of the top level where there is none) occurs, by JSON type: integer, decimal, text, boolean, list, object, null."""
    v = F.try_parse_json(F.col(text))
    d = lines.select(F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("_v")).filter("_v is not null")
    flow = F.try_variant_get("_v", "$.flow", "variant")
    body = F.when(F.coalesce(F.schema_of_variant(flow), F.lit("")).startswith("OBJECT"), flow).otherwise(F.col("_v"))
    t = F.regexp_replace(F.schema_of_variant("x"), "[<(].*$", "")
    whole = F.schema_of_variant("x").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    kind = F.when(whole, "integer").when(t.isin("DECIMAL", "DOUBLE", "FLOAT"), "decimal").when(t == "STRING", "text").when(t == "BOOLEAN", "boolean").when(t == "ARRAY", "list").when(t == "OBJECT", "object").otherwise("null")
    e = d.select(body.alias("_b")).select(F.explode(F.expr("cast(_b as map<string, variant>)")).alias("field", "x"))
    return e.groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
