"""Queries of the corpus operators (problems 7 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.common import materialize
from tapewright.llm.langid import detect, fit_tables, wrong_labels
from tapewright.llm.mixing import mix_sources
from tapewright.llm.packing import container_summary, pack_items
from tapewright.llm.sketch import merge_states, percentiles, rank_error, rank_errors, sketch_states
from tapewright.llm.tokens import with_tokens
from tapewright.plans.registry import Registry, table

REGISTRY = Registry()

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
_P7 = ["volume_50", "range_50"]


def _p7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per (symbol, session), and per symbol (null session) by merging the sessions' states."""
    sessions = sketch_states(table(spark, sf_dir, "event_features"), ["symbol", "session_id"], _P7, row_id="row_id")
    symbols = merge_states(sessions, ["symbol"], _P7)
    a = percentiles(sessions, ["symbol", "session_id"], _P7, QUANTILES)
    return a.unionByName(percentiles(symbols, ["symbol"], _P7, QUANTILES).withColumn("session_id", F.lit(None).cast("string")))


@REGISTRY.query("p7_percentiles")
def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_answers(spark, sf_dir).withColumn("rank_error", F.lit(rank_error()))


_P7_ROWS = "select distinct on (row_id) symbol, session_id, volume_50, range_50 from event_features order by row_id"
_P7_COUNT = "select symbol, {s} as session_id, '{f}' as field, count(*) as n, true as within_bound from r where {f} is not null and not isnan({f}) group by all"


@REGISTRY.query("p7_rank_check", f"with r as ({_P7_ROWS}) " + " union all ".join(_P7_COUNT.format(s=s, f=f) for s in ("session_id", "cast(null as varchar)") for f in _P7))
def p7_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of every symbol and of every session against exact ranks: whether all are within the stated bound."""
    answers = _p7_answers(spark, sf_dir).filter("n > 0")
    df = table(spark, sf_dir, "event_features")
    sessions = rank_errors(df, answers.filter("session_id is not null"), ["symbol", "session_id"], row_id="row_id")
    symbols = rank_errors(df, answers.filter("session_id is null"), ["symbol"], row_id="row_id").withColumn("session_id", F.lit(None).cast("string"))
    # One rank of a group is 1/n of it.
    return sessions.unionByName(symbols).select("symbol", "session_id", "field", "n", (F.col("worst") <= rank_error() + 1 / F.col("n")).alias("within_bound"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted once: written to the shared folder."""
    return materialize(with_tokens(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]), "tokens")


@REGISTRY.query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _sizes(spark, sf_dir).select(F.col("doc_id").alias("item"), "n_tokens")
    return pack_items(items, table(spark, sf_dir, "context_sizes")).withColumnRenamed("item", "doc_id")


@REGISTRY.query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "context_sizes")
    items = _sizes(spark, sf_dir).select(F.col("doc_id").alias("item"), "n_tokens")
    return container_summary(pack_items(items, sizes), sizes)


@REGISTRY.query("p9_copies")
def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, fit_tables(spark, table(spark, sf_dir, "lang_samples"), docs))


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(_detected(spark, sf_dir))


@REGISTRY.query("p10_languages")
def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("doc_id", "line_no", "lang", "confidence")
