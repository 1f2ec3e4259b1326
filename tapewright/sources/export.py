"""Results as files: JSON lines, CSV with a header, parquet by partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; null fields are written, so that every line has all of them."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A header in every file; arrays and structs as JSON text, as CSV has no nesting."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol", "session_id"), mode: str = "error") -> None:
    """Parquet by folders. Rows meet by folder before they are written, a large folder's in several files (adaptive rebalancing)."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)
