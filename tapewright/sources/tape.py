"""Trade tapes: the canonical schema, time-window scans, readers of parquet, JSON lines and CSV, and adapters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.common import require_columns, with_positions

#: A canonical tape: ``seq`` is the order of arrival and breaks ties of ``timestamp`` (epoch ms).
TRADE_COLUMNS = ["symbol", "seq", "timestamp", "price", "qty", "is_buyer_maker"]
EXCHANGE_JSON = T.StructType([T.StructField("T", T.LongType()), T.StructField("p", T.StringType()), T.StructField("q", T.StringType()), T.StructField("m", T.BooleanType())])
TRADE_CSV = "trade_id long, price double, qty double, quote_qty double, timestamp long, is_buyer_maker string"
AGG_TRADE_CSV = "agg_trade_id long, price double, qty double, first_trade_id long, last_trade_id long, timestamp long, is_buyer_maker string"


def exact_sum(col: Column) -> Column:
    """Sum through decimals with 8 places: the same whatever the order of rows."""
    return F.sum(col.cast("decimal(28,8)")).cast("double")


def to_utc_ms(value: str | dt.datetime) -> int:
    """An instant as epoch milliseconds; one without a zone is an error."""
    t = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    if t.tzinfo is None:
        raise ValueError(f"timestamp without time zone: {value}")
    return int(t.timestamp() * 1000)


def trades_window(trades: DataFrame, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
    """Trades in [start, end). The comparison is on the raw column, so it reaches the scan."""
    a, b = to_utc_ms(start), to_utc_ms(end)
    if b <= a:
        raise ValueError("end must be after start")
    return trades.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b))


def normalize_trades(df: DataFrame) -> DataFrame:
    """Canonical types; a value that can't be cast is an error, as ANSI casts are."""
    require_columns(df, ["timestamp", "price", "qty", "is_buyer_maker"])
    extra = [c for c in ("symbol", "seq") if c in df.columns]
    return df.select(*extra, F.col("timestamp").cast("long").alias("timestamp"), F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), F.col("is_buyer_maker").cast("boolean").alias("is_buyer_maker"))


def read_trades(spark: SparkSession, path: str, symbol: str, start=None, end=None) -> DataFrame:
    """A canonical tape from parquet (.parquet or folder), exchange JSON lines (.jsonl) or CSV (.csv), by suffix.

    Rows without a ``seq`` are numbered in the order of files and of rows in them. JSON that can't be read is an error.
    """
    if path.endswith((".jsonl", ".json")):
        raw = spark.read.schema(EXCHANGE_JSON).json(path, mode="FAILFAST")
        df = in_file_order(raw, "seq").select("seq", F.col("T").alias("timestamp"), F.col("p").cast("double").alias("price"), F.col("q").cast("double").alias("qty"), F.col("m").alias("is_buyer_maker"))
    elif path.endswith(".csv"):
        df = read_trade_csv(spark, path)
    else:
        raw = spark.read.parquet(path)
        df = normalize_trades(raw if "seq" in raw.columns else in_file_order(raw, "seq"))
    df = df.withColumn("symbol", F.lit(symbol))
    df = (df if "seq" in df.columns else in_file_order(df, "seq")).select(*TRADE_COLUMNS)
    return trades_window(df, start, end) if start is not None else df


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, as read from files, with its rows numbered from 0 by (path, place in the file).

    Spark packs splits of files by size, so a row's number in its task says nothing across files: splits are ordered by path and start, rows by their order in the split.
    """
    placed = df.withColumn("_split", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))).withColumn("_row", F.monotonically_increasing_id())
    return with_positions(placed, [], ["_row"], F.col("_split")).withColumnRenamed("_pos", name).drop("_split", "_row", "_bucket", "_before")


def maker_flag(col: Column) -> Column:
    """true/false/1/0 in any letter case; anything else is null (and no trade, rather than a buyer's)."""
    t = F.lower(F.trim(col.cast("string")))
    return F.when(t.isin("true", "1", "t"), F.lit(True)).when(t.isin("false", "0", "f"), F.lit(False))


def read_trade_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless or headed CSV of 6 (trades) or 7 (aggregated trades) columns, comma or semicolon: told from the first line."""
    first = (spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect() or [[""]])[0][0]
    sep = ";" if first.count(";") > first.count(",") else ","
    cells = first.split(sep)
    if len(cells) not in (6, 7):
        raise ValueError(f"expected 6 or 7 columns, found {len(cells)}")
    header = not cells[0].strip().strip('"').lstrip("-").isdigit()
    raw = spark.read.schema(TRADE_CSV if len(cells) == 6 else AGG_TRADE_CSV).csv(path, sep=sep, header=header, mode="PERMISSIVE")
    out = in_file_order(raw, "seq").withColumn("is_buyer_maker", maker_flag(F.col("is_buyer_maker")))
    if len(cells) == 7:
        out = out.withColumn("quote_qty", F.col("price") * F.col("qty"))
    return out.filter(F.col("is_buyer_maker").isNotNull())


def parse_exchange_message(body: Column) -> Column:
    """A trade message {T, p, q, m} as struct(source, type, timestamp, price, quantity, side); null unless price and quantity are above 0."""
    m = F.from_json(body, EXCHANGE_JSON)
    price, qty = m["p"].try_cast("double"), m["q"].try_cast("double")
    event = F.struct(F.lit("binance").alias("source"), F.lit("trade").alias("type"), m["T"].alias("timestamp"), price.alias("price"), qty.alias("quantity"), F.when(m["m"], "sell").otherwise("buy").alias("side"))
    return F.when((price > 0) & (qty > 0), event)


def parse_feature_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(feature tape, statistics) of JSON lines in either shape: {timestamp, price, quantity, side} or {ts, flow: {price, delta}}.

    In the second, quantity is the size of delta and side its sign ('reconstructed'). Lines with a timestamp that is no whole number above 0, a
    price or quantity not above 0, or another side are bad. Statistics: total, parsed, bad, raw, reconstructed. ``keep``: columns of ``lines`` that go along.
    """
    line = F.col(column)
    # One parse a line, values as text; each step is a projection of its own, so that no expression is repeated.
    fields = "timestamp string, price string, quantity string, side string, ts string, flow struct<price: string, delta: string>"
    rows = lines.filter(F.length(F.trim(line)) > 0).select(*keep, F.from_json(line, fields).alias("j"))
    wrapped = F.col("j.flow").isNotNull()
    pick = lambda a, b: F.when(wrapped, F.col(a)).otherwise(F.col(b))
    rows = rows.select(*keep, wrapped.alias("reconstructed"), pick("j.ts", "j.timestamp").alias("t"), pick("j.flow.price", "j.price").alias("p"), pick("j.flow.delta", "j.quantity").alias("q"), F.lower("j.side").alias("s"))
    # A boolean is no number, though it would cast to one.
    number = lambda c: F.when(~F.lower(c).isin("true", "false"), F.col(c).try_cast("double"))
    rows = rows.select(*keep, "reconstructed", number("t").alias("t"), number("p").alias("price"), number("q").alias("q"), "s")
    whole = (F.col("t") > 0) & (F.col("t") % 1 == 0) & (F.col("t") < 9e18)
    rows = rows.select(
        *keep, F.when(whole, F.col("t").cast("long")).alias("timestamp"), "price", F.when(F.col("reconstructed"), F.abs("q")).otherwise(F.col("q")).alias("quantity"),
        F.when(~F.col("reconstructed"), F.col("s")).when(F.col("q") > 0, "buy").when(F.col("q") < 0, "sell").alias("side"), "reconstructed",
    )
    return _good_features(rows)


def side_of(col: Column) -> Column:
    """'buy' or 'sell' from text or a signed number; else null."""
    t = F.lower(F.trim(col.cast("string")))
    n = t.try_cast("double")
    return F.when(t.isin("buy", "sell"), t).when(n > 0, "buy").when(n < 0, "sell")


def read_features(spark: SparkSession, path: str, symbol: str) -> tuple[DataFrame, DataFrame]:
    """(feature tape, statistics) of a source of either kind: JSON lines in both shapes (.jsonl, .json), else parquet files.

    Parquet files hold timestamp, price, quantity or qty, and side (text or a signed number) or is_buyer_maker; columns that some files lack are read as null, and their rows are bad.
    Rows are numbered in file order.
    """
    if path.endswith((".jsonl", ".json")):
        lines = in_file_order(spark.read.text(path), "seq")
        rows, stats = parse_feature_lines(lines, "value", keep=("seq",))
    else:
        raw = in_file_order(spark.read.option("mergeSchema", "true").parquet(path), "seq")
        pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None))
        flag = F.when(maker_flag(pick("is_buyer_maker")), "sell").when(~maker_flag(pick("is_buyer_maker")), "buy")
        side = F.coalesce(side_of(pick("side")), flag) if "side" in raw.columns else flag
        d = raw.select("seq", pick("timestamp").cast("string").try_cast("long").alias("timestamp"), pick("price").cast("string").try_cast("double").alias("price"), pick("quantity", "qty").cast("string").try_cast("double").alias("quantity"), side.alias("side"), F.lit(False).alias("reconstructed"))
        rows, stats = _good_features(d)
    return rows.withColumn("symbol", F.lit(symbol)), stats


def _good_features(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are trades, with their delta; counts of all rows by outcome)."""
    ok = F.coalesce((F.col("timestamp") > 0) & (F.col("price") > 0) & (F.col("quantity") > 0) & ~F.isnan("price") & ~F.isnan("quantity") & F.col("side").isin("buy", "sell"), F.lit(False))
    tape = rows.filter(ok).withColumn("delta", F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")))
    stats = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("bad"), F.count_if(ok & ~F.col("reconstructed")).alias("raw"), F.count_if(ok & F.col("reconstructed")).alias("reconstructed"))
    return tape, stats


def validate_trades(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid trades, counters). Valid: finite price and quantity above 0, a timestamp, a readable maker flag."""
    num = lambda c: F.col(c).try_cast("double")
    fine = lambda c: num(c).isNotNull() & ~F.isnan(num(c)) & (F.abs(num(c)) < float("inf"))
    pos = lambda c: fine(c) & (num(c) > 0)
    ts = F.col("timestamp").try_cast("long")
    flag = maker_flag(F.col("is_buyer_maker"))
    ok = pos("price") & pos("qty") & ts.isNotNull() & flag.isNotNull()
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("valid_rows"), F.count_if(fine("price") & (num("price") <= 0)).alias("non_positive_price"),
        F.count_if(fine("qty") & (num("qty") <= 0)).alias("non_positive_qty"), F.count_if(ts.isNull()).alias("bad_timestamp"), F.count_if(flag.isNull()).alias("bad_flag"),
    )
    return df.filter(ok), counts


def clean_bars(df: DataFrame) -> DataFrame:
    """Daily or intraday bars: the five columns Open, High, Low, Close, Volume (any letter case) in lower case, rows with a null dropped."""
    names = {c.lower(): c for c in df.columns}
    wanted = ["open", "high", "low", "close", "volume"]
    require_columns(df.toDF(*[c.lower() for c in df.columns]), wanted)
    return df.select(*[F.col(names[c]).alias(c) for c in wanted]).dropna()


def session_trades(trades: DataFrame, day: str) -> DataFrame:
    """Trades of a session and of the one before it, by ``session_part`` 'current' and 'previous'; the filter reaches the scan."""
    a, b = session_bounds(day)
    whole = trades.filter((F.col("timestamp") >= a - 86_400_000) & (F.col("timestamp") < b))
    return whole.withColumn("session_part", F.when(F.col("timestamp") >= a, "current").otherwise("previous"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Exported session profiles, one JSON object a line, with ``line_no`` in file order; blank lines are no rows. A line that can't be read is an error."""
    raw = spark.read.json(path, mode="FAILFAST")
    return in_file_order(raw, "line_no").withColumn("session_id", F.col("session_id").cast("string"))


def latest_profiles(profiles: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One profile per session: of several the last in file order."""
    body = F.struct(*[F.col(c) for c in profiles.columns])
    return profiles.groupBy(*keys).agg(F.max_by(body, "line_no").alias("_b")).select("_b.*")


def profile_of(profiles: DataFrame, session: str) -> DataFrame:
    """The first profile of a session, one row. A session without one is an error."""
    found = profiles.filter(F.col("session_id") == session).orderBy("line_no").limit(1)
    if not found.take(1):
        raise ValueError(f"no profile of session {session}")
    return found


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a tape of one symbol."""
    return events_as_tape(spark.read.parquet(f"{sf_dir}/events.parquet"))


def trades_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a tape with heavy ties, one symbol per return flag; ``seq`` is null-free but not unique."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(
        F.concat(F.lit("L"), F.col("l_linestatus")).alias("symbol"), F.col("l_orderkey").alias("seq"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
    )


def feature_tape(trades: DataFrame) -> DataFrame:
    """A canonical tape as input of the event features: signed ``delta``, ``side``, ``quantity``."""
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    return trades.select("symbol", "seq", "timestamp", "price", F.col("qty").alias("quantity"), side.alias("side"), F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")).alias("delta"), F.lit(False).alias("reconstructed"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet file or folder at ``path``. A single file is watched by its name in its folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def events_as_tape(e: DataFrame) -> DataFrame:
    """The event table, still or streaming, as a tape of one symbol."""
    return e.select(
        F.lit("EVT").alias("symbol"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"), F.col("event_type").isin("click", "view").alias("is_buyer_maker"),
    )


def session_id(ts_ms: Column, hour: int = 13, minute: int = 30) -> Column:
    """First day of the 24 h session (UTC) an instant falls in, as text."""
    shift = (hour * 60 + minute) * 60_000
    return F.date_format(F.timestamp_millis(ts_ms - shift), "yyyy-MM-dd")


def session_bounds(day: str, hour: int = 13, minute: int = 30) -> tuple[int, int]:
    """[start, end) of a session in epoch ms; the day as YYYY-MM-DD or DDMMYYYY."""
    d = parse_session_date(day)
    a = int(dt.datetime(d.year, d.month, d.day, hour, minute, tzinfo=dt.timezone.utc).timestamp() * 1000)
    return a, a + 86_400_000


def parse_session_date(value: str) -> dt.date:
    for fmt in ("%Y-%m-%d", "%d%m%Y"):
        try:
            return dt.datetime.strptime(value, fmt).date()
        except ValueError:
            pass
    raise ValueError(f"expected YYYY-MM-DD or DDMMYYYY: {value}")
