"""Readers of trade and order-book tapes, calendars and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tape_lines import SPLIT_BYTES, register

ALL_KINDS = ("contract", "trade", "add", "reduce", "set")
#: Numbers of book and contract rows: whole, and with a fraction or an exponent; values that are no number are let through
#: for contracts. Nothing may stand around them.
_WHOLE, _NUMBER, _ANY = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: Trade rows are read from left to right: digits as far as they go, then a comma if there is one. Nothing is tried twice.
_DIGITS, _DECIMAL = "-?+[0-9]++", r"-?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)"
_TRADE = f"^T,({_DIGITS}),?+[^,]*+,?+({_DECIMAL}),?+({_DECIMAL}),?+({_DIGITS})?+"


def events_of_lines(lines: DataFrame, symbol: str, buy_aggressor_code: int = 2, bid_book_code: int = 1) -> DataFrame:
    """Events of a tape's lines (seq, kind, value).

    Rows: ``c,ts,0,exchange,symbol,type,tick,multiplier,n``; ``T,ts,id,price,size,side``; ``A|R,ts,id,price,size,side``
    and ``r,ts,id,side,price,size``. A trade or change whose side is missing or another code is a sell. Rows that do not
    parse, and prices and sizes that are not finite, are left out; so are sizes below zero. A contract's time is not
    needed; a multiplier must be there and is 1 if it doesn't parse.
    """
    is_set, is_contract, is_trade = F.col("kind") == "set", F.col("kind") == "contract", F.col("kind") == "trade"
    f = F.split("value", ",")
    at = lambda i, rule, t: F.when(F.get("f", F.lit(i)).rlike(rule), F.get("f", F.lit(i)).try_cast(t))
    trade = lambda i, t: F.nullif(F.regexp_extract("value", _TRADE, i), F.lit("")).try_cast(t)
    whole, number = lambda i: at(i, _WHOLE, "long"), lambda i: at(i, _NUMBER, "double")
    code = F.when(is_set, whole(3)).when(is_trade, F.coalesce(trade(4, "long"), F.lit(0))).otherwise(F.coalesce(whole(5), F.lit(0)))
    buy = F.when(is_set, code == bid_book_code).otherwise(code == buy_aggressor_code)
    out = lines.select("seq", "kind", "value", f.alias("f")).select(
        F.lit(symbol).alias("symbol"), "seq", "kind", F.when(is_trade, trade(1, "long")).otherwise(whole(1)).alias("ts_ns"),
        F.when(is_trade, trade(2, "double")).when(is_set, number(4)).when(~is_contract, number(3)).alias("price"),
        F.when(is_trade, trade(3, "double")).when(is_set, number(5)).when(~is_contract, number(4)).alias("size"),
        F.when(~is_contract, F.when(buy, 1).otherwise(-1)).cast("tinyint").alias("side"),
        F.when(is_contract, at(6, _ANY, "double")).alias("tick_size"),
        F.when(is_contract & (F.size("f") > 7), F.coalesce(at(7, _ANY, "double"), F.lit(1.0))).alias("multiplier"),
        F.when(is_set, code.isNotNull()).otherwise(F.lit(True)).alias("sided"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.col("ts_ns").isNotNull() & finite("price") & finite("size") & (F.col("size") >= 0) & F.col("sided")
    good = F.when(is_contract, F.col("tick_size").isNotNull() & F.col("multiplier").isNotNull()).otherwise(good)
    return out.where(good).drop("sided")


def read_text_tape(spark: SparkSession, path: str, symbol: str, kinds: tuple[str, ...] = ALL_KINDS, buy_aggressor_code: int = 2, bid_book_code: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Events of a comma-separated tape, a file or a folder of files, as ``events_of_lines`` reads its rows.

    One scan of byte ranges (``tape_lines``); kinds that are not asked for do not leave the reader. ``seq`` grows with the
    lines, and with the files by name; it is unique but has gaps.
    """
    register(spark)
    lines = spark.read.format("tape_lines").option("path", path).option("splitBytes", split_bytes).option("kinds", ",".join(kinds)).load()
    return events_of_lines(lines, symbol, buy_aggressor_code, bid_book_code)


def stream_text_tape(spark: SparkSession, path: str, symbol: str, buy_aggressor_code: int = 2, bid_book_code: int = 1) -> DataFrame:
    """The same from a folder whose files grow; only whole lines are read, each once, also over restarts."""
    register(spark)
    return events_of_lines(spark.readStream.format("tape_lines").option("path", path).load(), symbol, buy_aggressor_code, bid_book_code)


def from_events(events: DataFrame, symbols: int = 8) -> DataFrame:
    """A trade tape from the ``events`` table: value is the price, the count in props the size, two event types buy."""
    ns = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    return events.select(
        F.concat(F.lit("U"), (F.col("user_id") % symbols).cast("string")).alias("symbol"), F.col("event_id").alias("seq"), F.lit("trade").alias("kind"), ns.alias("ts_ns"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"), F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1).cast("int").alias("side"),
    )


def book_from_events(events: DataFrame, symbols: int = 8) -> DataFrame:
    """Order-book rows from the same table: one event in seven sets a level, of the others refunds and errors reduce."""
    tape = from_events(events, symbols)
    kind = F.when(F.col("seq") % 7 == 0, "set").when(F.col("seq") % 3 == 0, "reduce").otherwise("add")
    return tape.withColumn("kind", kind)


def interest(tape: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events of the given kinds; on a tape stored by kind the other files are not read."""
    return tape.where(F.col("kind").isin(*kinds))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A calendar in JSON (date, impact, country, title, forecast, previous, actual) with ``ts_ns``.

    A date has an offset or Z; without one the row has no time and is left out. Fractions of a second are dropped.
    """
    schema = "date string, impact string, country string, title string, forecast string, previous string, actual string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    zoned = F.col("date").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    second = F.unix_seconds(F.try_to_timestamp(F.regexp_replace("date", r"\.\d+", "")))
    return rows.withColumn("ts_ns", F.when(zoned, second * 1_000_000_000)).where("ts_ns is not null")


def impact_of_importance(importance: Column) -> Column:
    """Impact by a feed's number: 1 and over is High, 0 Medium, less Low."""
    return F.when(importance >= 1, "High").when(importance == 0, "Medium").otherwise("Low")


def write_table(df: DataFrame, path: str) -> None:
    """A dataset as CSV with a header; numbers that are missing or not finite are empty."""
    finite = [F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*finite).write.option("header", True).option("nullValue", "").csv(path)
