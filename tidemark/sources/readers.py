"""Trades and klines from Parquet, JSON lines or a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import validate
from tidemark.schemas import OHLCV, TRADES, Table


def _parsed(values: DataFrame, types: dict[str, str], column: str, *kept: F.Column) -> DataFrame:
    """Fields of JSON texts, with `_corrupt`: a text that does not parse whole, a null or blank one as it is or empty."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in types.items())}, `_corrupt` string"
    parsed = F.from_json(F.col(column).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    blank = F.when(text.rlike(r"^\s*$"), text)  # gives a NULL row and no corrupt record
    return values.select(parsed.alias("v"), blank.alias("blank"), *kept).select(*[f"v.{c}" for c in types], F.coalesce("v._corrupt", "blank").alias("_corrupt"), *[c for c in ("_text",) if kept])


def decode(values: DataFrame, table: Table, column: str = "value") -> DataFrame:
    """JSON texts as typed rows of the table; a text that does not parse is kept in `_corrupt`, a null one as empty."""
    return _parsed(values, table.types, column)


def sort_out(values: DataFrame, table: Table, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): messages that are valid rows of the table, and the others as value and reasons.

    The fields are read as texts first, so a field of a wrong type is told apart from a text that does not parse
    (`malformed`). A null message is rejected with an empty value.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_text")
    ok, bad = validate(_parsed(values, dict.fromkeys(table.types, "string"), column, text), table, F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("malformed"))))
    return ok.select(*table.types), bad.select(F.col("_text").alias("value"), "reasons")


def read_messages(values: DataFrame, table: Table, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): texts that parse as rows of the table, and the others in the one column `_corrupt`."""
    both = decode(values, table, column)
    return both.filter("_corrupt is null").drop("_corrupt"), both.filter("_corrupt is not null").select("_corrupt")


def first_sent(messages: DataFrame) -> DataFrame:
    """key, value, batch, number of messages in sequence, each once however often it was sent."""
    return messages.dropDuplicates(["key", "batch", "number"])


def read_topic(spark: SparkSession, servers: str, topic: str, table: Table, stream: bool = True) -> DataFrame:
    """A topic's messages; needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return decode(reader.load(), table)


def topic_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic's messages as a stream of values, not decoded; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select("value")


def read_table(spark: SparkSession, path: str, table: Table, stream: bool = False) -> DataFrame:
    """A folder of Parquet files with the table's schema; columns that a file lacks are null."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(table.schema).parquet(path)


def read_trades(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return read_table(spark, path, TRADES, stream)


def read_klines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return read_table(spark, path, OHLCV, stream)


def events_as_trades(events: DataFrame) -> DataFrame:
    """The event table seen as trades: type as symbol, value as price, the number k of props as quantity."""
    return events.select(
        F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.col("ts").alias("timestamp"), F.col("event_id").alias("trade_id"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"),
    )
