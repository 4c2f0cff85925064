"""Event time, deduplication, bars, indicators and alerts on streams, and the whole pipeline."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.schemas import INTERVALS, TRADES
from tidemark.sources.readers import events_as_trades
from tidemark.sources.writers import in_sequence, publish_folder, publish_topic, to_alerts, to_processed, upsert
from tidemark.streaming.daily import refresh_daily
from tidemark.streaming.ingest import ingest, ingested, state_store

DELAY = "10 minutes"
SUMS = ["trades", "paid", "taken"]
#: so many neighbouring ids are put in order together; rows without an id are dealt over so many groups
IDS_A_GROUP, GROUPS_WITHOUT_ID = 8_192, 1_024


def with_event_time(df: DataFrame, delay: str = DELAY, time: str = "timestamp") -> DataFrame:
    """The time column as a timestamp with a watermark. Rows later than the delay may be dropped by what follows."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _by_time(group: pa.Table) -> pa.Table:
    return group.sort_by([(c, "ascending") for c in ("timestamp", "price", "quantity")])


def dedupe_stream(trades: DataFrame) -> DataFrame:
    """One row for each (symbol, trade_id) within the watermark, the earliest of its batch; rows without a trade_id all pass.

    Rows of an id reach the state in order of their time, from one task, whichever tasks have read them: those of
    neighbouring ids are grouped and sorted in each batch. The source is read once: a row without an id has one of its
    own in the key, until the watermark has passed it.
    """
    block = F.coalesce(F.floor(F.col("trade_id") / IDS_A_GROUP), F.pmod(F.xxhash64("timestamp"), F.lit(GROUPS_WITHOUT_ID)))
    ordered = trades.groupBy("symbol", F.col("trade_id").isNull(), block).applyInArrow(_by_time, trades.schema)  # the schema keeps the watermark
    own = F.when(F.col("trade_id").isNull(), F.expr("uuid()"))
    return ordered.withColumn("_own", own).dropDuplicatesWithinWatermark(["symbol", "trade_id", "_own"]).drop("_own")


def ohlcv_stream(trades: DataFrame, interval: str = "1h", sums: bool = False) -> DataFrame:
    """Bars of closed windows; `end` carries the event time on. sums adds what daily metrics add up."""
    order = F.struct("timestamp", "trade_id")
    taken = F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0))
    more = [F.count(F.lit(1)).alias("trades"), F.sum(F.col("price") * F.col("quantity")).alias("paid"), taken.alias("taken")] if sums else []
    bars = trades.groupBy("symbol", F.window("timestamp", INTERVALS[interval]).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), *more,
    )
    return bars.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", *(SUMS if sums else []), F.window_time("w").alias("end"))


class Indicators(StatefulProcessor):
    """The indicator row of each closed bar. State of a symbol: 20 closes, the previous close, five averages, a count.

    extra: spans of further exponential averages of the close, given as ema_<span>. The state's schema is the same for any
    number of them: a query that is restarted with one more reads the state that it left, and the new average starts at
    the next bar.
    """

    base = "symbol string, timestamp timestamp, rsi_14 double, macd double, macd_signal double, bollinger_upper double, bollinger_lower double, sma_20 double, ema_12 double"

    def __init__(self, extra: tuple[int, ...] = ()):
        self.extra = extra
        self.schema = ", ".join([self.base, *[f"ema_{n} double" for n in extra]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "closes array<double>, averages array<double>, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closes, averages, n = self.state.get() if self.state.exists() else ([], [], 0)
        closes, averages, out = list(closes), list(averages), []
        for row in pd.concat(list(rows)).sort_values("timestamp").itertuples():
            x = row.close
            move = x - closes[-1] if n else 0.0
            up, down = max(move, 0.0), max(-move, 0.0)
            more = [a + 2 / (span + 1) * (x - a) for span, a in zip(self.extra, averages[5:])]
            more += [x] * (len(self.extra) - len(more))
            if n:
                fast, slow, signal, gain, loss = averages[:5]
                fast, slow = fast + 2 / 13 * (x - fast), slow + 2 / 27 * (x - slow)
                averages = [fast, slow, signal + 0.2 * (fast - slow - signal), gain + (up - gain) / 14, loss + (down - loss) / 14, *more]
            else:
                averages = [x, x, 0.0, up, down, *more]
            n, closes = n + 1, [*closes[-19:], x]
            fast, slow, signal, gain, loss = averages[:5]
            mean = dev = None
            if len(closes) == 20:
                mean, dev = float(np.mean(closes)), float(np.std(closes))
            rsi = None if n < 14 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            out.append((key[0], row.timestamp, rsi, fast - slow, signal, None if mean is None else mean + 2 * dev, None if mean is None else mean - 2 * dev, mean, fast, *more))
        self.state.update((closes, averages, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")])

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """Price and volume alerts of closed bars. State of a symbol: the last close, 20 log returns, 20 volumes."""

    schema = "symbol string, detected_at timestamp, kind string, value double, score double, threshold double"

    def __init__(self, n: int = 20, k: float = 3.0, interval: str = "1h"):
        self.n, self.k, self.step = n, k, pd.Timedelta(INTERVALS[interval])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "close double, returns array<double>, volumes array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, returns, volumes = self.state.get() if self.state.exists() else (None, [], [])
        returns, volumes, out = list(returns), list(volumes), []
        for row in pd.concat(list(rows)).sort_values("timestamp").itertuples():
            move = float(np.log(row.close / before)) if before is not None and before > 0 and row.close > 0 else None
            for kind, value, past in (("price", move, returns), ("volume", row.volume, volumes)):
                seen = [v for v in past if v is not None]
                if value is not None and len(seen) == self.n and np.std(seen) > 0:
                    score = float((value - np.mean(seen)) / np.std(seen))
                    if abs(score) >= self.k:
                        out.append((key[0], row.timestamp + self.step, kind, value, score, self.k))
            before, returns, volumes = row.close, [*returns, move][-self.n :], [*volumes, row.volume][-self.n :]
        self.state.update((before, returns, volumes))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")])

    def close(self) -> None:
        pass


def indicators_stream(bars: DataFrame, extra: tuple[int, ...] = ()) -> DataFrame:
    """The indicator row of each bar; extra as in Indicators."""
    processor = Indicators(extra)
    return bars.groupBy("symbol").transformWithStateInPandas(processor, processor.schema, "Append", "None")


def alerts_stream(bars: DataFrame, n: int = 20, k: float = 3.0, interval: str = "1h") -> DataFrame:
    return bars.groupBy("symbol").transformWithStateInPandas(Alerts(n, k, interval), Alerts.schema, "Append", "None")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all input there is now, written as Parquet and read back. A repeated call resumes."""
    spark = stream.sparkSession
    with state_store(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def plain_trade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of trades, without a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return events_as_trades(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def trade_stream(spark: SparkSession, sf_dir: str, delay: str = DELAY) -> DataFrame:
    """The event table as a stream of trades with event time."""
    return with_event_time(plain_trade_stream(spark, sf_dir), delay)


def run_pipeline(source: DataFrame, folder: str, interval: str = "1h", servers: str | None = None, delay: str = DELAY) -> None:
    """Sort out, deduplicate, build bars, keep tables under folder, and publish.

    source: a stream of messages with a column `value`, or of trades. Its valid rows go to folder/raw_trades and all
    others, with their reasons, to folder/rejects. The bars of closed windows are built once from the valid rows,
    appended to folder/bars, and read from there as a stream by the queries of the tables ohlcv, indicators, anomalies and
    daily_metrics; of the last only the days that a batch changes are made anew. Each query has its own checkpoint, so a stopped run resumes where it was; a batch that is repeated after a
    failure changes nothing, because it is kept once by its number or merged by the table's keys. Indicators go to the
    topic processed_data and alerts to the topic anomalies: of the broker at servers, at least once, or else to
    folder/topics, where a repeated batch replaces its own lines. Each message carries its batch and number, by which a
    consumer knows a repeat.
    """
    spark = source.sparkSession
    ingest(source, folder, TRADES)
    built = ohlcv_stream(dedupe_stream(with_event_time(ingested(spark, folder, TRADES, stream=True), delay)), interval, sums=True)

    def start(writer: DataStreamWriter, name: str) -> StreamingQuery:
        return writer.option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()

    with state_store(spark):
        start(built.writeStream.format("parquet").option("path", f"{folder}/bars"), "bars").awaitTermination()
        bars = spark.readStream.schema(built.schema).parquet(f"{folder}/bars")
        keys, parts = ["symbol", "interval", "timestamp"], ["interval", "date"]
        tables = {
            "ohlcv": (bars.drop("end", *SUMS), keys, "timestamp", parts, None, None),
            "indicators": (indicators_stream(bars).withColumn("interval", F.lit(interval)), keys, "timestamp", parts, "processed_data", lambda df: to_processed(df, "indicators")),
            "anomalies": (alerts_stream(bars, interval=interval), ["symbol", "kind", "detected_at"], "detected_at", ["date"], "anomalies", to_alerts),
        }

        def sink(name: str, keys: list[str], time: str, parts: list[str], topic: str | None, messages):
            def merge(batch: DataFrame, number: int) -> None:
                batch = batch.persist()  # used more than once; a second computation would run the state again
                upsert(batch, f"{folder}/{name}", keys, time, parts)
                if topic and servers:
                    publish_topic(in_sequence(messages(batch), number), servers, topic)
                elif topic:
                    publish_folder(in_sequence(messages(batch), number), f"{folder}/topics", topic, number)
                batch.unpersist()

            return merge

        running = [start(df.writeStream.foreachBatch(sink(name, *rest)), name) for name, (df, *rest) in tables.items()]
        running.append(start(bars.writeStream.foreachBatch(lambda batch, _: refresh_daily(batch.drop("end", "interval"), folder)), "daily_metrics"))
        for q in running:
            q.awaitTermination()
