"""Publishing, idempotent writing and retention."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: the folder of a partition column's null, which is read back as a null
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: JSON times keep microseconds
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def to_messages(df: DataFrame, key: str = "symbol") -> DataFrame:
    """key and JSON value of each row. NULL columns are left out of the JSON, as an absent field."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"timestampFormat": MICROS, "timestampNTZFormat": MICROS}).alias("value"))


def to_processed(df: DataFrame, kind: str) -> DataFrame:
    return to_messages(df.withColumn("kind", F.lit(kind)))


def to_alerts(df: DataFrame) -> DataFrame:
    """Alerts in order of detected_at in one partition, as one broker partition keeps them. Alerts only: few rows.

    They are moved there by a shuffle; what finds the alerts keeps its own tasks.
    """
    return to_messages(df.repartition(1).sortWithinPartitions("detected_at", "symbol", "kind"))


def in_sequence(messages: DataFrame, batch: int) -> DataFrame:
    """messages with batch and number: within a key they rise in the order of the values, which begin with key and time.

    The same batch gives the same numbers, so a consumer knows what is sent again after a failure.
    """
    order = W.partitionBy("key").orderBy("value")  # of one batch
    return messages.withColumns({"batch": F.lit(batch).cast("bigint"), "number": F.row_number().over(order).cast("bigint")})


def publish_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Send messages to a broker's topic; a repeated call sends them again. Needs Spark's Kafka connector.

    batch and number of in_sequence() go as headers.
    """
    if {"batch", "number"} <= set(messages.columns):
        header = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).cast("string").cast("binary").alias("value"))
        messages = messages.select("key", "value", F.array(header("batch"), header("number")).alias("headers"))
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_folder(messages: DataFrame, folder: str, topic: str, batch: int = 0) -> None:
    """Messages as JSON lines in a folder of the topic and batch; a repeated batch replaces itself."""
    messages.write.mode("overwrite").json(f"{folder.rstrip('/')}/{topic}/batch={batch}")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop: Spark has no function of its own to look for and to delete folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def publish_table(df: DataFrame, path: str, batch: int) -> None:
    """df as the folder batch=<number> of the table at path, moved there whole; a batch that is there already stays.

    So a batch that is repeated after a failure changes nothing, and a stream that reads the table sees each file once.
    """
    spark = df.sparkSession
    fs, there = _file_system(spark, f"{path.rstrip('/')}/batch={batch}")
    if fs.exists(there):
        return
    staged = f"{path.rstrip('/')}/_staging-{batch}"  # readers leave out names that begin so
    df.write.mode("overwrite").parquet(staged)
    if not fs.rename(_file_system(spark, staged)[1], there):
        raise OSError(f"{staged} could not be moved to {there}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)


def write_laid_out(df: DataFrame, path: str, parts: Sequence[str], order: Sequence[str], mode: str = "overwrite") -> None:
    """df as Parquet in folders by parts, its rows sorted by order within them.

    Rows are dealt by ranges of all these columns, so a folder with many rows is written by many tasks, each of which
    has a range of the order: readers leave out files, row groups and pages by their least and largest values. The
    columns of parts are kept free of empty texts and from being known as constants, or the write would sort the rows
    once more, by parts alone.
    """
    here = F.spark_partition_id() >= 0
    texts = [c for c in parts if df.schema[c].dataType.typeName() == "string"]
    free = {c: F.when(here, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NO_VALUE))).otherwise(F.lit(NO_VALUE)) for c in texts}
    df = df.withColumns(free | {c: F.when(here, F.col(c)) for c in parts if c not in texts})
    dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str], time: str = "timestamp", parts: Sequence[str] = ("date",)) -> None:
    """Merge df into the table at path by keys, new rows winning; only the folders of parts that df touches are read and rewritten.

    parts are key columns or `date`, the day of the time column. Within a folder rows are sorted by the keys. Repeating
    a call changes nothing. One writer at a time. Within df the last row by its own order of columns wins where a key
    repeats.
    """
    spark = df.sparkSession
    new = df.withColumn("date", F.to_date(time))
    cols = new.columns
    fs, where = _file_system(spark, path)
    both = new.withColumn("_new", F.lit(1))
    if fs.exists(where):
        touched = new.select(*parts).distinct().collect()  # a row a folder that this batch writes
        near = reduce(lambda a, b: a & b, [F.col(p).isin([t[p] for t in touched]) for p in parts])
        here = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(p) == t[p] for p in parts]) for t in touched]) if 0 < len(touched) <= 64 and len(parts) > 1 else F.lit(True)
        old = spark.read.schema(new.schema).parquet(path).filter(near & here)
        both = both.unionByName(old.withColumn("_new", F.lit(0)))
    last = W.partitionBy(*dict.fromkeys([*keys, *parts])).orderBy(F.desc("_new"), *[F.desc(c) for c in cols if c not in keys])
    merged = both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(cols)
    staged = f"{path.rstrip('/')}_staging"
    merged.write.mode("overwrite").parquet(staged)  # the table is both read and written
    write_laid_out(spark.read.schema(new.schema).parquet(staged), path, parts, [k for k in keys if k not in parts])
    fs.delete(_file_system(spark, staged)[1], True)


def retain(df: DataFrame, time: str, interval: str, as_of: F.Column) -> DataFrame:
    """Rows younger than the interval at as_of."""
    return df.filter(F.col(time) > as_of - F.expr(f"INTERVAL {interval}"))


def drop_expired(spark: SparkSession, path: str, interval: str, as_of: dt.datetime) -> list[dt.date]:
    """Delete the date folders of the table at path, also within other folders, in which every row is older than the interval at as_of.

    Returns their dates. No data is read or rewritten; `retain` leaves out the old rows of the day that stays.
    """
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    root = path.rstrip("/")
    found = [f.getPath() for depth in ("", "/*") for f in fs.globStatus(_file_system(spark, f"{root}{depth}/date=*")[1]) or []]
    folders = [(dt.date.fromisoformat(f.getName()[5:]), f) for f in found if re.fullmatch(r"date=\d{4}-\d\d-\d\d", f.getName())]
    oldest = spark.range(1).select((F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")).alias("t")).first().t
    gone = [(d, f) for d, f in folders if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= oldest]
    for _, f in gone:
        fs.delete(f, True)
    return sorted({d for d, _ in gone})
