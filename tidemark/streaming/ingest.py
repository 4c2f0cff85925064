"""Messages or typed rows of a stream, sorted out into a table of valid rows and one of rejects."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import validate
from tidemark.schemas import Table
from tidemark.sources.readers import sort_out
from tidemark.sources.writers import MICROS, make_folder, publish_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REJECTS = "value string, reasons array<string>"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Stateful queries that start within keep their state in RocksDB; the session's setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def valid_and_rejects(rows: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """(rows of the table, rejects as value and reasons) of messages in a column `value`, or of rows with the table's columns."""
    if "value" in rows.columns and not set(table.required) & set(rows.columns):
        return sort_out(rows, table)
    ok, bad = validate(rows, table)
    known = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.types.items()]
    as_text = F.to_json(F.struct(*rows.columns), {"timestampFormat": MICROS, "timestampNTZFormat": MICROS})
    return ok.select(*known), bad.select(as_text.alias("value"), "reasons")


def ingest(stream: DataFrame, folder: str, table: Table) -> None:
    """All input there is now into folder/<table name> and folder/rejects, each with a folder for each batch.

    Nothing is lost: a row is in one of the two tables. A batch that is repeated after a failure changes nothing. Both
    tables are there, if empty, when the call ends; a repeated call goes on where the one before ended.
    """
    spark = stream.sparkSession
    for name in (table.name, "rejects"):
        make_folder(spark, f"{folder}/{name}")

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the source is read once for both tables
        ok, bad = valid_and_rejects(batch, table)
        publish_table(bad, f"{folder}/rejects", number)
        publish_table(ok, f"{folder}/{table.name}", number)
        batch.unpersist()

    stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint-{table.name}").trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, folder: str, table: Table, stream: bool = False) -> DataFrame:
    """The valid rows that ingest() wrote, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(table.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{table.name}")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """value, reasons and batch of all rows that ingest() set aside."""
    return spark.read.schema(f"{REJECTS}, batch int").parquet(f"{folder}/rejects")
