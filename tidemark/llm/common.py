"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of its own in local mode, as in tests."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return folder or sc.getCheckpointDir()


#: Texts reach Python in batches of about so many bytes, so that few are held twice, by Spark and by Python.
BATCH_BYTES = 4 << 20


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within leave no shuffle files when they have ended, and send small batches to Python."""
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: used several times, computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: the folders that stored() has written within cleared()
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def _folders(df: DataFrame) -> set[str]:
    return {folder for f in df.inputFiles() if "/stored-" in (folder := f.rpartition("/")[0])}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() wrote and that nothing needs any more."""
    for df in tables:
        for folder in _folders(df):
            _delete(df.sparkSession, folder)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """The files of all tables that stored() writes within are deleted at the end, but for tables put into the list.

    For work whose result is stored within, too: what is left to compute after the end would miss the files.
    """
    outer, written, kept = _WRITTEN.get(), [], []
    token = _WRITTEN.set(written)
    try:
        yield kept
    finally:
        _WRITTEN.reset(token)
        names = {folder.rpartition("/")[2] for df in kept for folder in _folders(df)}
        for path in written:
            if path.rpartition("/")[2] not in names:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: two columns, a and b, of one comparable type. Returns node, root for every node of an edge,
    root being the least node of its component. A round moves each edge to the least neighbour, so hubs are
    met by grouped minima and an equi-join, never by gathering a neighbourhood.
    """
    work = edges.select("a", "b").filter("a <> b")
    work = stored(work.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, work = work, stored(small.filter("a <> b").distinct())
        dropped(old)
        with tidy(work.sparkSession):
            seen = work.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == before:
            break
        before = (seen.n, seen.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return work.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
