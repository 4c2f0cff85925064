"""Alerts are found in many tasks and published by one, in order."""

import re

from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemark.sources import writers


def test_alerts_are_found_in_many_tasks(spark):
    task = F.udf(lambda: TaskContext.get().partitionId(), "int").asNondeterministic()
    df = spark.range(0, 4_000, 1, 4).select(F.lit("A").alias("symbol"), (4_000 - F.col("id")).alias("detected_at"), F.lit("k").alias("kind"), task().alias("task")).filter("detected_at % 100 = 0")
    out = writers.to_alerts(df)
    got = [(int(re.search(r'"detected_at":(\d+)', r.value)[1]), re.search(r'"task":(\d+)', r.value)[1]) for r in out.collect()]
    assert out.rdd.getNumPartitions() == 1 and [at for at, _ in got] == list(range(100, 4_001, 100))
    assert {task for _, task in got} == {"0", "1", "2", "3"}
