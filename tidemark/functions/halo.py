"""Windows over a fixed number of neighbouring rows of a key, without sorting all rows of a key in one task.

Rows get their number within the key from counts of time blocks. They are then dealt to chunks of equal numbers of rows,
and each chunk borrows the last rows of the chunk before and the first of the one after: a halo as wide as the windows
look. A window over a chunk gives its own rows what a window over the whole key would give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: rows of a chunk without its halo
CHUNK = 1_024


def numbered(df: DataFrame, block: Column, key: str = "symbol", time: str = "timestamp", name: str = "_rn") -> DataFrame:
    """df with each row's number within its key by time, from 0. No task sorts more than a block of a key.

    block: a part of the time that grows with it, such as a day. Of rows with equal times any may come first; rows
    without a time come first, as one block.
    """
    based = df.withColumn("_nb", block)
    counts = based.groupBy(key, "_nb").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_nb", "n"))).alias("s"))  # an entry a block

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["total"] + x["n"]).alias("total"), F.concat(acc["out"], F.array(F.struct(x["_nb"].alias("_block"), acc["total"].alias("_from")))).alias("out"))

    kind = dict(counts.dtypes)["_nb"]
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(f"array<struct<_block:{kind},_from:bigint>>").alias("out"))
    starts = listed.select(F.col(key).alias("_key"), F.inline(F.aggregate("s", zero, add)["out"]))
    joined = based.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_nb").eqNullSafe(F.col("_block")))
    own = W.partitionBy(key, "_nb").orderBy(time)
    return joined.withColumn(name, F.col("_from") + F.row_number().over(own) - 1).select(*df.columns, name)


def windowed(rows: DataFrame, *steps: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, key: str = "symbol", chunk: int = CHUNK) -> DataFrame:
    """rows of numbered() with `_chunk` and the columns that each step gives; a step may use those of the steps before.

    A step is given the window: the rows of a key by number. Its frames may look back `before` rows and ahead `after`
    rows at most, all steps in a row together.
    """
    chunk = max(chunk, before, after)
    at, own = F.col("_rn") % chunk, F.floor(F.col("_rn") / chunk)
    places = [own]
    if before:
        places.append(F.when(at >= chunk - before, own + 1))
    if after:
        places.append(F.when((at < after) & (own > 0), own - 1))
    dealt = rows.withColumn("_chunk", F.explode(F.array_compact(F.array(*places))))
    window = W.partitionBy(key, "_chunk").orderBy("_rn")
    for step in steps:
        dealt = dealt.withColumns(step(window))
    return dealt.filter(F.col("_chunk") == own)
