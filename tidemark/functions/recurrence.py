"""Exponential averages e(t) = a x(t) + (1 - a) e(t-1) as joins and windows over time blocks.

Within a block the recurrence is a running sum; a block passes on one number, and the few numbers of a symbol are
folded in order. No task needs more than a block of rows, and the folded arrays have one entry for each block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: rows of a caller's block at most so many
MOST_ROWS = 2_500
#: (1 - a) ** -k stays below e to this power, within the range of doubles
MOST_POWER = 600.0


def ewm(df: DataFrame, averages: dict[str, tuple[str, float]], block: F.Column, key: str = "symbol", time: str = "timestamp") -> DataFrame:
    """df with a column for each of averages: name -> (column, weight a, 0 < a <= 1). The first value is the seed.

    Rows in which one of the columns is NULL are left out. Blocks are parted further where a weight is so large that
    its powers would overflow within them. The average before the first row counts as the first value, which gives
    that value back; so the seed comes with the first block and needs no pass of its own.
    """
    names = list(averages)
    df = df.dropna(subset=sorted({col for col, _ in averages.values()}))
    most = min(int(MOST_POWER / -math.log(1 - a)) if a < 1 else 1 for _, a in averages.values())
    own = W.partitionBy(key, "_b").orderBy(time)
    base = df.withColumn("_b", block).withColumn("_k", F.row_number().over(own) - 1)
    if most < MOST_ROWS:
        base = base.withColumn("_b", F.struct("_b", F.floor(F.col("_k") / most).alias("part"))).withColumn("_k", F.pmod("_k", F.lit(most)))
    for n in names:
        col, a = averages[n]
        q = F.lit(1.0 - a)
        base = base.withColumn(f"_l_{n}", F.pow(q, F.col("_k")) * F.sum(F.lit(a) * F.col(col) * F.pow(q, -F.col("_k"))).over(own))
    last = [F.max_by(f"_l_{n}", "_k").alias(n) for n in names]
    seed = F.struct(*[F.min_by(F.col(averages[n][0]).cast("double"), "_k").alias(n) for n in names]).alias("_x")
    blocks = base.groupBy(key, "_b").agg((F.max("_k") + 1).alias("_n"), *last, seed)
    listed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_b", "_n", *names, "_x"))).alias("_s"))
    start = F.element_at("_s", 1)["_x"]
    zero = F.struct(start.alias("c"), F.array().cast(f"array<struct<{', '.join(f'{n}:double' for n in names)}>>").alias("out"))

    def fold(acc, x):
        after = F.struct(*[(F.pow(F.lit(1.0 - averages[n][1]), x["_n"]) * acc["c"][n] + x[n]).alias(n) for n in names])
        return F.struct(after.alias("c"), F.concat(acc["out"], F.array(acc["c"])).alias("out"))

    carried = listed.select(key, "_s", F.aggregate("_s", zero, fold)["out"].alias("_c")).select(key, F.inline(F.arrays_zip("_s", "_c")))
    carry = carried.select(key, F.col("_s._b").alias("_b"), F.col("_c").alias("_c"))
    out = base.join(carry, [key, "_b"])
    shown = [(F.col(f"_l_{n}") + F.pow(F.lit(1.0 - averages[n][1]), F.col("_k") + 1) * F.col(f"_c.{n}")).alias(n) for n in names]
    return out.select(*df.columns, *shown)
