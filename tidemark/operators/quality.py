"""Validation against the table schemas, reject reports and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schemas import Table

TEMPORAL = ("timestamp_ntz", "timestamp", "date")


def _accepts(actual: str, wanted: str) -> bool:
    return actual == wanted or (wanted in TEMPORAL and actual in TEMPORAL) or (wanted in ("double", "bigint") and actual in ("tinyint", "smallint", "int", "bigint", "float", "double") and not (wanted == "bigint" and actual in ("float", "double")))


def validate(df: DataFrame, table: Table, before: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with every required field present and every known field of its type.

    A text column is tried as the wanted type. Extra columns are accepted and kept. Rejected rows keep their values
    and have the list `reasons`; where `before` gives a list, that is the reasons.
    """
    kinds, reasons, typed = dict(df.dtypes), [], []
    for c, wanted in table.types.items():
        if c not in kinds:
            if c in table.required:
                reasons.append(F.lit(f"{c}: missing"))
            continue
        if c in table.required:
            reasons.append(F.when(F.col(c).isNull(), F.lit(f"{c}: missing")))
        if not _accepts(kinds[c], wanted):
            reasons.append(F.when(F.col(c).isNotNull() & F.col(c).try_cast(wanted).isNull(), F.lit(f"{c}: type")))
            typed.append(c)
    found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    marked = df.withColumn("reasons", found if before is None else F.coalesce(before, found))
    ok = marked.filter(F.size("reasons") == 0).withColumns({c: F.col(c).try_cast(table.types[c]) for c in typed}).drop("reasons")
    return ok, marked.filter(F.size("reasons") > 0)


def reject_counts(bad: DataFrame, table: Table) -> DataFrame:
    return bad.select(F.lit(table.name).alias("table"), F.explode("reasons").alias("reason")).groupBy("table", "reason").agg(F.count(F.lit(1)).alias("n"))


def dedupe_trades(trades: DataFrame) -> DataFrame:
    """One row for each (symbol, trade_id), the earliest; rows without a trade_id all stay.

    The input is read once: rows without an id have a number of their own in the key, dealt by their values.
    """
    own = F.when(F.col("trade_id").isNull(), F.xxhash64(*[F.col(c) for c in trades.columns]))
    first = W.partitionBy("symbol", "trade_id", "_own").orderBy("timestamp", "price", "quantity")
    ranked = trades.withColumn("_own", own).withColumn("_n", F.row_number().over(first))
    return ranked.filter("_n = 1 or trade_id is null").drop("_n", "_own")
