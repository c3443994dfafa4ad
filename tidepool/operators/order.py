"""Numbers and running sums in an order, without a task that holds all rows.

Rows are dealt to ranges of the order and sorted there; each gets its range and its place in it. That
is written once, below spark.checkpoint.dir, since bounds of ranges come from a sample and ranges are
merged by size: dealt a second time, the same rows may fall into other ranges, and offsets counted on
one dealing don't fit the places of another."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a place within a range, as monotonically_increasing_id has them.
_BITS = 33


def _part() -> Column:
    return F.shiftright("__at", _BITS).alias("__part")


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __at: the number of their range, and in its low bits their place there, from 0."""
    from tidepool.plans.generation import work_dir

    spark = rows.sparkSession
    path = f"{work_dir(spark)}/order-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _ahead(sums: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of all ranges before each one. A row for each range, so it is sent to the rows."""
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(sums.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__ahead_{c}") for c in columns)))


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """rows with their number in an order (distinct values), from `first`."""
    dealt = _dealt(rows, order)
    ahead = _ahead(dealt.groupBy(_part()).agg(F.count("*").alias("n")), ["n"])
    local = F.col("__at").bitwiseAND((1 << _BITS) - 1)
    met = dealt.withColumn("__part", _part()).join(ahead, "__part")
    return met.select(*rows.columns, (F.col("__ahead_n") + local + first).alias(name))


def running(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """rows with columns replaced by their running sums in an order (distinct values)."""
    dealt = _dealt(rows, [order])
    ahead = _ahead(dealt.groupBy(_part()).agg(*(F.sum(c).alias(c) for c in columns)), columns)
    within = W.partitionBy("__part").orderBy("__at")
    met = dealt.withColumn("__part", _part()).join(ahead, "__part")
    sums = {c: F.sum(c).over(within) + F.col(f"__ahead_{c}") for c in columns}
    return met.select(*(sums[c].alias(c) if c in sums else F.col(c) for c in rows.columns))
