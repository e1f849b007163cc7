"""Gapless positions within groups, however large a group is, and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of sums, its sum over all earlier rows in the order given, 0 for
    the first. The order must leave no ties. Rows are dealt by range and added up in their
    partition; the partitions' totals, a row for each, give what is before it."""
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__of_{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *[F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__of_{k}") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(totals), "__part")
    return found.select(*df.columns, *[(F.col(k) + F.col(f"__of_{k}")).alias(k) for k in sums])


def positions(df: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with `name`: 0, 1, 2, ... within each value of group, in the order given.

    Rows are dealt by range of (group, order) and numbered inside their partition; a
    small table of (partition, group) counts gives the offsets, so no task holds a
    group. Ties are in no certain order, but keep it once numbered: the numbered rows
    are written to the shared folder.
    """
    tied = df.withColumn("__tie", F.rand(7))
    dealt = tied.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    rows = durable(dealt.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", F.col(group).alias("__group"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"))
    same = (rows["__part"] == bases["__part"]) & rows[group].eqNullSafe(bases["__group"])
    return rows.join(bases, same).withColumn(name, F.col("__at") + F.col("__base")).select(*df.columns, name)
