"""Places of rows in their groups without a task that sorts a whole group.

The rows are sorted once over all partitions by key and order, so that a hot group lies across many of
them. A row's place is its place among the group's rows of its partition and the number of the group's
rows in the partitions before. Only groups that lie in several partitions have such a number: there is at
most one for each border between partitions, so that table is broadcast whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import durable

PART, AT, BEFORE = "_part", "_at", "_before"


def laid_out(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows sorted by keys and order over all partitions and written, with their partition and their place in it."""
    by = [*(F.col(k) for k in keys), *order]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # The id numbers a partition's rows in the order they lie; the partition is its upper half.
    return durable(laid.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.spark_partition_id()), "ranks")


def pieces(laid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each group that lies in several partitions: partition, and the group's rows in the partitions before."""
    counted = laid.groupBy(*keys, PART).agg(F.count("*").alias("n"))
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn(BEFORE, F.sum("n").over(before)).where(F.col(BEFORE) > 0).drop("n")


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows with their place (from 1) among the rows of equal keys; null keys are equal; ties in any order.

    Keys are named columns; order is columns with their directions.
    """
    laid = laid_out(rows, keys, order)
    own = laid.withColumn(name, F.row_number().over(W.partitionBy(PART, *keys).orderBy(AT)).cast("long"))
    earlier = F.broadcast(pieces(laid, keys).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col(PART).alias("_of"), BEFORE))
    same = F.col(PART) == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    met = own.join(earlier, same, "left").withColumn(name, F.col(name) + F.coalesce(BEFORE, F.lit(0)))
    return met.select(*rows.columns, name)
