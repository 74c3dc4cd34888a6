"""Row numbers of groups of any size: one global order, cut by range, so that a group that holds most rows is nobody's alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

c = F.col


def row_before(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the group, null in the first one: ``lag`` for groups of any size."""
    numbered = row_numbers(df, keys, order, "_n", "_size")
    earlier = numbered.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], (c("_n") + 1).alias("_next"), c(value).alias(name))
    same = c("_n") == c("_next")
    for i, k in enumerate(keys):
        same &= c(k).eqNullSafe(c(f"_k{i}"))
    return numbered.join(earlier, same, "left").select(*df.columns, name)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "number", size: str = "size") -> DataFrame:
    """Adds each row's number in its group, from 1, and the group's size. Equal rows are numbered in any order.

    The place in the whole order less the place where the group's rows begin in the same range, and the group's rows in the ranges
    before; the latter is a sum over at most as many pieces as there are ranges.
    """
    by = [*map(c, keys), *order, c("_tie")]  # a tie longer than a range is split too
    ordered = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = written(ordered.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_place", 33))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_here").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_here")).select(
        *[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], c("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_here").over(whole).alias(size)
    )
    same = c("_part") == c("_p")
    for i, k in enumerate(keys):
        same &= c(k).eqNullSafe(c(f"_k{i}"))
    return placed.join(pieces, same).withColumn(name, c("_before") + c("_place") - c("_first") + 1).select(*df.columns, name, size)
