"""Running numbers and first rows, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from hedgerow.functions.scratch import stage


def number_rows(
    df: DataFrame, *order: str, column: str = "row_no", start: int = 0, staged: bool = False
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given total order.

    Finding the ranges samples the rows, which would run the work behind them a second time; so they
    are staged first, unless they come from a table (`staged`). Rows are range-partitioned and sorted in parallel and staged, which pins each row to its range.
    The number is the rows of all ranges before plus the place inside the range; only one count
    per range is brought together. `order` has to be total, or equal rows may swap numbers.
    """
    rows = df if staged else stage(df, "unnumbered")
    ranged = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbering",
    )
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # One row per range: never more rows than shuffle partitions.
    return ranged.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_offset") + F.col("_place") + start).alias(column)
    )


def first_per(df: DataFrame, keys, order, carry) -> DataFrame:
    """The first row of each key by `order`, with the `carry` columns.

    A minimum over (order, carry) is combined before the shuffle, so a key that holds a third of
    the rows costs one row per task.
    """
    key_columns = [k if isinstance(k, Column) else F.col(k) for k in keys]
    names = list(dict.fromkeys([*order, *carry]))
    first = F.min(F.struct(*names)).alias("_first")
    return df.groupBy(*key_columns).agg(first).select(
        *keys, *(F.col(f"_first.{name}").alias(name) for name in carry)
    )
