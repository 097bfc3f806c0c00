"""Operators over rows in one global order: batches, sliding windows, take-until.

A global order would put all rows into one task. Rows are numbered with the block-wise running
count instead, and grouped by ranges of that number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.skew import Running, running


def number_rows(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """0-based place of each row in the total order."""
    counted = running(df, [], order, [Running(out, "count", F.lit(1))])
    return counted.withColumn(out, F.col(out) - 1)


def row_batches(df: DataFrame, order: Sequence[str], size: int, columns: Sequence[str]) -> DataFrame:
    """Consecutive batches of ``size`` rows; the last may be shorter."""
    placed = number_rows(df, order).withColumn("batch", F.floor(F.col("position") / size))
    return placed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"),
    )


def sliding_windows(
    df: DataFrame, order: Sequence[str], size: int, columns: Sequence[str], chunk: int = 10_000
) -> DataFrame:
    """Every window of ``size`` consecutive rows; partial windows are left out.

    Rows are cut into chunks of the order, each holding also the first ``size - 1`` rows of the
    next, so windows are built within chunks.
    """
    placed = number_rows(df, order)
    home = F.floor(F.col("position") / chunk)
    shared = (home > 0) & (F.pmod("position", F.lit(chunk)) < size - 1)
    copies = F.when(shared, F.array(home, home - 1)).otherwise(F.array(home))
    rows = placed.select("position", *columns, F.explode(copies).alias("chunk"))
    ahead = Window.partitionBy("chunk").orderBy("position").rowsBetween(0, size - 1)
    built = rows.withColumn("items", F.collect_list(F.struct("position", *columns)).over(ahead))
    own = F.col("chunk") == F.floor(F.col("position") / chunk)
    return built.where(own & (F.size("items") == size)).select(F.col("position").alias("start"), "items")


def take_until(df: DataFrame, order: Sequence[str], stop: Column) -> DataFrame:
    """Rows before the first one, in order, for which ``stop`` holds.

    The first stop is a plain minimum, so nothing is sorted.
    """
    place = F.struct(*order)
    first = df.where(stop).agg(F.min(place).alias("p")).scalar()
    return df.where(first.isNull() | (place < first))
