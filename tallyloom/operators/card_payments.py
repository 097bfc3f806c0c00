"""Card payments that settle the charges of the days before.

Charges are first added up by card and day, so a busy card costs one row a day. Each day on which the card has a payment looks back over the totals of ``reach`` days; the running sums from the
day itself backwards are all trailing windows, and one that equals a payment of the same card and day is an equi-join on (card, day, sum). Windows hold at
most ``reach + 1`` totals whatever the number of charges; payments that many rows share are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, hot_groups, spread_join
from tallyloom.runtime import materialise


def trailing_windows(charges: DataFrame, keys: Sequence[str], reach: int, on: DataFrame | None = None) -> DataFrame:
    """For each key and day the sums over the days from ``days_back`` before up to it, for each ``days_back`` up to ``reach`` on which there is a charge.

    ``charges``: ``keys``, day (number), cents and tx_id. Result: ``keys``, day, days_back, due (cents), charges (rows) and first_id. Rows with a null in a key, day or amount take no part.
    ``on``: the keys and days that are asked about, if not all up to ``reach`` days after a charge.
    """
    keys = list(keys)
    daily = charges.dropna(subset=[*keys, "day", "cents"]).groupBy(*keys, "day").agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("charges"), F.min("tx_id").alias("first_id")
    )
    if on is None:
        on = daily.select(*keys, F.explode(F.sequence(F.col("day"), F.col("day") + reach)).alias("day"))
    on = on.dropna(subset=[*keys, "day"]).select(*keys, "day").distinct()
    # Totals and the days asked about meet in stretches of ``span`` days of a card; totals near a stretch's end go to the next one too.
    span = 8 * (reach + 1)
    stretch = lambda day: F.floor(day / span)
    totals = daily.select(*keys, F.explode(F.sequence(stretch(F.col("day")), stretch(F.col("day") + reach))).alias("stretch"), "day",
                          F.struct((-F.col("day")).alias("ago"), "cents", "charges", "first_id").alias("total"))
    asked = on.select(*keys, stretch(F.col("day")).alias("stretch"), "day", F.lit(None).cast(totals.schema["total"].dataType).alias("total"))
    # At most ``reach + 1`` totals lie in a frame.
    frame = Window.partitionBy(*keys, "stretch").orderBy("day").rangeBetween(-reach, 0)
    met = totals.union(asked).withColumn("totals", F.collect_list("total").over(frame)).where(F.col("total").isNull())
    met = met.select(*keys, "day", F.array_sort(F.transform("totals", lambda t: F.struct(
        (F.col("day") + t["ago"]).cast("int").alias("days_back"), t["cents"].alias("cents"), t["charges"].alias("charges"), t["first_id"].alias("first_id")
    ))).alias("totals"))

    def so_far(i: Column, field: str) -> Column:
        return F.aggregate(F.slice("totals", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda s, t: s + t[field])

    windows = F.transform("totals", lambda t, i: F.struct(
        t["days_back"].alias("days_back"), so_far(i, "cents").alias("due"), so_far(i, "charges").alias("charges"),
        F.array_min(F.transform(F.slice("totals", F.lit(1), i + 1), lambda x: x["first_id"])).alias("first_id"),
    ))
    return met.select(*keys, "day", F.inline(windows))


def settled_payments(
    payments: DataFrame, charges: DataFrame, keys: Sequence[str], reach: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """Payments that equal a trailing window of their card's charges: ``windows`` (how many do), and ``days_back``, ``charges`` and ``first_id`` of the shortest.

    ``payments``: tx_id, ``keys``, day and cents; ``charges`` as for ``trailing_windows``. ``keys`` name the card and may be empty if all charges are of one.
    """
    at = [*keys, "day", "cents"]
    # Payments are written out, as several steps read them.
    payments = materialise(payments.select("tx_id", *at), "payments")
    counted = payments.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    due = trailing_windows(charges, keys, reach, counted).withColumnRenamed("due", "cents")
    due = due.groupBy(*at).agg(F.count(F.lit(1)).alias("windows"), F.min(F.struct("days_back", "charges", "first_id")).alias("shortest"))
    hot = hot_groups(counted, at, rows="n", share=share, floor=floor)
    return spread_join(payments, due, at, ["tx_id"], hot, how="inner").select("tx_id", *at, "windows", "shortest.*")
