"""Amount anomalies against the history of the same merchant.

Merchant moments are partial aggregates joined back with salting, and the tested row is
taken out of them by arithmetic, so no history is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, hot_groups, spread_join

# Thresholds and confidences of the two detectors.
MIN_HISTORY = 3
POPULATION_LIMIT, SAMPLE_LIMIT = 2.5, 2.0
EXACT = "decimal(28,6)"


def merchant_moments(df: DataFrame, key: str = "merchant", value: str = "amount") -> DataFrame:
    amount, exact = F.col(value).cast("double"), F.col(value).cast(EXACT)
    return df.groupBy(key).agg(
        F.count(amount).alias("_n"),
        F.avg(amount).alias("_mean"),
        F.var_pop(amount).alias("_var"),
        F.sum(exact).alias("_sum"),
        F.min(exact).alias("_min"),
        F.max(exact).alias("_max"),
    )


def _identical(x: Column, n: Column, exclude_self: bool) -> Column:
    """Whether the history is one repeated amount, in exact arithmetic.

    The other rows all equal the maximum just when their sum is their count times it.
    """
    if not exclude_self:
        return F.col("_min") == F.col("_max")
    rest_sum, rest = F.col("_sum") - x.cast(EXACT), (n - 1).cast("decimal(18,0)")
    return (rest_sum == rest * F.col("_max")) | (rest_sum == rest * F.col("_min"))


def zscore_anomalies(
    df: DataFrame,
    key: str = "merchant",
    value: str = "amount",
    mode: str = "population",
    threshold: float | None = None,
    min_history: int = MIN_HISTORY,
    exclude_self: bool = True,
    history: DataFrame | None = None,
    id_column: str = "tx_id",
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Adds history_rows, history_mean, history_std, z_score, is_anomaly, anomaly_score,
    anomaly_confidence and anomaly_reason.

    ``population``: population deviation, limit 2.5, constant history is never anomalous.
    ``sample``: sample deviation, limit 2, constant history makes any other amount anomalous.
    ``history`` holds other rows to compare with; then the row itself is not taken out.
    """
    moments = merchant_moments(history if history is not None else df, key, value)
    if history is not None:
        exclude_self = False
        hot = hot_groups(df.where(F.col(key).isNotNull()), [key], share=share, floor=floor)
    else:
        hot = hot_groups(moments, [key], rows="_n", share=share, floor=floor)
    joined = spread_join(df, moments, [key], [id_column], hot)
    x = F.col(value).cast("double")
    n, mean, m2 = F.coalesce("_n", F.lit(0)), F.col("_mean"), F.col("_var") * F.col("_n")
    if exclude_self:
        rest = n - 1
        rest_mean = F.when(rest > 0, (n * mean - x) / rest)
        rest_m2 = F.greatest(m2 - (x - mean) * (x - rest_mean), F.lit(0.0))
    else:
        rest, rest_mean, rest_m2 = n, mean, m2
    limit = threshold if threshold is not None else (POPULATION_LIMIT if mode == "population" else SAMPLE_LIMIT)
    divisor = rest if mode == "population" else rest - 1
    joined = joined.withColumns({"history_rows": rest.cast("bigint"), "history_mean": rest_mean, "_m2": rest_m2})
    deviation = F.sqrt(F.col("_m2") / F.when(divisor > 0, divisor))
    same = _identical(F.col(value), n, exclude_self)
    joined = joined.withColumn("history_std", F.when(same, F.lit(0.0)).otherwise(deviation))
    enough = F.col("history_rows") >= min_history
    std = F.col("history_std")
    joined = joined.withColumn(
        "z_score", F.when(enough & (std > 0), F.abs((x - F.col("history_mean")) / std))
    )
    z = F.col("z_score")
    over = F.coalesce(z > limit, F.lit(False))
    differs = enough & (std == 0) & (F.col("_min") != F.col("_max"))
    if history is not None or not exclude_self:
        differs = enough & (std == 0) & (F.col(value).cast(EXACT) != F.col("_min"))
    if mode == "population":
        anomalous = over
        score = F.coalesce(z, F.lit(0.0))
        confidence = F.when(~enough, 0.10).when(std == 0, 0.50).otherwise(F.least(F.lit(0.99), 0.5 + z / 10))
    else:
        anomalous = over | differs
        score = F.when(differs, 1.0).otherwise(F.coalesce(F.least(z / 3, F.lit(1.0)), F.lit(0.0)))
        confidence = F.when(~enough, 0.10).otherwise(F.lit(0.90))
    reason = (
        F.when(~enough, "not-enough-history")
        .when((std == 0) & ~anomalous, "identical-history")
        .when(anomalous & (x > F.col("history_mean")), "unusually-high")
        .when(anomalous, "unusually-low")
    )
    return joined.withColumns(
        {
            "is_anomaly": anomalous,
            "anomaly_score": score,
            "anomaly_confidence": confidence,
            "anomaly_reason": reason,
        }
    ).drop("_n", "_mean", "_var", "_m2", "_sum", "_min", "_max")
