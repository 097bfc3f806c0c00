"""Statistics over ledgers and stage outputs. All are partial aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.predicates import confidence_of


def income(amount: str = "amount", kind: str = "type") -> Column:
    return F.sum(F.when(F.col(kind) == "income", F.col(amount)).otherwise(0))


def expenses(amount: str = "amount", kind: str = "type") -> Column:
    return F.sum(F.when(F.col(kind) == "expense", F.col(amount)).otherwise(0))


def counts_by(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows by each dimension on its own, in one scan: (dimension, value, rows)."""
    cells = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions
    ])
    return (
        df.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


def ledger_statistics(df: DataFrame) -> DataFrame:
    level = confidence_of(F.col("confidence"))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        income().alias("income"),
        expenses().alias("expenses"),
        (income() - expenses()).alias("net"),
        F.count_if(level >= 0.9).alias("high_confidence"),
        F.count_if((level >= 0.7) & (level < 0.9)).alias("medium_confidence"),
        F.count_if(level < 0.7).alias("low_confidence"),
        F.count_if(~F.coalesce("verified", F.lit(False))).alias("unverified"),
    )


def monthly_summary(df: DataFrame) -> DataFrame:
    month = F.date_format("date", "yyyy-MM").alias("month")
    return df.groupBy(month).agg(
        income().alias("income"),
        expenses().alias("expenses"),
        (income() - expenses()).alias("net"),
        F.count(F.lit(1)).alias("rows"),
    )


def currency_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("original_currency").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("original_amount").alias("total"),
        F.avg("exchange_rate").alias("avg_rate"),
    )


def sum_by(df: DataFrame, key: str, value: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit(missing)).alias(key)).agg(F.sum(value).alias("total"))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(value).alias("total"),
        F.min(value).alias("smallest"),
        F.max(value).alias("largest"),
    )


def api_stats(df: DataFrame) -> DataFrame:
    """Total, first and last day, and counts by type as columns of one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("income", "expense", "transfer", "unknown")],
    )


def history_stats(df: DataFrame) -> DataFrame:
    flagged = df.withColumns(
        {
            "resolved": F.coalesce("merchant_resolved", F.lit(False)).cast("string"),
            "needs_classification": F.coalesce("needs_classification", F.lit(False)).cast("string"),
        }
    )
    return counts_by(flagged, ["source_file", "type", "resolved", "needs_classification"])


def confidence_distribution(df: DataFrame) -> DataFrame:
    level = confidence_of(F.col("confidence"))
    return df.agg(
        F.count_if(level >= 0.9).alias("high"),
        F.count_if((level >= 0.7) & (level < 0.9)).alias("medium"),
        F.count_if(level < 0.7).alias("low"),
        F.avg(level).alias("average"),
        F.min(level).alias("lowest"),
        F.max(level).alias("highest"),
    )


def type_report(df: DataFrame, examples: int = 2) -> DataFrame:
    """Per type: rows, mean confidence and the first examples by id."""
    from tallyloom.operators.extraction import top_examples

    stats = df.groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence")
    )
    return stats.join(top_examples(df, "type", "description", examples), "type", "left")


def resolution_rates(df: DataFrame, entity_types: Sequence[str]) -> DataFrame:
    """Resolved share per entity type: (entity, resolved, total, rate)."""
    cells = F.array(*[
        F.struct(F.lit(e).alias("entity"), F.coalesce(F.col(f"{e}_resolved"), F.lit(False)).alias("ok"))
        for e in entity_types
    ])
    return df.select(F.inline(cells)).groupBy("entity").agg(
        F.count_if("ok").alias("resolved"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("ok") / F.count(F.lit(1))).alias("rate"),
    )


def run_stats(df: DataFrame) -> DataFrame:
    """Counts of a whole run over the stages."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") != "unknown").alias("typed"),
        F.count_if("merchant_expected").alias("merchant_expected"),
        F.count_if(F.col("counterparty.detected")).alias("counterparty_detected"),
        F.count_if(F.col("clean_merchant").isNotNull()).alias("extracted"),
        F.count_if(F.coalesce("merchant_resolved", F.lit(False))).alias("merchant_resolved"),
    )


def run_breakdowns(df: DataFrame, dimensions: Mapping[str, str], id_column: str = "tx_id", amount: str = "amount") -> DataFrame:
    """Rows, amount, share of all rows and two examples (the smallest and the largest id) for each value of each dimension: entity type, categories, state, match, or whatever columns are given.

    ``dimensions``: the name of each and its column. Null is a value. All dimensions are counted in one pass, by partial aggregates.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("value")) for name, c in dimensions.items()])
    counted = df.select(F.col(id_column).alias("_id"), F.col(amount).alias("_amount"), F.inline(cells)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_amount").alias("amount"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id")
    )
    # One row a dimension.
    totals = counted.groupBy("dimension").agg(F.sum("rows").alias("_all"))
    return counted.join(F.broadcast(totals), "dimension").withColumn("share", F.col("rows") / F.col("_all")).drop("_all")
