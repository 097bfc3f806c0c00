"""Balances: running balance, reconciliation and discrepancy detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, Running, hot_groups, running, spread_join
from tallyloom.operators.summaries import expenses, income, sum_by

TOLERANCE = 0.01
LARGE_AMOUNT = 10_000


def signed_amount(amount: str = "amount", kind: str = "type") -> Column:
    """Income adds, expense subtracts, transfers and unknown types leave the balance alone."""
    value = F.col(amount)
    return F.when(F.col(kind) == "income", value).when(F.col(kind) == "expense", -value).otherwise(
        F.lit(0).cast("decimal(18,2)")
    )


def running_balance(
    df: DataFrame,
    start: float | Column = 0,
    account: str | None = "account_id",
    order: tuple[str, str] = ("date", "tx_id"),
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    opening = start if isinstance(start, Column) else F.lit(start).cast("decimal(18,2)")
    moved = running(
        df,
        [account] if account else [],
        list(order),
        [Running("_moved", "sum", signed_amount())],
        share=share,
        floor=floor,
    )
    return moved.withColumn("balance", opening + F.col("_moved")).drop("_moved")


def sum_by_type(df: DataFrame) -> DataFrame:
    return sum_by(df, "type", "amount")


def net_cashflow(df: DataFrame) -> DataFrame:
    return df.agg((income() - expenses()).alias("net"))


def final_balance(df: DataFrame, start: float = 0, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        (F.lit(start).cast("decimal(18,2)") + F.sum(signed_amount())).alias("final_balance")
    )


def reconcile(df: DataFrame, targets: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Calculated against expected balance for every group at once.

    ``targets`` holds ``by`` plus starting_balance and ending_balance, one row per group; a
    group without a target is held against zero.
    """
    moved = df.groupBy(*by).agg(F.sum(signed_amount()).alias("_moved"), F.count(F.lit(1)).alias("rows"))
    joined = moved.join(targets, by, "left")
    zero = F.lit(0).cast("decimal(18,2)")
    calculated = F.coalesce("starting_balance", zero) + F.col("_moved")
    expected = F.coalesce("ending_balance", zero)
    return joined.select(
        *by,
        "rows",
        calculated.alias("calculated"),
        expected.alias("expected"),
        (calculated - expected).alias("difference"),
        (F.abs(calculated - expected) <= F.lit(tolerance).cast("decimal(18,6)")).alias("reconciled"),
    )


def reconcile_all(df: DataFrame, start: float, end: float, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for the whole ledger."""
    calculated = F.lit(start).cast("decimal(18,2)") + F.coalesce(F.sum(signed_amount()), F.lit(0))
    expected = F.lit(end).cast("decimal(18,2)")
    return df.agg(F.count(F.lit(1)).alias("rows"), calculated.alias("calculated")).select(
        "rows",
        "calculated",
        expected.alias("expected"),
        (F.col("calculated") - expected).alias("difference"),
        (F.abs(F.col("calculated") - expected) <= F.lit(tolerance).cast("decimal(18,6)")).alias("reconciled"),
    )


def verify_balance(reconciled: DataFrame) -> DataFrame:
    """Stop the job when a row does not reconcile."""
    message = F.concat(F.lit("balance differs by "), F.col("difference").cast("string"))
    checked = F.when(F.col("reconciled"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return reconciled.withColumn("reconciled", checked)


def reconcile_period(
    df: DataFrame, first: str, last: str, targets: DataFrame, by: list[str], tolerance: float = TOLERANCE
) -> DataFrame:
    """Both ends of the period belong to it."""
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return reconcile(df.where(inside), targets, by, tolerance)


def find_discrepancies(df: DataFrame, large: float = LARGE_AMOUNT) -> DataFrame:
    """One row per transaction and issue: missing type, large amount, same day and amount."""
    groups = (
        df.groupBy("date", "amount").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    )
    hot = hot_groups(groups, ["date", "amount"], rows="_rows")
    marked = spread_join(df, groups, ["date", "amount"], ["tx_id"], hot)
    issues = F.array_compact(
        F.array(
            F.when(F.col("type").isNull(), F.lit("missing-type")),
            F.when(F.col("amount") > F.lit(large), F.lit("large-amount")),
            F.when(F.col("_rows") > 1, F.lit("potential-duplicate")),
        )
    )
    return marked.select("tx_id", "date", "amount", "type", F.explode(issues).alias("issue"))


def reconciliation_report(
    df: DataFrame, account_targets: DataFrame, currency_targets: DataFrame, start: float = 0, end: float = 0
) -> dict[str, DataFrame]:
    return {
        "summary": reconcile_all(df, start, end),
        "by_account": reconcile(df, account_targets, ["account_id"]),
        "by_currency": reconcile(df, currency_targets, ["currency"]),
        "discrepancies": find_discrepancies(df),
    }
