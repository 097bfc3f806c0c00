"""Routing by confidence, the review queue and human decisions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the review routing.
AUTO_APPROVE, REVIEW = 0.90, 0.70


def route(df: DataFrame, merchant: str = "merchant_confidence", category: str = "category_confidence") -> DataFrame:
    """Auto-approved when both confidences reach 0.90, else pending; below 0.70 flagged."""
    weakest = F.least(F.coalesce(merchant, F.lit(0.0)), F.coalesce(category, F.lit(0.0)))
    return df.withColumns(
        {
            "min_confidence": weakest,
            "review_status": F.when(weakest >= AUTO_APPROVE, "auto-approved").otherwise("pending-review"),
            "flagged": weakest < REVIEW,
        }
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per transaction: (tx_id, kind, decided_by, merchant, category, ts, seq)."""
    last = decisions.groupBy("tx_id").agg(
        F.max_by(F.struct("kind", "decided_by", "merchant", "category", "ts"), F.struct("ts", "seq")).alias("d")
    )
    return last.select("tx_id", "d.*")


def apply_decisions(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue state after human decisions: approved, rejected or corrected rows leave it."""
    last = latest_decisions(decisions).select(
        "tx_id",
        F.col("kind").alias("_kind"),
        F.col("decided_by").alias("reviewed_by"),
        F.col("merchant").alias("_merchant"),
        F.col("category").alias("_category"),
    )
    joined = routed.join(last, "tx_id", "left")
    pending = F.col("review_status") == "pending-review"
    corrected = F.col("_kind") == "corrected"
    return joined.withColumns(
        {
            "review_status": F.when(pending & F.col("_kind").isNotNull(), F.col("_kind")).otherwise(
                F.col("review_status")
            ),
            "final_merchant": F.when(corrected, F.coalesce("_merchant", "detected_merchant")).otherwise(
                F.col("detected_merchant")
            ),
            "final_category": F.when(corrected, F.coalesce("_category", "detected_category")).otherwise(
                F.col("detected_category")
            ),
        }
    ).drop("_kind", "_merchant", "_category")


def pending_reviews(state: DataFrame) -> DataFrame:
    return state.where(F.col("review_status") == "pending-review")


def review_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("review_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("flagged").alias("flagged")
    )


def best_classification(classifications: DataFrame) -> DataFrame:
    """One classification per transaction: manual over rule over other, then confidence, then time."""
    rank: Column = (
        F.when(F.col("method") == "manual", 3).when(F.col("method") == "rule", 2).when(F.col("method") == "ml", 1).otherwise(0)
    )
    best = classifications.groupBy("tx_id").agg(
        F.max_by(F.struct(*classifications.columns), F.struct(rank, "confidence", "ts")).alias("c")
    )
    return best.select("c.*")
