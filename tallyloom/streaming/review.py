"""Review routing and human decisions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.classify import category_of_merchant, keyword_merchant
from tallyloom.operators.review import route
from tallyloom.streaming.imports import idempotent_sink, run_available


def enrich_stream(ledger: DataFrame, merchants: list[str], categories: DataFrame) -> DataFrame:
    """Detected merchant and category with confidences; the category table is static."""
    found = ledger.withColumns(keyword_merchant(ledger["description"], merchants))
    return route(category_of_merchant(found, categories))


def review_sink(approved_path: str, queue_path: str):
    """Send auto-approved rows to the ledger and the others to the review queue."""
    approve, queue = idempotent_sink(approved_path, "tx_id"), idempotent_sink(queue_path, "tx_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        approve(batch.where("review_status = 'auto-approved'"), batch_id)
        queue(batch.where("review_status = 'pending-review'"), batch_id)

    return write


def stream_review(routed: DataFrame, approved_path: str, queue_path: str, checkpoint: str) -> StreamingQuery:
    return run_available(routed, review_sink(approved_path, queue_path), checkpoint, "stream-review")


def stream_decisions(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append human decisions; the state of a transaction is its latest decision."""
    return run_available(decisions, idempotent_sink(path, "decision_id"), checkpoint, "stream-decisions")
