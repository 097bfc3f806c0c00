"""Progress of an import as a table, and its start and complete events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tallyloom.operators.events import system_event
from tallyloom.streaming.imports import run_available

# Names of the events around an import.
STARTED, COMPLETED = "import-started", "import-completed"
METRICS = "run string, batch_id long, metric string, value long"


def observed(df: DataFrame, name: str, counters: dict[str, Column] | None = None) -> DataFrame:
    """Rows as they are; each micro-batch reports ``rows`` and the given counters under ``name``."""
    made = {"rows": F.count(F.lit(1)), **(counters or {})}
    return df.observe(name, *[c.cast("bigint").alias(n) for n, c in made.items()])


class MetricsListener(StreamingQueryListener):
    """Collects what ``observed`` reports, one entry for each micro-batch and counter. A micro-batch that is reported again replaces its entries."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.entries: dict[tuple[str, int, str], int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            for metric, value in found.asDict().items():
                self.entries[str(event.progress.runId), event.progress.batchId, metric] = value

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))


def _wait_for(listener: MetricsListener, run: str, seconds: float = 30.0) -> None:
    """Progress is reported behind the query; its end comes last."""
    from time import monotonic, sleep

    end = monotonic() + seconds
    while run not in listener.ended and monotonic() < end:
        sleep(0.05)


def _announce(spark: SparkSession, path: str, name: str, source: str, counts: dict[str, int]) -> None:
    row = spark.createDataFrame([(source, source, *counts.values())], ["aggregate", "file", *counts])
    at = F.lit(datetime.now(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp")
    system_event(row, name, "aggregate", at, ["file", *counts], seq=F.lit(0 if name == STARTED else 1)).write.mode("append").parquet(path)


def run_import(
    df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str, events_path: str, metrics_path: str, source: str, counters: dict[str, Column] | None = None
) -> StreamingQuery:
    """Run a stream over all present input with a start event, a metrics table and a complete event that carries the totals.

    ``metrics_path`` gets run, batch_id, metric and value; a run without input has no rows there, and its totals are 0.
    """
    spark = df.sparkSession
    listener = MetricsListener(name)
    spark.streams.addListener(listener)
    try:
        _announce(spark, events_path, STARTED, source, {})
        query = run_available(observed(df, name, counters), sink, checkpoint, name)
        _wait_for(listener, str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    rows = [(run, batch, metric, value) for (run, batch, metric), value in sorted(listener.entries.items())]
    spark.createDataFrame(rows, METRICS).write.mode("append").parquet(metrics_path)
    totals = {m: sum(r[3] for r in rows if r[2] == m) for m in ["rows", *(counters or {})]}
    _announce(spark, events_path, COMPLETED, source, totals)
    return query


def metric_totals(metrics: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Totals over micro-batches; one that was reported again counts once."""
    once = metrics.groupBy("run", "batch_id", "metric").agg(F.max("value").alias("value"))
    return once.groupBy(*by).agg(F.sum("value").alias("value"), F.countDistinct("run", "batch_id").alias("batches"))
