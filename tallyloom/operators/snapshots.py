"""State as of any time from a snapshot and the events after it.

The log is stored by day. A snapshot holds the mergeable form of the state at one moment (see ``events.partial_state``), made from the snapshot before it and the events
between. The state at time t is the last snapshot up to t merged with the events from there to t, so a question about any time reads one snapshot and the days of one period.
Events that come late, with a time that a snapshot already covers, drop the snapshots they would change.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.events import (
    DISCREPANCY, DUPLICATE_DETECTED, DUPLICATE_RESOLVED, EVENT_SCHEMA, IMPORTED, LEDGER_FIELDS, MERGING, RECONCILED, append_events, decode, events_by_type, finish_state,
    merge_states, partial_state,
)

DAY_US = 86_400_000_000


def micros(t: str) -> int:
    """Microseconds since 1970 of a UTC time as text."""
    return round(datetime.fromisoformat(t).replace(tzinfo=UTC).timestamp() * 1_000_000)


@dataclass(frozen=True)
class StateStore:
    """Log and snapshots under one folder. ``fields``: what the state of a transaction holds, the same for all snapshots of a folder."""

    root: str
    fields: Mapping[str, str] = field(default_factory=lambda: dict(LEDGER_FIELDS))

    def _fs(self, spark: SparkSession, path: str):
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(spark._jsc.hadoopConfiguration()), made

    def snapshots(self, spark: SparkSession) -> list[int]:
        """Times of the whole snapshots, in microseconds."""
        fs, path = self._fs(spark, f"{self.root}/snapshots")
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = re.fullmatch(r"at=(-?\d+)", status.getPath().getName())
            if name and fs.exists(self._fs(spark, f"{self.root}/snapshots/{name[0]}/_SUCCESS")[1]):
                found.append(int(name[1]))
        return sorted(found)

    def append(self, events: DataFrame) -> int:
        """Append events to the log; snapshots of their time or later are dropped first. Returns how many were."""
        spark = events.sparkSession
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
        first = events.agg(F.min(F.unix_micros("ts")).alias("t")).first()["t"]
        old = [] if first is None else [s for s in self.snapshots(spark) if s >= first]
        for s in old:
            fs, path = self._fs(spark, f"{self.root}/snapshots/at={s}")
            fs.delete(path, True)
        append_events(events, f"{self.root}/log")
        return len(old)

    def events(self, spark: SparkSession, after: int | None = None, until: int | None = None) -> DataFrame:
        """Events later than ``after`` up to ``until``; only the folders of their days are read."""
        root = f"{self.root}/log"
        fs, path = self._fs(spark, root)
        days = []
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = re.fullmatch(r"event_date=(\d{4}-\d\d-\d\d)", status.getPath().getName())
            start = micros(f"{name[1]} 00:00:00") if name else 0
            if name and (after is None or start + DAY_US > after) and (until is None or start <= until):
                days.append(f"{root}/{name[0]}")
        if not days:
            return spark.createDataFrame([], EVENT_SCHEMA)
        log = spark.read.option("basePath", root).parquet(*sorted(days)).drop("event_date")
        if after is not None:
            log = log.where(F.col("ts") > F.timestamp_micros(F.lit(after)))
        return log if until is None else log.where(F.col("ts") <= F.timestamp_micros(F.lit(until)))

    def partial_at(self, spark: SparkSession, at: int) -> DataFrame:
        base = max((s for s in self.snapshots(spark) if s <= at), default=None)
        tail = partial_state(self.events(spark, base, at), self.fields)
        if base is None:
            return tail
        held = spark.read.schema(tail.schema).parquet(f"{self.root}/snapshots/at={base}")
        return merge_states(held.unionByName(tail))

    def snapshot(self, spark: SparkSession, at: str) -> None:
        """Store the state at ``at``; each transaction is read from the snapshot before and the events since."""
        t = micros(at)
        if t not in self.snapshots(spark):
            self.partial_at(spark, t).write.mode("overwrite").parquet(f"{self.root}/snapshots/at={t}")

    def state_at(self, spark: SparkSession, at: str) -> DataFrame:
        """Transactions at a time, as ``events.project_state`` folds them from the whole log."""
        return finish_state(self.partial_at(spark, micros(at)), self.fields)


def whole_state(events: DataFrame) -> dict[str, DataFrame]:
    """What all eight event types fold to: transactions, duplicates found, verdicts (latest first settles), reconciliations and discrepancies.

    Found duplicates, reconciliations and discrepancies are lists that only grow: each event is one entry, in the order of ts and seq. Other event types are ignored.
    """
    verdict = decode(events_by_type(events, DUPLICATE_RESOLVED), "duplicate_id STRING, is_duplicate BOOLEAN")
    money = "calculated DECIMAL(18,2), expected DECIMAL(18,2), difference DECIMAL(18,2), reconciled BOOLEAN"
    entry = lambda kind, schema: decode(events_by_type(events, kind), schema).select("ts", "seq", "aggregate_id", "payload.*")
    return {
        "transactions": finish_state(partial_state(events)),
        "duplicates": entry(DUPLICATE_DETECTED, "original_id STRING, duplicate_id STRING, similarity DOUBLE"),
        "verdicts": verdict.groupBy(F.col("payload.duplicate_id").alias("duplicate_id")).agg(F.max_by("payload.is_duplicate", F.struct("ts", "seq")).alias("is_duplicate"), F.count(F.lit(1)).alias("verdicts")),
        "reconciliations": entry(RECONCILED, money),
        "discrepancies": entry(DISCREPANCY, "issue STRING, amount DECIMAL(18,2)"),
    }


#: Which part of the state an event type changes.
PARTS = {IMPORTED: "transactions", **dict.fromkeys(MERGING, "transactions"), DUPLICATE_DETECTED: "duplicates", DUPLICATE_RESOLVED: "verdicts", RECONCILED: "reconciliations", DISCREPANCY: "discrepancies"}


def state_summary(events: DataFrame) -> DataFrame:
    """Entries of each part of the state and the time of the last event that changed it; a part without entries has a row with 0."""
    part = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    seen = events.withColumn("part", part[F.col("event_type")]).where("part IS NOT NULL")
    # A transaction or a verdict is one entry whatever the number of its events; each other event is one.
    keyed = F.col("part").isin("transactions", "verdicts")
    counted = seen.groupBy("part", F.when(keyed, F.col("aggregate_id")).otherwise(F.xxhash64("seq").cast("string")).alias("entry")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    found = counted.groupBy("part").agg(F.sum(F.when(keyed, 1).otherwise(F.col("n"))).alias("entries"), F.max("ts").alias("changed_at"))
    names = events.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(PARTS.values())], "part string")
    return names.join(F.broadcast(found), "part", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("bigint")))
