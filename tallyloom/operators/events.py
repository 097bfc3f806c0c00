"""Append-only event log: building events, projecting state, and time travel.

The state of a transaction is a fold over its events. The fold is decomposed into maxima over
(time, seq), one per field, so it is a single partial aggregate and needs neither an ordered
replay nor a gathered group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types that the projection understands, and the other known ones.
IMPORTED = "transaction-imported"
MERGING = ["transaction-classified", "transaction-corrected", "transaction-verified"]
DUPLICATE_DETECTED, DUPLICATE_RESOLVED = "duplicate-detected", "duplicate-resolved"
RECONCILED, DISCREPANCY = "balance-reconciled", "discrepancy-detected"
#: Place of an event among others of the same time, if its maker gives none: the order of a transaction's life.
DEFAULT_SEQ = {name: i for i, name in enumerate([IMPORTED, *MERGING, DUPLICATE_DETECTED, DUPLICATE_RESOLVED, RECONCILED, DISCREPANCY])}
EVENT_SCHEMA = (
    "event_id STRING, seq BIGINT, event_type STRING, aggregate_type STRING, aggregate_id STRING, "
    "ts TIMESTAMP, author STRING, source STRING, data STRING, metadata STRING"
)
LEDGER_FIELDS = {
    "amount": "decimal(18,2)",
    "date": "date",
    "description": "string",
    "type": "string",
    "merchant_id": "string",
    "category_id": "string",
    "confidence": "double",
    "verified": "boolean",
}


def build_events(
    df: DataFrame,
    event_type: str,
    aggregate_id: str,
    ts: Column,
    payload: Sequence[str],
    aggregate_type: str = "transaction",
    author: str = "system",
    source: str = "batch",
    seq: Column | None = None,
) -> DataFrame:
    """Rows as events. Null payload fields are left out, so absence means "not changed".

    ``seq`` orders events of one time; by default an import comes first and a verification after what it verifies.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in payload]))
    number = seq if seq is not None else F.lit(DEFAULT_SEQ.get(event_type, len(DEFAULT_SEQ)))
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), F.col(aggregate_id).cast("string"), ts.cast("string"), body), 256)
        .alias("event_id"),
        number.cast("bigint").alias("seq"),
        F.lit(event_type).alias("event_type"),
        F.lit(aggregate_type).alias("aggregate_type"),
        F.col(aggregate_id).cast("string").alias("aggregate_id"),
        ts.alias("ts"),
        F.lit(author).alias("author"),
        F.lit(source).alias("source"),
        body.alias("data"),
        F.lit("{}").alias("metadata"),
    )


def imported(df: DataFrame, ts: Column, **kw) -> DataFrame:
    fields = [c for c in ("date", "amount", "description", "type", "merchant_id", "category_id", "confidence") if c in df.columns]
    return build_events(df, IMPORTED, "tx_id", ts, fields, **kw)


def classified(df: DataFrame, ts: Column, **kw) -> DataFrame:
    return build_events(df, MERGING[0], "tx_id", ts, ["merchant_id", "category_id", "confidence"], **kw)


def corrected(df: DataFrame, ts: Column, fields: Sequence[str], **kw) -> DataFrame:
    """Only ledger fields are carried; a free-text reason stays out of the row."""
    return build_events(df, MERGING[1], "tx_id", ts, [f for f in fields if f in LEDGER_FIELDS], **kw)


def verified(df: DataFrame, ts: Column, **kw) -> DataFrame:
    return build_events(df.withColumn("verified", F.lit(True)), MERGING[2], "tx_id", ts, ["verified"], **kw)


def duplicate_detected(df: DataFrame, ts: Column, **kw) -> DataFrame:
    return build_events(df, DUPLICATE_DETECTED, "duplicate_id", ts, ["original_id", "duplicate_id", "similarity"], **kw)


def duplicate_resolved(df: DataFrame, ts: Column, **kw) -> DataFrame:
    return build_events(df, DUPLICATE_RESOLVED, "duplicate_id", ts, ["duplicate_id", "is_duplicate"], **kw)


def reconciled(df: DataFrame, ts: Column, key: str = "account_id", **kw) -> DataFrame:
    return build_events(
        df, RECONCILED, key, ts, ["calculated", "expected", "difference", "reconciled"], aggregate_type="balance", **kw
    )


def discrepancy(df: DataFrame, ts: Column, **kw) -> DataFrame:
    return build_events(df, DISCREPANCY, "tx_id", ts, ["issue", "amount"], **kw)


def system_event(df: DataFrame, name: str, key: str, ts: Column, payload: Sequence[str], **kw) -> DataFrame:
    return build_events(df, name, key, ts, payload, aggregate_type="system", **kw)


def classify_and_log(df: DataFrame, rules, ts: Column, **kw) -> tuple[DataFrame, DataFrame]:
    from tallyloom.operators.classify import classify

    done = classify(df, rules)
    return done, classified(done, ts, **kw)


def append_events(events: DataFrame, path: str) -> None:
    """Append to the log, stored by day so that time travel prunes files."""
    events.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


# ---- views over the log ----------------------------------------------------------------------


def as_of(events: DataFrame, t: str | Column) -> DataFrame:
    moment = F.lit(t).cast("timestamp") if isinstance(t, str) else t
    return events.where(F.col("ts") <= moment)


def since(events: DataFrame, t: str | Column) -> DataFrame:
    moment = F.lit(t).cast("timestamp") if isinstance(t, str) else t
    return events.where(F.col("ts") > moment)


def events_by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def events_in_range(events: DataFrame, start: str, end: str) -> DataFrame:
    """Start included, end excluded."""
    return events.where(
        (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    )


def latest_event(events: DataFrame, event_type: str | None = None) -> DataFrame:
    rows = events if event_type is None else events_by_type(events, event_type)
    picked = rows.agg(F.max_by(F.struct(*events.columns), F.struct("ts", "seq")).alias("e"))
    return picked.where("e IS NOT NULL").select("e.*")


def latest_per(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    picked = events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct("ts", "seq")).alias("e"))
    return picked.select("e.*")


def event_types(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct()


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def event_timeline(events: DataFrame) -> DataFrame:
    """Events per UTC day."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def aggregate_events(events: DataFrame, event_type: str, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Caller's aggregates over one event type."""
    return events_by_type(events, event_type).groupBy(*by).agg(*aggregates)


def decode(events: DataFrame, schema: str) -> DataFrame:
    return events.withColumn("payload", F.from_json("data", schema))


# ---- projection ------------------------------------------------------------------------------


def project_state(
    events: DataFrame,
    fields: Mapping[str, str] | None = None,
    at: str | Column | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Current transactions, or those at time ``at``: one row per transaction.

    An import replaces the row, later classified, corrected and verified events overwrite the fields
    they carry, unknown types are ignored, ties in time go by ``seq``, then by the event's type and content. ``ids`` restricts the
    projection before anything is aggregated.
    """
    fields = dict(fields or LEDGER_FIELDS)
    log = events if at is None else as_of(events, at)
    if ids is not None:
        log = log.join(ids.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    return finish_state(partial_state(log, fields), fields)


def partial_state(events: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """One row per transaction from which the state follows, and which can be merged with that of other events: the last import, the last change of
    each field, the last event and the number of events."""
    fields = dict(fields or LEDGER_FIELDS)
    log = events.where(F.col("event_type").isin([IMPORTED, *MERGING]) & F.col("aggregate_id").isNotNull())
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    rows = log.select(
        "aggregate_id",
        F.struct("ts", "seq", F.array_position(F.array(*map(F.lit, [IMPORTED, *MERGING])), F.col("event_type")).alias("rank"), "data").alias("o"),
        (F.col("event_type") == IMPORTED).alias("is_import"),
        F.from_json("data", schema).alias("p"),
    )
    last_import = F.max(F.when(F.col("is_import"), F.struct("o", "p")))
    merged = [
        F.max(
            F.when(~F.col("is_import") & F.col(f"p.{n}").isNotNull(), F.struct("o", F.col(f"p.{n}").alias("v")))
        ).alias(f"_m{i}")
        for i, n in enumerate(fields)
    ]
    return rows.groupBy("aggregate_id").agg(
        last_import.alias("_imp"), F.max("o").alias("_last"), F.count(F.lit(1)).alias("events"), *merged
    )


def merge_states(partials: DataFrame) -> DataFrame:
    """Partial states of separate events as one."""
    newest = [F.max(c).alias(c) for c in partials.columns if c not in ("aggregate_id", "events")]
    return partials.groupBy("aggregate_id").agg(F.sum("events").alias("events"), *newest).select(partials.columns)


def finish_state(folded: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Current transactions from partial states."""
    fields = dict(fields or LEDGER_FIELDS)
    values = []
    for i, n in enumerate(fields):
        newer = F.col("_imp").isNull() | (F.col(f"_m{i}.o") > F.col("_imp.o"))
        values.append(F.when(F.col(f"_m{i}").isNotNull() & newer, F.col(f"_m{i}.v")).otherwise(F.col(f"_imp.p.{n}")).alias(n))
    return folded.select(
        F.col("aggregate_id").alias("tx_id"),
        *values,
        F.col("_imp").isNotNull().alias("has_import"),
        F.col("_last.ts").alias("updated_at"),
        "events",
    )


def get_transaction(events: DataFrame, tx_id: str) -> DataFrame:
    return project_state(events.where(F.col("aggregate_id") == tx_id))


def transaction_history(events: DataFrame, ids: DataFrame) -> DataFrame:
    """All events of the given transactions, oldest first within each."""
    keys = ids.select(F.col("tx_id").cast("string").alias("aggregate_id")).distinct()
    return events.join(keys, "aggregate_id", "left_semi")


def duplicate_candidates(events: DataFrame) -> DataFrame:
    schema = "original_id STRING, duplicate_id STRING, similarity DOUBLE"
    return decode(events_by_type(events, DUPLICATE_DETECTED), schema).select("ts", "seq", "payload.*")


def duplicate_decisions(events: DataFrame) -> DataFrame:
    """Latest verdict per transaction."""
    rows = decode(events_by_type(events, DUPLICATE_RESOLVED), "duplicate_id STRING, is_duplicate BOOLEAN")
    return rows.groupBy(F.col("payload.duplicate_id").alias("duplicate_id")).agg(
        F.max_by("payload.is_duplicate", F.struct("ts", "seq")).alias("is_duplicate")
    )


def confirmed_duplicates(events: DataFrame) -> DataFrame:
    return duplicate_decisions(events).where("is_duplicate").select("duplicate_id")


def rejected_duplicates(events: DataFrame) -> DataFrame:
    return duplicate_decisions(events).where(~F.col("is_duplicate")).select("duplicate_id")


def mark_duplicates(ledger: DataFrame, events: DataFrame) -> DataFrame:
    known = confirmed_duplicates(events).select(
        F.col("duplicate_id").alias("tx_id"), F.lit(True).alias("is_duplicate")
    )
    return ledger.join(known, "tx_id", "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False))
    )


def reconciliations(events: DataFrame) -> DataFrame:
    schema = "calculated DECIMAL(18,2), expected DECIMAL(18,2), difference DECIMAL(18,2), reconciled BOOLEAN"
    return decode(events_by_type(events, RECONCILED), schema).select("ts", "seq", "aggregate_id", "payload.*")


def discrepancies(events: DataFrame) -> DataFrame:
    schema = "issue STRING, amount DECIMAL(18,2), resolved BOOLEAN"
    return decode(events_by_type(events, DISCREPANCY), schema).select("ts", "seq", "aggregate_id", "payload.*")


def unresolved_discrepancies(events: DataFrame) -> DataFrame:
    return discrepancies(events).where(~F.coalesce("resolved", F.lit(False)))


def replay(events: DataFrame, reducer: Callable, schema: str) -> DataFrame:
    """Fold with a caller's Python reducer, one aggregate at a time.

    The slow path for folds that no aggregate expresses: ``reducer`` gets an ordered pandas frame
    of one aggregate and returns a frame of ``schema``. All events of one aggregate meet in one task, so
    it suits aggregates of bounded history only; ``project_state`` has no such limit.
    """
    ordered = lambda pdf: reducer(pdf.sort_values(["ts", "seq"]))
    return events.groupBy("aggregate_id").applyInPandas(ordered, schema)


def valid_at(rows: DataFrame, t: str) -> DataFrame:
    """Rows whose validity interval covers ``t``; an open end is null."""
    moment = F.lit(t).cast("timestamp")
    return rows.where(
        (F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (moment < F.col("valid_until")))
    )
