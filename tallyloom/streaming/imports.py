"""The import path on streams: parse, classify and persist micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.skew import first_per_key
from tallyloom.operators.classify import Rule, classify
from tallyloom.operators.cleaning import import_rows
from tallyloom.operators.events import classified, imported
from tallyloom.sources.key_store import KeyStore, Lookup


def read_stream(
    spark: SparkSession, folder: str, schema, files: str = "*", files_per_trigger: int = 100, fmt: str = "parquet"
) -> DataFrame:
    """The files of a folder that match ``files`` as a stream; the trigger size is the back-pressure."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", files).format(fmt).load(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A table of ``folder`` as a stream, be it one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read_stream(spark, f"{folder}/{name}.parquet", schema, files_per_trigger=files_per_trigger)
    return read_stream(spark, folder, schema, f"{name}.parquet", files_per_trigger)


def parse_stream(raw: DataFrame, parser_version: str = "1.0.0") -> tuple[DataFrame, DataFrame]:
    """Ledger stream and quarantine stream."""
    return import_rows(raw, parser_version)


def classify_stream(ledger: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rules are compiled into the projection, so classification needs no state and no join."""
    return classify(ledger, rules)


def dedupe_stream(df: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Drop repeats of ``key`` that come within ``delay``; later ones meet the sink's anti-join."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _earlier(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """Rows that former micro-batches wrote; a replayed batch does not see its own first try."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id)


def idempotent_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores each key once.

    Each micro-batch owns one ``batch_id`` folder and overwrites it, so a batch that is replayed after
    a lost driver or executor leaves the same rows as one that ran once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        schema = batch.limit(0).withColumn("batch_id", F.lit(0).cast("bigint")).schema
        known = _earlier(batch.sparkSession, path, batch_id, schema).select(key)
        once = first_per_key(batch, [key], [F.xxhash64(*batch.columns)])
        fresh = once.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def keyed_sink(path: str, key: str, buckets: int = 16, look_back: int | None = None, looked: Callable[[int, Lookup], None] | None = None) -> Callable[[DataFrame, int], None]:
    """As ``idempotent_sink``, but what is known comes from a key store beside the rows, so a batch reads filters and the few key files that may hold one of its keys
    instead of the whole history. ``look_back``: batches that are looked at; ``looked`` is told how many key files there are and were opened."""
    store = KeyStore(f"{path}/_keys", key, buckets, look_back)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = first_per_key(batch, [key], [F.xxhash64(*batch.columns)])
        target = f"{path}/batch_id={batch_id}"
        if not store.segments(spark, batch_id):
            # Nothing can be known, so the batch need not be held until that is found out.
            if looked:
                looked(batch_id, store.nothing(once))
            once.write.mode("overwrite").option("compression", "zstd").parquet(target)
        else:
            once = once.persist()
            try:
                found = store.lookup(once.select(key), batch_id)
                if looked:
                    looked(batch_id, found)
                # What opened no file leaves nothing to compare with.
                (once.join(found.known, key, "left_anti") if found.opened else once).write.mode("overwrite").option("compression", "zstd").parquet(target)
            finally:
                once.unpersist()
        fresh = spark.read.schema(batch.schema).parquet(f"{path}/batch_id={batch_id}")
        store.add(fresh.select(key), batch_id)
        # Only segments of batches that are done for good are merged.
        store.compact(spark, batch_id, batch.schema[key].dataType.simpleString())

    return write


def event_sink(ledger_path: str, events_path: str, key: str = "tx_id") -> Callable[[DataFrame, int], None]:
    """Store new transactions, and two events for each: imported and classified."""
    store = keyed_sink(ledger_path, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        fresh = batch.sparkSession.read.parquet(f"{ledger_path}/batch_id={batch_id}")
        at = F.lit(batch_id).cast("bigint")
        # When it was imported, not the transaction's day, so that the log's past shows what was known then.
        when = F.current_timestamp()
        first = imported(fresh, when, seq=at * 2)
        second = classified(fresh, when, seq=at * 2 + 1)
        first.unionByName(second).write.mode("overwrite").option("compression", "zstd").parquet(f"{events_path}/batch_id={batch_id}")

    return write


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str) -> StreamingQuery:
    """Process all present input with a checkpoint and stop."""
    query = (
        df.writeStream.queryName(name)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_import(
    raw: DataFrame, ledger_path: str, events_path: str, checkpoint: str, rules: Sequence[Rule] | None = None
) -> StreamingQuery:
    ledger, _ = parse_stream(raw)
    # The import time differs between runs; it is kept out of the stored row.
    kept = classify_stream(ledger.drop("provenance"), rules)
    return run_available(kept, event_sink(ledger_path, events_path), checkpoint, "stream-import")


def with_progress(df: DataFrame, name: str) -> DataFrame:
    """Row counters reported with the progress of each micro-batch."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("confidence") > 0).alias("classified"))
