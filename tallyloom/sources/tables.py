"""Small configuration tables, and append-only tables for ledgers, logs and entities."""

from __future__ import annotations

import json
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.functions.normalise import content_hash, title_from_kebab
from tallyloom.functions.skew import first_per_key, hot_groups, spread_join


def load_config(name: str, path: str | None = None) -> list[dict]:
    """Rows of a rule table or registry shipped with the package, or of the file given: a list, or ``rows`` beside a note."""
    file = Path(path) if path else resources.files("tallyloom.data").joinpath(f"{name}.json")
    found = json.loads(file.read_text(encoding="utf-8"))
    return found["rows"] if isinstance(found, dict) else found


def config_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A parquet table; with ``schema`` a missing table reads as empty."""
    if schema is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def only_new(new: DataFrame, existing: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key is unseen, first of each key within the batch."""
    known = existing.select(key).distinct()
    kept = first_per_key(new, [key], order or [F.xxhash64(*new.columns)])
    return kept.join(known, key, "left_anti")


def append_idempotent(new: DataFrame, path: str, key: str, order: list[Column] | None = None) -> None:
    """Append the unseen rows; importing the same batch twice changes nothing."""
    spark = new.sparkSession
    existing = read_table(spark, path, new.schema)
    append_rows(only_new(new, existing, key, order), path)


# What an imported transaction is given where it says nothing.
DEFAULTS = {"currency": "USD", "type": "expense", "source_file": "unknown", "source_line": 0}


def import_with_references(
    new: DataFrame, existing: DataFrame, entities: DataFrame, classified_at: Column, method: str = "csv-import", version: str = "import-v1.0",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions that are not stored yet, their classifications as a table of their own, and the entities with merchants seen first here.

    ``entities``: entity_id, canonical_name. A bank or category is kept as a reference if there is such an entity; a merchant that is
    unseen becomes one, named after its id. ``DEFAULTS`` fill missing fields.
    """
    fresh = only_new(new, existing, "tx_id")
    filled = {c: F.coalesce(F.col(c), F.lit(v).cast(fresh.schema[c].dataType)) for c, v in DEFAULTS.items() if c in fresh.columns}
    known = entities.select("entity_id").distinct()
    merchants = fresh.where("merchant_id IS NOT NULL").select(F.col("merchant_id").alias("entity_id")).distinct()
    created = merchants.join(known, "entity_id", "left_anti").withColumn("canonical_name", title_from_kebab(F.col("entity_id")))
    rows = fresh.withColumns(filled)
    for column in ("bank", "category_id"):
        if column in rows.columns:
            hot = hot_groups(rows.where(F.col(column).isNotNull()), [column])
            marks = known.select(F.col("entity_id").alias(column), F.col("entity_id").alias("_ref"))
            rows = spread_join(rows, marks, [column], ["tx_id"], hot).withColumn(column, F.col("_ref")).drop("_ref")
    taken = [F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in (("merchant_id", "string"), ("category_id", "string"), ("confidence", "double"))]
    classified = fresh.select("tx_id", *taken, F.lit(method).alias("method"), classified_at.alias("classified_at"), F.lit(version).alias("version"))
    return rows, classified, entities.select("entity_id", "canonical_name").unionByName(created)


def with_store_hash(df: DataFrame, entity_type: str = "entity_type", data: str = "data") -> DataFrame:
    """Content hash of a stored entity: its type and data, map entries in key order."""
    entries = F.array_sort(F.map_entries(data))
    body = F.to_json(F.map_from_entries(entries))
    return df.withColumn("hash", content_hash(F.col(entity_type), body))


def flag_known(df: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Append report: each batch row with ``duplicate`` set when its key was stored before
    or came earlier in the batch (``seq`` order)."""
    firsts = df.groupBy(key).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    marks = firsts.join(known, key, "left")
    hot = hot_groups(firsts, [key], rows="_rows")
    return (
        spread_join(df, marks.drop("_rows"), [key], ["seq"], hot)
        .withColumn("duplicate", F.coalesce("_known", F.lit(False)) | (F.col("seq") > F.col("_first")))
        .drop("_first", "_known")
    )


def stamp_history(df: DataFrame, source_file: str | Column, processed_at: Column, version: str) -> DataFrame:
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    return df.withColumns(
        {"source_file": source, "processed_at": processed_at, "pipeline_version": F.lit(version)}
    )


def unprocessed_files(files: DataFrame, history: DataFrame, column: str = "source_file") -> DataFrame:
    """Files that the history has not seen."""
    return files.join(history.select(column).distinct(), column, "left_anti")


def import_metrics(batch: DataFrame, stored: DataFrame, key: str = "tx_id") -> DataFrame:
    """One row: rows offered, already stored, newly imported, and classified among the new."""
    ids = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    joined = batch.join(ids, key, "left")
    fresh = F.col("_stored").isNull()
    return joined.agg(
        F.count(F.lit(1)).alias("offered"),
        F.count_if(~fresh).alias("skipped"),
        F.count_if(fresh).alias("imported"),
        F.count_if(fresh & (F.coalesce("category_id", F.lit("uncategorized")) != "uncategorized")).alias(
            "classified"
        ),
    )
