"""A training corpus from raw documents, in five stages, each written as Parquet and read again by the next.

quality_rules    documents that a rule rejects go (null and short texts among them)
near_dedup       one document of each group of near copies (five-word shingles, similarity 0.8) stays; null ids are kept
substring_dedup  words in windows of 13 that a smaller document holds too go; the text and, where there is one, n_chars follow
mixing           each document as often as the mix takes it, in the order of the curriculum
sentencepiece    ids and the text decoded from them are added

Every stage handles null texts, ids and sources, repeated rows and empty tables as its operator says, and all
but the last return the columns that they got, whatever their names; the last replaces older columns named ids, n_tokens or decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.skew import first_per_key
from tallyloom.llm import mixing, pieces, quality_rules
from tallyloom.llm.near_dedup import SENT, near_duplicates
from tallyloom.llm.queries import MODEL
from tallyloom.llm.substring_dedup import remove_repeats
from tallyloom.runtime import materialise


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def spared(stage: Callable) -> Callable:
    """A stage that sees other columns under names that nothing else has, so that none can clash with a name that an operator uses."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, **options) -> DataFrame:
        extra = {c: f"extra {i} of a document" for i, c in enumerate(c for c in docs.columns if c not in OWN)}
        out = stage(spark, docs.withColumnsRenamed(extra), sf_dir, **options)
        # A stage's own result goes before an older column of its name.
        taken = [new for old, new in extra.items() if old in out.columns]
        return out.drop(*taken).withColumnsRenamed({new: old for old, new in extra.items() if new not in taken})

    run.__name__ = stage.__name__
    return run


@spared
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


@spared
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, size=5)
    judged = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.count_if("kept").alias("__n"))
    # Ids that go or have several rows are few of all, so the texts stay where they are; beyond ``SENT`` such ids they are joined.
    other = materialise(judged.where("__n <> 1"), "other")
    sent = F.broadcast if other.count() <= SENT else lambda ids: ids
    single = docs.where("doc_id IS NOT NULL").join(sent(other), F.col("doc_id") == F.col("__id"), "left_anti")
    # Of rows with one id, the first in a fixed order stays.
    repeated = docs.join(sent(other.where("__n > 1")), F.col("doc_id") == F.col("__id"), "left_semi")
    first = first_per_key(repeated, ["doc_id"], [F.xxhash64(*docs.columns)])
    return single.union(first).union(docs.where("doc_id IS NULL"))


@spared
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(docs, joined=False)
    left = F.col("__kept").cast("string")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@spared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs, position_column="__position").select(*docs.columns)


@spared
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    out = pieces.encode_decode(docs, model, ids="__ids", decoded="__decoded")
    return out.select(*docs.columns, F.col("__ids").alias("ids"), F.size("__ids").cast("long").alias("n_tokens"), F.col("__decoded").alias("decoded"))


STAGES = [
    ("quality_rules", reject_low_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Similarity groups and pieces are beyond SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
