"""The registered queries of this subpackage: name to (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import manifest, mixing, near_dedup, periodic, pieces, quality_rules, substring_dedup, suffix_index, topk, warc
from tallyloom.llm.discriminant import quality
from tallyloom.llm.extract import extract
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.substring_dedup import remove_repeats
from tallyloom.llm.suffix_index import remove_repeated_bytes
from tallyloom.llm.topk import top_products
from tallyloom.llm.toxicity import toxicity
from tallyloom.runtime import materialise, shared_path

#: A public model file; another one may be given to the query's function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), model)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    out = warc.resolve_revisits(warc.read_archives(spark, path, with_payload=False))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.facts_and_verdict(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of("text").alias("size")), "document-sizes")
    mix = mixing.mixed(sizes, text=None, size="size")
    rows = mix.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"),
        F.round(F.get("__positions", F.lit(0)), 9).alias("position"),
    )
    # In the order of the training; what is not taken has no position.
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__total").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__total").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_facts(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


Q = {
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_near_dedup": (op2_near_dedup, near_dedup.SQL),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_warc": (op4_warc, warc.SQL),
    "op5_topk": (op5_topk, topk.SQL),
    "op6_quality_classifier": (op6_quality_classifier, None),
    "op7_quality_rules": (op7_quality_rules, quality_rules.SQL),
    "op8_mixing": (op8_mixing, mixing.SQL),
    "op9_substring_dedup": (op9_substring_dedup, substring_dedup.SQL),
    "op10_suffix_array_dedup": (op10_suffix_array_dedup, suffix_index.SQL),
    "op11_periodic_runs": (op11_periodic_runs, periodic.SQL),
    "op12_toxicity": (op12_toxicity, None),
    "op13_merkle_manifest": (op13_merkle_manifest, manifest.SQL),
}
