"""Rule classification. Rule tables are authored configuration, so they are compiled
into one short-circuit expression: no shuffle, no join, and usable on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.predicates import confidence_of, in_band, matches_pattern
from tallyloom.operators.cleaning import once
from tallyloom.sources.tables import load_config


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    is_regex: bool = False
    merchant: str | None = None
    category: str | None = None
    type: str | None = None
    confidence: float | None = None
    priority: int = 0


RULE_SCHEMA = (
    "id STRING, pattern STRING, is_regex BOOLEAN, merchant STRING, category STRING, "
    "type STRING, confidence DOUBLE, priority INT"
)


def load_rules(path: str | None = None) -> list[Rule]:
    names = {f.name for f in fields(Rule)}
    return [Rule(**{k: v for k, v in r.items() if k in names and v is not None})
            for r in load_config("merchant_rules", path)]


def first_match(tests: Sequence[Column]) -> Column:
    """1-based position of the first test that holds; later ones are not evaluated."""
    if not tests:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(tests, start=1)])


def _pick(values: Sequence, position: Column, dtype: str) -> Column:
    if not values:
        return F.lit(None).cast(dtype)
    table = F.array(*[F.lit(v).cast(dtype) for v in values])
    return F.when(position.isNotNull(), F.get(table, position - 1))


def best_rule(df: DataFrame, rules: Sequence[Rule], by_priority: bool = True) -> tuple[DataFrame, list[Rule]]:
    """Add ``_rule``, the place of the winning rule: highest priority first, then rule order."""
    ordered = sorted(rules, key=lambda r: -r.priority) if by_priority else list(rules)
    texts = {"_desc": F.col("description"), "_merch": F.col("merchant")}
    df = df.withColumns({n: F.upper(F.coalesce(c, F.lit(""))) for n, c in texts.items()})
    tests = [
        matches_pattern(r.pattern, r.is_regex, F.col("_desc"))
        | matches_pattern(r.pattern, r.is_regex, F.col("_merch"))
        for r in ordered
    ]
    # A filter on what a rule sets must not run all rules again.
    return once(df, {"_rule": first_match(tests)}).drop("_desc", "_merch"), ordered


def classify(df: DataFrame, rules: Sequence[Rule] | None = None, by_priority: bool = True) -> DataFrame:
    """Add merchant_id, category_id, confidence and rule_id; a rule only sets what it holds."""
    matched, ordered = best_rule(df, load_rules() if rules is None else rules, by_priority)
    at = F.col("_rule")
    miss = at.isNull()
    kept = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    out = {
        "merchant_id": F.when(~miss, F.coalesce(_pick([r.merchant for r in ordered], at, "string"), kept("merchant_id", "string"))),
        "category_id": F.when(miss, "uncategorized").otherwise(
            F.coalesce(_pick([r.category for r in ordered], at, "string"), kept("category_id", "string"))
        ),
        "confidence": F.when(miss, F.lit(0.0)).otherwise(
            F.coalesce(_pick([r.confidence for r in ordered], at, "double"), kept("confidence", "double"))
        ),
        "rule_id": _pick([r.id for r in ordered], at, "string"),
    }
    if "type" in df.columns:
        out["type"] = F.coalesce(_pick([r.type for r in ordered], at, "string"), F.col("type"))
    return matched.withColumns(out).drop("_rule")


def classify_batch(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    min_confidence: str = "any",
    version: str = "1.0.0",
    classified_at: Column | None = None,
) -> DataFrame:
    kept = classify(df, rules).where(in_band(F.col("confidence"), min_confidence))
    return kept.withColumns(
        {"classified_at": classified_at or F.current_timestamp(), "classification_version": F.lit(version)}
    )


def classify_manual(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human overrides by tx_id; a missing confidence means certainty."""
    renamed = overrides.select(
        "tx_id",
        *[F.col(c).alias(f"_{c}") for c in ("merchant_id", "category_id", "type", "confidence")],
        F.lit(True).alias("_manual"),
    )
    joined = df.join(renamed, "tx_id", "left")
    manual = F.coalesce("_manual", F.lit(False))
    return joined.withColumns(
        {
            "merchant_id": F.coalesce("_merchant_id", "merchant_id"),
            "category_id": F.coalesce("_category_id", "category_id"),
            "type": F.coalesce("_type", "type"),
            "confidence": F.when(manual, F.coalesce("_confidence", F.lit(1.0))).otherwise(F.col("confidence")),
            "classified_manually": manual,
        }
    ).drop("_merchant_id", "_category_id", "_type", "_confidence", "_manual")


def classify_with(df: DataFrame, classifier: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """Merge the columns of a caller's classifier, a plan-time function of the DataFrame."""
    return df.withColumns(classifier(df))


def keyword_merchant(description: Column, merchants: Sequence[str]) -> dict[str, Column]:
    """First known merchant contained in the text (0.95), else its first word (0.30)."""
    text = F.upper(description)
    known = F.coalesce(*[F.when(text.contains(m.upper()), F.lit(m)) for m in merchants])
    word = F.split(F.trim(description), r"\s+", 2)[0]
    return {
        "detected_merchant": F.coalesce(known, word),
        "merchant_confidence": F.when(known.isNotNull(), 0.95).otherwise(0.30),
    }


#: Rows of a table that are broadcast, and the pieces that every merchant's rows are cut into beside a larger table.
SENT, PIECES = 100_000, 64


def _joined_evenly(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a static table. A stream's frequent keys, or rows without one, can't be counted beforehand, so none may meet in one task."""
    if table.limit(SENT + 1).count() <= SENT:
        return df.join(F.broadcast(table), key, "left")
    right = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return df.withColumn("_piece", F.pmod(F.xxhash64(*df.columns), F.lit(PIECES)).cast("int")).join(right, [key, "_piece"], "left").drop("_piece")


def category_of_merchant(df: DataFrame, categories: DataFrame, merchant: str = "detected_merchant") -> DataFrame:
    """Category by merchant table; misses become uncategorized at 0.30 and go to review."""
    table = categories.select(
        F.col("merchant").alias(merchant),
        F.col("category").alias("_category"),
        F.col("rule_id").alias("_category_rule"),
        F.col("confidence").alias("_category_confidence"),
    )
    joined = _joined_evenly(df, table, merchant)
    hit = F.col("_category").isNotNull()
    return joined.withColumns(
        {
            "detected_category": F.coalesce("_category", F.lit("uncategorized")),
            "category_confidence": F.when(hit, F.coalesce("_category_confidence", F.lit(0.95))).otherwise(0.30),
            "category_rule": F.col("_category_rule"),
            "category_method": F.when(hit, "rule").otherwise("review"),
        }
    ).drop("_category", "_category_rule", "_category_confidence")


def classification_stats(df: DataFrame) -> DataFrame:
    known = F.coalesce("category_id", F.lit("uncategorized")) != "uncategorized"
    level = confidence_of(F.col("confidence"))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known).alias("classified"),
        F.count_if(~known).alias("unclassified"),
        F.count_if(level >= 0.9).alias("high_confidence"),
        F.count_if((level >= 0.7) & (level < 0.9)).alias("medium_confidence"),
        F.count_if(level < 0.7).alias("low_confidence"),
    )


def classification_counts(df: DataFrame) -> DataFrame:
    """Rows by category and by merchant in one pass."""
    from tallyloom.operators.summaries import counts_by

    return counts_by(df, ["category_id", "merchant_id"])


def rule_catalog(rules: Sequence[Rule], spark) -> DataFrame:
    """Categories (with an inferred type) and merchants that a rule table mentions."""
    rows = spark.createDataFrame(
        [(r.merchant, r.category, r.type) for r in rules], "merchant STRING, category STRING, type STRING"
    )
    income = F.col("category").isin("salary", "freelance") | (F.col("type") == "income")
    kind = F.when(F.col("category") == "transfer", "transfer").when(income, "income").otherwise("expense")
    cats = rows.where("category IS NOT NULL").select(
        F.lit("category").alias("kind"), F.col("category").alias("id"), kind.alias("entry_type")
    )
    merchants = rows.where("merchant IS NOT NULL").select(
        F.lit("merchant").alias("kind"), F.col("merchant").alias("id"), F.lit(None).cast("string").alias("entry_type")
    )
    return cats.unionByName(merchants).groupBy("kind", "id").agg(F.min("entry_type").alias("entry_type"))
