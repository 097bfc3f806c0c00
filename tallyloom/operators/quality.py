"""Row validation from rule tables, and completeness checks between processing stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.predicates import full_match
from tallyloom.operators.cleaning import once

# The checks of the closed transaction shape.
TRANSACTION_RULES = [
    {"field": "id", "required": True, "type": "string", "pattern": "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"},
    {"field": "date", "required": True, "type": "string", "pattern": r"\d{4}-\d{2}-\d{2}"},
    {"field": "amount", "required": True, "type": "number", "min": 0.01},
    {"field": "description", "required": True, "type": "string", "pattern": r"[\s\S]+"},
    {"field": "type", "required": True, "type": "string", "pattern": "income|expense|transfer|unknown"},
]

# Columns each processing stage must add.
STAGE_COLUMNS = {
    1: ["type", "direction", "merchant_expected", "confidence", "stage_1"],
    2: ["counterparty", "stage_2"],
    3: ["clean_merchant", "stage_3"],
    4: ["entity_resolved", "stage_4"],
    5: ["flow_type", "budget_category", "tax_category", "payment_method"],
}
DEFINITION_FIELDS = ["id", "registry", "extraction", "enabled", "priority"]


def _first_failure(rule: Mapping, dtype: T.DataType | None) -> Column:
    field = rule["field"]
    value = F.col(field) if dtype is not None else F.lit(None).cast("string")
    message = lambda default: F.lit(rule.get("error") or default)
    checks: list[tuple[Column, Column]] = []
    if rule.get("required"):
        checks.append((value.isNull(), message(f"Field {field} is required")))
    numeric = isinstance(dtype, T.NumericType)
    number = value if numeric else value.try_cast("double")
    if rule.get("type") == "number" and not numeric:
        checks.append((value.isNotNull() & number.isNull(), message(f"Field {field} must be a number")))
    if rule.get("type") == "string" and dtype is not None and not isinstance(dtype, T.StringType):
        checks.append((value.isNotNull(), message(f"Field {field} must be a string")))
    if rule.get("min") is not None:
        checks.append((number < rule["min"], message(f"Field {field} must be >= {rule['min']}")))
    if rule.get("max") is not None:
        checks.append((number > rule["max"], message(f"Field {field} must be <= {rule['max']}")))
    if rule.get("pattern") is not None:
        checks.append((~full_match(value, rule["pattern"]), message(f"Field {field} does not match pattern")))
    if rule.get("one_of") is not None:
        checks.append((~value.isin(rule["one_of"]), message(f"Field {field} must be one of the known values")))
    failed = F.coalesce(*[F.when(test, text) for test, text in checks]) if checks else F.lit(None).cast("string")
    return F.when(failed.isNotNull(), F.struct(F.lit(field).alias("field"), failed.alias("message")))


def validate_rows(df: DataFrame, rules: Sequence[Mapping], closed: bool = False) -> DataFrame:
    """Add ``violations`` (first failing check of each rule), ``first_error`` and ``valid``.

    ``closed`` also reports columns that no rule names.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = [_first_failure(rule, types.get(rule["field"])) for rule in rules]
    if closed:
        known = {rule["field"] for rule in rules}
        found += [
            F.struct(F.lit(c).alias("field"), F.lit(f"Field {c} is not allowed").alias("message"))
            for c in df.columns
            if c not in known
        ]
    violations = F.array_compact(F.array(*found))
    return df.withColumn("violations", violations).withColumns(
        {
            "first_error": F.when(F.size("violations") > 0, F.col("violations")[0]["message"]),
            "valid": F.size("violations") == 0,
        }
    )


def field_errors(validated: DataFrame) -> DataFrame:
    """Violations as a field-to-messages map and one readable text."""
    grouped = F.map_from_entries(
        F.transform("violations", lambda v: F.struct(v["field"].alias("k"), F.array(v["message"]).alias("v")))
    )
    lines = F.transform("violations", lambda v: F.concat(v["field"], F.lit(": "), v["message"]))
    return validated.withColumns({"field_errors": grouped, "error_text": F.array_join(lines, "; ")})


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    # A filter on the verdict must not run the checks in place of each column that they look at.
    validated = once(validated, {"valid": F.col("valid")})
    return validated.where("valid"), validated.where(~F.col("valid"))


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid_count"),
        F.count_if(~F.col("valid")).alias("invalid_count"),
    )


def violation_counts(validated: DataFrame) -> DataFrame:
    exploded = validated.select(F.explode("violations").alias("v"))
    return exploded.groupBy(F.col("v.field").alias("field"), F.col("v.message").alias("message")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def stage_complete(df: DataFrame, stage: int) -> Column:
    missing = [c for c in STAGE_COLUMNS[stage] if c not in df.columns]
    if missing:
        return F.lit(False)
    present = F.lit(True)
    for name in STAGE_COLUMNS[stage]:
        present = present & F.col(name).isNotNull()
    # Rows that expect no merchant skip extraction and resolution.
    return present | ~F.col("merchant_expected") if stage in (3, 4) else present


def stage_report(df: DataFrame, stage: int) -> DataFrame:
    ok = stage_complete(df, stage)
    return df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def stage_reports(df: DataFrame, stages: Sequence[int]) -> DataFrame:
    """``stage_report`` of several stages of the same rows, which are read once, with the ``stage``."""
    counts = []
    for stage in stages:
        ok = stage_complete(df, stage)
        counts.append(F.struct(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.lit(stage).alias("stage")).alias(f"_{stage}"))
    return df.agg(*counts).select(F.inline(F.array(*[F.col(f"_{stage}") for stage in stages])))


def check_definitions(definitions: DataFrame) -> DataFrame:
    """Entity definitions with the names of their missing fields."""
    missing = F.array_compact(
        F.array(*[
            F.when(F.col(f).isNull() if f in definitions.columns else F.lit(True), F.lit(f))
            for f in DEFINITION_FIELDS
        ])
    )
    return definitions.withColumn("missing_fields", missing).withColumn("valid", F.size("missing_fields") == 0)
