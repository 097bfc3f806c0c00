"""Import of raw statement rows: parse, normalise, tag errors, split off a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import normalise as N


def tag_rows(raw: DataFrame, on_error: str = "tag") -> DataFrame:
    """Parse and normalise the raw text columns, keeping each original as ``raw_*``.

    ``errors`` lists the fields that could not be read. With ``on_error='fail'`` the
    first bad field stops the job instead.
    """
    date, amount, kind = F.col("date"), F.col("amount"), F.col("type")
    parsed_date, parsed_amount = N.parse_date(date), N.parse_money(amount)
    parsed_type = N.normalise_type(kind)
    columns: dict[str, Column] = {
        "raw_date": date,
        "raw_amount": amount,
        "raw_type": kind,
        "date": parsed_date,
        "amount": parsed_amount,
        "type": parsed_type,
    }
    if "bank" in raw.columns:
        columns |= {"raw_bank": F.col("bank"), "bank": N.normalise_bank(F.col("bank"))}
    if "merchant" in raw.columns:
        columns |= {"raw_merchant": F.col("merchant"), "merchant": N.normalise_merchant(F.col("merchant"))}
    if "category" in raw.columns:
        columns |= {"raw_category": F.col("category"), "category": N.normalise_category(F.col("category"))}
    bad = {
        "date": date.isNotNull() & parsed_date.isNull(),
        "amount": amount.isNotNull() & parsed_amount.isNull(),
        "type": kind.isNotNull() & (parsed_type == "unknown"),
    }
    errors = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in bad.items()]))
    if on_error == "fail":
        for name, test in bad.items():
            source = {"date": date, "amount": amount, "type": kind}[name]
            message = F.concat(F.lit(f"cannot read {name}: "), source)
            columns[name] = F.when(test, F.raise_error(message)).otherwise(columns[name])
        return raw.withColumns(columns).withColumn("errors", F.array().cast("array<string>"))
    return once(raw, {**columns, "errors": errors})


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each computed once for a row, however many filters and projections read it.

    A filter is pushed below a projection by repeating its expressions; it stops at a generator, here of one row for each row.
    """
    held = lambda c: F.col(f"`{c.replace('`', '``')}`")
    kept = [held(c) for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    out = df.select(*kept, made.alias("_once"))
    return out.select(*[F.col("_once")[c].alias(c) if c in columns else held(c) for c in [*df.columns, *[n for n in columns if n not in df.columns]]])


def is_clean() -> Column:
    return (F.size("errors") == 0) & F.col("date").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))


def reject_reason() -> Column:
    first_error = F.concat(F.lit("bad-"), F.element_at("errors", 1))
    return (
        F.when(F.size("errors") > 0, first_error)
        .when(F.col("date").isNull(), F.lit("missing-date"))
        .when(F.col("amount").isNull(), F.lit("missing-amount"))
        .otherwise(F.lit("amount-not-positive"))
    )


def split_rows(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = tagged.where(is_clean()).drop("errors")
    return good, tagged.where(~is_clean()).withColumn("reason", reject_reason())


def with_identity(df: DataFrame) -> DataFrame:
    """Deterministic id and content hash, computed on clean rows only."""
    made = N.transaction_id(
        F.col("date"), F.col("description"), F.col("amount"), F.col("source_file"), F.col("source_line")
    )
    digest = N.content_hash(F.col("date"), F.col("amount"), F.col("merchant"), F.col("bank"))
    return df.withColumns({"tx_id": made, "idempotency_hash": digest})


def with_provenance(df: DataFrame, parser_version: str, imported_at: Column) -> DataFrame:
    return df.withColumn(
        "provenance",
        F.struct(
            F.col("source_file").alias("source_file"),
            F.col("source_line").cast("bigint").alias("source_line"),
            imported_at.alias("imported_at"),
            F.lit(parser_version).alias("parser_version"),
        ),
    )


def import_rows(
    raw: DataFrame, parser_version: str = "1.0.0", imported_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The whole import: ledger rows and quarantine. Narrow, so it also runs on streams."""
    good, bad = split_rows(tag_rows(raw))
    stamped = with_provenance(with_identity(good), parser_version, imported_at or F.current_timestamp())
    return stamped, bad
