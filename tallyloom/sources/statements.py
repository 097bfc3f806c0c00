"""Readers for exported statement files: delimited files of three banks, one JSON feed and
the combined 14-column export. Every reader yields one row shape plus a quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import normalise as N
from tallyloom.functions.skew import Running, running

# Column layouts of the exported files.
LAYOUTS = {
    "bofa": ["date", "description", "amount"],
    "apple-card": ["date", "description", "amount", "category", "merchant"],
    "wise": [
        "date", "payee_name", "amount", "currency", "exchange_rate",
        "amount_usd", "description", "type", "status",
    ],
    "combined": [
        "date", "description", "amount_original", "amount_numeric", "transaction_type",
        "category", "merchant", "currency", "account_name", "account_number", "bank",
        "source_file", "line_number", "classification_notes",
    ],
}
REQUIRED = {"bofa": 3, "apple-card": 5, "wise": 9, "combined": 11}
SOURCE_WORDS = [
    ("bofa", "bofa"),
    ("bank-of-america", "bofa"),
    ("apple", "apple-card"),
    ("stripe", "stripe"),
    ("wise", "wise"),
]
STRIPE_SCHEMA = (
    "data ARRAY<STRUCT<id STRING, amount BIGINT, currency STRING, description STRING, "
    "created BIGINT, type STRING>>"
)
_END = "\u0003end"

OUTPUT = [
    "tx_id", "date", "description", "merchant", "raw_amount", "amount", "type", "category_hint",
    "currency", "original_amount", "original_currency", "exchange_rate", "status", "bank",
    "source_file", "source_line",
]


def detect_source(file_name: Column) -> Column:
    return N.first_containing(F.lower(file_name), SOURCE_WORDS, F.lit("unknown"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file's name and 1-based line number; files of one name in several folders are numbered apart.

    A file may be split over many tasks: a line's place is the start of its split and its rank
    in that split, counted with the block-wise running count.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_rank"),
        F.col("value").alias("text"),
    )
    counted = running(
        lines, ["_path"], ["_start", "_rank"], [Running("source_line", "count", F.lit(1))]
    )
    return counted.drop("_path", "_start", "_rank")


def split_fields(lines: DataFrame, layout: str, text: str = "text") -> DataFrame:
    """Quote-aware split of each line into the columns of ``layout``; a quote inside quotes is doubled.

    ``short`` marks rows with fewer fields than the layout requires: an end mark appended to
    the line then falls into one of the required columns.
    """
    names = LAYOUTS[layout]
    schema = ", ".join(f"`{n}` STRING" for n in [*names, "_end"])
    parsed = F.from_csv(F.concat(F.col(text), F.lit(f",{_END}")), schema, {"mode": "PERMISSIVE", "escape": '"'})
    out = lines.withColumn("_f", parsed)
    required = names[: REQUIRED[layout]]
    short = F.lit(False)
    for n in required:
        short = short | F.coalesce(F.col(f"_f.{n}") == _END, F.lit(False))
    keep = [c for c in lines.columns if c != text]
    return out.select(
        *keep,
        F.col(text).alias("raw_line"),
        short.alias("short"),
        *[F.when(F.col(f"_f.{n}") != _END, F.col(f"_f.{n}")).alias(n) for n in names],
    )


def _first_word(col: Column) -> Column:
    return F.split(F.trim(col), r"\s+", 2)[0]


def bofa_type(amount: Column, description: Column) -> Column:
    text = F.upper(description)
    card = text.contains("CREDIT CARD PAYMENT") | text.contains("PAYMENT - THANK YOU")
    earned = text.contains("SALARY") | text.contains("DEPOSIT") | text.contains("PAYMENT FROM")
    return (
        F.when((amount < 0) & card, "transfer").when((amount > 0) | earned, "income").otherwise("expense")
    )


def bofa_merchant(description: Column) -> Column:
    return _first_word(F.split(description, r"\s+DES:", 2)[0])


def apple_type(description: Column) -> Column:
    text = F.upper(description)
    return F.when(text.contains("PAYMENT") | text.contains("THANK YOU"), "transfer").otherwise("expense")


def stripe_type(kind: Column) -> Column:
    text = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(text.contains("refund") | text.contains("fee"), "expense").otherwise("income")


def stripe_merchant(description: Column) -> Column:
    return F.regexp_replace(description, r"\APayment from ", "")


def wise_type(kind: Column) -> Column:
    text = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(text == "money in", "income").when(text == "money out", "expense").otherwise("transfer")


def _project(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One shape for all sources: missing columns are typed nulls, amounts are magnitudes."""
    types = {
        "tx_id": "string", "date": "date", "raw_amount": "decimal(18,2)", "amount": "decimal(18,2)",
        "original_amount": "decimal(18,2)", "exchange_rate": "decimal(18,6)", "source_line": "bigint",
    }
    filled = {n: columns.get(n, F.lit(None)).cast(types.get(n, "string")) for n in OUTPUT if n != "amount"}
    line = [F.col("raw_line")] if "raw_line" in df.columns else []
    out = df.select(*[c.alias(n) for n, c in filled.items()], *line)
    out = out.withColumn("amount", F.abs("raw_amount"))
    made = N.transaction_id(
        F.col("date"), F.col("description"), F.col("amount"), F.col("source_file"), F.col("source_line")
    )
    return out.withColumn("tx_id", F.coalesce("tx_id", made)).select(*OUTPUT, *line)


def project_bofa(rows: DataFrame) -> DataFrame:
    amount = N.parse_money(F.col("amount"), signed=True)
    return _project(rows, {
        "date": N.parse_date(F.col("date"), ["MM/dd/yyyy"]),
        "description": F.col("description"),
        "merchant": bofa_merchant(F.col("description")),
        "raw_amount": amount,
        "type": bofa_type(amount, F.col("description")),
        "currency": F.lit("USD"),
        "bank": F.lit("bofa"),
        "source_file": F.col("source_file"),
        "source_line": F.col("source_line"),
    })


def project_apple(rows: DataFrame) -> DataFrame:
    return _project(rows, {
        "date": N.parse_date(F.col("date"), ["MM/dd/yyyy"]),
        "description": F.col("description"),
        "merchant": F.coalesce(F.col("merchant"), _first_word(F.col("description"))),
        "raw_amount": N.parse_money(F.col("amount"), signed=True),
        "type": apple_type(F.col("description")),
        "category_hint": F.col("category"),
        "currency": F.lit("USD"),
        "bank": F.lit("apple-card"),
        "source_file": F.col("source_file"),
        "source_line": F.col("source_line"),
    })


def project_wise(rows: DataFrame) -> DataFrame:
    amount = N.parse_money(F.col("amount"), signed=True)
    usd = N.parse_money(F.col("amount_usd"), signed=True)
    rate = F.coalesce(F.col("exchange_rate"), F.lit("1.0")).try_cast("decimal(18,6)")
    return _project(rows, {
        "date": N.parse_date(F.col("date")),
        "description": N.fx_description(F.col("description"), amount, F.col("currency"), usd, rate),
        "merchant": F.col("payee_name"),
        "raw_amount": usd,
        "type": wise_type(F.col("type")),
        "currency": F.lit("USD"),
        "original_amount": amount,
        "original_currency": F.col("currency"),
        "exchange_rate": rate,
        "status": F.col("status"),
        "bank": F.lit("wise"),
        "source_file": F.col("source_file"),
        "source_line": F.col("source_line"),
    })


def project_stripe(rows: DataFrame) -> DataFrame:
    """``rows`` hold one struct ``tx`` each, and ``source_file``."""
    description = F.coalesce(F.col("tx.description"), F.lit(""))
    return _project(rows, {
        "tx_id": F.col("tx.id"),
        "date": F.timestamp_seconds(F.coalesce(F.col("tx.created"), F.lit(0))).cast("date"),
        "description": description,
        "merchant": stripe_merchant(description),
        "raw_amount": N.cents_to_units(F.coalesce(F.col("tx.amount"), F.lit(0))),
        "type": stripe_type(F.col("tx.type")),
        "currency": F.upper(F.coalesce(F.col("tx.currency"), F.lit("USD"))),
        "bank": F.lit("stripe"),
        "source_file": F.col("source_file"),
    })


def combined_to_raw(rows: DataFrame) -> DataFrame:
    """The 14-column export as raw import rows: numeric amount first, merchant falls back on
    the description, and a bad line number on the place in the file."""
    return rows.select(
        "date",
        "description",
        F.coalesce("amount_numeric", "amount_original").alias("amount"),
        F.col("transaction_type").alias("type"),
        "category",
        F.coalesce("merchant", "description").alias("merchant"),
        "currency",
        "account_name",
        "account_number",
        "bank",
        F.coalesce(F.col("source_file_col"), F.col("source_file")).alias("source_file"),
        F.coalesce(F.col("line_number").try_cast("bigint"), F.col("source_line")).alias("source_line"),
        F.col("classification_notes").alias("notes"),
    )


_PROJECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bofa": project_bofa,
    "apple-card": project_apple,
    "wise": project_wise,
}


def read_delimited(spark: SparkSession, paths: str | list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one bank's export, and the lines that were too short or had a bad date or amount."""
    lines = numbered_lines(spark, paths).where(F.col("source_line") > 1)
    return _split_source(lines, source)


def _split_source(lines: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    fields = split_fields(lines, source)
    rows = _PROJECTIONS[source](fields.where(~F.col("short")))
    short = fields.where("short").select(
        "source_file", "source_line", "raw_line", F.lit("short-row").alias("reason")
    )
    broken = rows.where(F.col("date").isNull() | F.col("amount").isNull()).select(
        "source_file",
        "source_line",
        "raw_line",
        F.when(F.col("date").isNull(), "bad-date").otherwise("bad-amount").alias("reason"),
    )
    good = rows.where(F.col("date").isNotNull() & F.col("amount").isNotNull()).drop("raw_line")
    return good, short.unionByName(broken)


def read_stripe(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Transactions of Stripe feeds, and the files that are no such feed, with their text."""
    reader = spark.read.schema(f"{STRIPE_SCHEMA}, _broken STRING").option("columnNameOfCorruptRecord", "_broken")
    feed = reader.option("multiLine", "true").json(paths).select(F.col("_metadata.file_name").alias("source_file"), "data", "_broken")
    rows = feed.where("_broken IS NULL").select("source_file", F.explode("data").alias("tx"))
    unreadable = F.col("_broken").isNotNull() | F.col("data").isNull()
    broken = feed.where(unreadable).select(
        "source_file", F.lit(None).cast("bigint").alias("source_line"), F.col("_broken").alias("raw_line"), F.lit("bad-json").alias("reason")
    )
    return project_stripe(rows), broken


def read_combined(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    lines = numbered_lines(spark, paths).where(F.col("source_line") > 1)
    renamed = lines.withColumnRenamed("source_file", "_file")
    fields = split_fields(renamed, "combined").withColumnRenamed("source_file", "source_file_col")
    fields = fields.withColumnRenamed("_file", "source_file")
    raw = combined_to_raw(fields.where(~F.col("short")))
    short = fields.where("short").select(
        "source_file", "source_line", "raw_line", F.lit("short-row").alias("reason")
    )
    return raw, short


def read_statements(spark: SparkSession, csv_glob: str, json_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All statement files under a glob, each by the reader its name calls for.

    Files of unknown origin are reported in the quarantine and not guessed.
    """
    lines = numbered_lines(spark, csv_glob).withColumn("_source", detect_source(F.col("source_file")))
    lines = lines.where(F.col("source_line") > 1)
    good, bad = [], []
    for source in _PROJECTIONS:
        g, b = _split_source(lines.where(F.col("_source") == source).drop("_source"), source)
        good.append(g)
        bad.append(b)
    unknown = lines.where(~F.col("_source").isin(list(_PROJECTIONS))).select(
        "source_file", "source_line", F.col("text").alias("raw_line"), F.lit("unknown-source").alias("reason")
    )
    rows, quarantine = good[0], bad[0].unionByName(unknown)
    for g, b in zip(good[1:], bad[1:]):
        rows, quarantine = rows.unionByName(g), quarantine.unionByName(b)
    if json_glob:
        feed, broken = read_stripe(spark, json_glob)
        rows = rows.unionByName(feed, allowMissingColumns=True)
        quarantine = quarantine.unionByName(broken)
    return rows, quarantine
