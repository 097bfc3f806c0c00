"""Cleaning and identity expressions used by the import jobs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, codes and keywords that imported files use.
DATE_FORMATS = ["MM/dd/yyyy", "yyyy-MM-dd"]
TYPE_CODES = {
    "GASTO": "expense",
    "INGRESO": "income",
    "PAGO_TARJETA": "transfer",
    "TRASPASO": "transfer",
}
BANK_WORDS = [
    ("BOFA", "bofa"),
    ("BANK OF AMERICA", "bofa"),
    ("APPLE", "apple-card"),
    ("STRIPE", "stripe"),
    ("WISE", "wise"),
    ("SCOTIA", "scotiabank"),
]
CATEGORY_WORDS = [
    ("restaurant", "restaurants"),
    ("food", "restaurants"),
    ("grocer", "groceries"),
    ("shopping", "shopping"),
    ("transport", "transportation"),
    ("entertainment", "entertainment"),
    ("salary", "salary"),
    ("freelance", "freelance"),
    ("payment", "payment"),
    ("transfer", "transfer"),
]
BRAND_WORDS = [
    (b, b.lower())
    for b in ["STARBUCKS", "AMAZON", "UBER", "STRIPE", "APPLE", "GOOGLE", "NETFLIX", "SPOTIFY"]
]
MERCHANT_CUTS = [r"\s*,\s*DES:", r"\s*PURCHASE\s*:", r"\s*#", r"\s*ID:"]
TRAILING_ID = r"\s+\d{5,}$"


def first_containing(col: Column, words: list[tuple[str, str]], default: Column) -> Column:
    """Value of the first word found in ``col``, in list order."""
    found = F.coalesce(*[F.when(col.contains(word), F.lit(value)) for word, value in words])
    return F.coalesce(found, default)


def parse_date(col: Column, formats: list[str] | None = None) -> Column:
    """Strict parse of the known formats; anything else is null."""
    # The shape test spares the parser the cost of failing on rows of another format.
    parsed = [
        F.when(col.rlike("^" + re.sub("[A-Za-z]", "[0-9]", f) + "$"), F.try_to_timestamp(col, F.lit(f)).cast("date"))
        for f in formats or DATE_FORMATS
    ]
    return F.coalesce(*parsed)


def parse_money(col: Column, signed: bool = False) -> Column:
    value = F.regexp_replace(F.trim(col), r"[$,]", "").try_cast("decimal(18,2)")
    return value if signed else F.abs(value)


def parse_number(col: Column) -> Column:
    return F.regexp_replace(col, r"[$,]", "").try_cast("double")


def normalise_type(col: Column) -> Column:
    code = F.upper(col)
    chain = reduce(
        lambda acc, kv: acc.when(code == kv[0], F.lit(kv[1])),
        list(TYPE_CODES.items())[1:],
        F.when(code == next(iter(TYPE_CODES)), F.lit(TYPE_CODES[next(iter(TYPE_CODES))])),
    )
    return F.when(col.isNotNull(), chain.otherwise(F.lit("unknown")))


def normalise_bank(col: Column) -> Column:
    return F.when(col.isNotNull(), first_containing(F.upper(col), BANK_WORDS, F.lit("unknown")))


def normalise_category(col: Column) -> Column:
    return first_containing(F.lower(col), CATEGORY_WORDS, F.lit("uncategorized"))


def _merchant_core(col: Column) -> Column:
    text = F.upper(F.trim(col))
    for cut in MERCHANT_CUTS:
        text = F.split(text, cut, 2)[0]
    return F.regexp_replace(F.trim(text), TRAILING_ID, "")


def normalise_merchant(col: Column) -> Column:
    """Lower-kebab merchant key; empty or missing names become ``unknown-merchant``."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(_merchant_core(col)), r"\s+", "-"), r"[^a-z0-9-]", "")
    return F.when(F.length(col) > 0, kebab).otherwise(F.lit("unknown-merchant"))


def normalise_merchant_brands(col: Column) -> Column:
    """As ``normalise_merchant`` with well-known brands recognised anywhere in the text."""
    kebab = F.regexp_replace(F.lower(F.trim(_merchant_core(col))), r"\s+", "-")
    plain = F.when(F.length(kebab) > 2, kebab).otherwise(F.lit("unknown-merchant"))
    return F.when(F.length(col) > 0, first_containing(F.upper(F.trim(col)), BRAND_WORDS, plain))


def transaction_id(date: Column, description: Column, amount: Column, source_file: Column, line: Column) -> Column:
    """``tx-`` and 16 hex digits of SHA-256 over the stable fields; nulls keep their slot."""
    fields = [
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("")),
        F.upper(F.trim(F.coalesce(description, F.lit("")))),
        F.coalesce(amount.cast("decimal(18,2)").cast("string"), F.lit("")),
        F.coalesce(source_file, F.lit("unknown")),
        F.coalesce(line.cast("string"), F.lit("0")),
    ]
    return F.concat(F.lit("tx-"), F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 16))


def content_hash(*cols: Column) -> Column:
    """SHA-256 over the values with nulls kept apart from empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]), 256)


def kebab(col: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9]+", "-"), r"(^-+)|(-+$)", ""
    )


def title_from_kebab(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("-"), F.lit(" ")))


def squash(col: Column) -> Column:
    """Comparison form of names: upper case, trimmed, single spaces."""
    return F.upper(F.trim(F.regexp_replace(col, r"\s+", " ")))


def file_prefix(col: Column) -> Column:
    """Lower-case part of a file name before the first underscore."""
    return F.lower(F.split(col, "_", 2)[0])


def fill_template(template: str, fields: list[str]) -> Column:
    """``{field}`` templates; null when a field is missing."""
    text = F.lit(template)
    for name in fields:
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return text


def text_after(text: Column, pattern: str) -> Column:
    """Trimmed text after the first match; null without a match."""
    rest = F.regexp_extract(text, f"(?is)^.*?(?:{pattern})(.*)$", 1)
    return F.when(text.rlike(f"(?i){pattern}"), F.trim(rest))


def cents_to_units(col: Column) -> Column:
    return (col.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")


def fx_description(description: Column, amount: Column, currency: Column, usd: Column, rate: Column) -> Column:
    detail = F.format_string(
        "%s | %s %s → $%s USD @ rate %s",
        F.coalesce(description, F.lit("")),
        amount.cast("decimal(18,2)").cast("string"),
        currency,
        usd.cast("decimal(18,2)").cast("string"),
        rate.cast("decimal(18,4)").cast("string"),
    )
    return F.when(currency == "USD", description).otherwise(detail)
