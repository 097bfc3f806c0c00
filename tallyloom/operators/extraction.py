"""Statement rows to clean merchant names in three steps: type, counterparty, noise removal.

Each step is a chain of expressions compiled from an ordered rule table, so the three steps
together stay one narrow projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.normalise import text_after
from tallyloom.operators.cleaning import once
from tallyloom.operators.classify import _pick, first_match
from tallyloom.operators.rule_index import required_literal
from tallyloom.sources.tables import load_config

# Tax-id format, generic payment words and extraction limits.
TAX_ID = r"[A-Z]{3,4}\d{6}[A-Z0-9]{3}"
GENERIC_PHRASES = ["COBRANZA", "DOMICILIACION", "PAGO DOMICILIADO", "CARGO DOMICILIADO"]
DIRECT_DEBIT = "domiciliacion"
MIN_NAME, MAX_NAME = 3, 100
#: Noise patterns whose steps are compiled together.
TOGETHER = 5
NOISE_FACTOR, FALLBACK_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.97, 0.10, 0.30


def _column(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_full_text(df: DataFrame) -> DataFrame:
    """``_text``: the description and the context lines as one searchable text; ``_upper``: the same in upper case."""
    context = F.array_join(F.coalesce(_column(df, "context_lines", "array<string>"), F.array().cast("array<string>")), " ")
    text = df.withColumn("_text", F.concat(F.coalesce("description", F.lit("")), F.lit(" "), context))
    return text.withColumn("_upper", F.upper("_text"))


def _found(patterns: Sequence[str], every: bool = False) -> Column:
    """Whether ``_text`` matches one of some regexes, or each. Only texts that hold a regex's literal are searched for the rest of it."""
    tests = []
    for p in patterns:
        test, literal = F.col("_text").rlike(f"(?i){p}"), required_literal(p)
        tests.append(F.col("_upper").contains(literal.upper()) & test if literal and literal.isascii() else test)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def _apart(col: Column) -> Column:
    """``col``, as the only item of a list that is filtered. Spark compiles such a step apart from those before and after it. The code of many steps in one method
    passes the 8,000 bytes up to which Java compiles a method, and all of it is interpreted for each row."""
    return F.get(F.array_compact(F.array(col)), F.lit(0))


def detect_types(df: DataFrame, rules: Sequence[Mapping] | None = None) -> DataFrame:
    """Transaction type, direction and whether a merchant is expected; the first rule wins."""
    rules = load_config("type_rules") if rules is None else rules
    tests = []
    for r in rules:
        test = _found(r["patterns"], r.get("requires_all", False))
        if r.get("field"):
            test = test & _column(df, r["field"], "string").isNotNull()
        tests.append(test)
    matched = with_full_text(df).withColumn("_at", first_match(tests))
    at, hit = F.col("_at"), F.col("_at").isNotNull()
    name = _pick([r["type"] for r in rules], at, "string")
    return once(
        matched,
        {
            "type": F.coalesce(name, F.lit("unknown")),
            "direction": F.coalesce(_pick([r["direction"] for r in rules], at, "string"), F.lit("unknown")),
            "merchant_expected": F.coalesce(
                _pick([r["merchant_expected"] for r in rules], at, "boolean"), F.lit(True)
            ),
            "confidence": F.coalesce(
                _pick([r["confidence"] for r in rules], at, "double"), F.lit(UNKNOWN_CONFIDENCE)
            ),
            "stage_1": F.struct(
                F.when(hit, "pattern-match").otherwise("no-match").alias("detected_by"),
                name.alias("matched_rule"),
            ),
        },
    ).drop("_at", "_text", "_upper")


def tax_id_in(text: Column) -> Column:
    found = F.regexp_extract(text, f"({TAX_ID})", 1)
    return F.when(found != "", found)



def detect_counterparties(df: DataFrame, rules: Sequence[Mapping] | None = None) -> DataFrame:
    """Aggregators and marketplaces between payer and merchant, with a hint at the merchant.

    Rows that expect no merchant are passed through. A direct debit with a generic description is
    identified by the tax id in its context lines.
    """
    rules = load_config("counterparty_rules") if rules is None else rules
    expected = F.col("merchant_expected")
    tests = [expected & _found(r["patterns"]) for r in rules]
    matched = with_full_text(df).withColumn("_at", first_match(tests))
    at, hit = F.col("_at"), F.col("_at").isNotNull()
    upper = F.upper(F.coalesce("description", F.lit("")))
    generic = reduce(lambda a, b: a | b, [upper.contains(p) for p in GENERIC_PHRASES])
    context = F.array_join(_column(df, "context_lines", "array<string>"), " ")
    rfc = F.when(expected & (F.col("type") == DIRECT_DEBIT) & generic, tax_id_in(context))
    hints = [
        F.when(at == i, text_after(F.col("_text"), r["extract_after"]))
        for i, r in enumerate(rules, start=1)
        if r.get("extract_after")
    ]
    rule_hint = F.coalesce(*hints) if hints else F.lit(None).cast("string")
    plain_hint = F.coalesce(_column(df, "beneficiary_name", "string"), F.col("description"))
    hint = F.when(expected, F.coalesce(rfc, F.when(hit, rule_hint).otherwise(plain_hint)))
    rule_conf = _pick([r["confidence"] for r in rules], at, "double")
    info = F.struct(
        hit.alias("detected"),
        _pick([r["id"] for r in rules], at, "string").alias("id"),
        _pick([r["type"] for r in rules], at, "string").alias("type"),
        _pick([r.get("category") for r in rules], at, "string").alias("category"),
        hint.alias("hint"),
        rfc.alias("rfc"),
        rule_conf.alias("confidence"),
    )
    how = F.when(~expected, "no-merchant-expected").when(hit, "pattern-match").otherwise("no-match")
    return once(
        matched,
        {
            "counterparty": info,
            "confidence": F.when(hit, F.least("confidence", rule_conf)).otherwise(F.col("confidence")),
            "stage_2": F.struct(how.alias("detected_by"), (rfc.isNotNull()).alias("tax_id_used")),
        },
    ).drop("_at", "_text", "_upper")


def merchant_text(df: DataFrame) -> Column:
    """Hint, else beneficiary, else description."""
    hint = F.col("counterparty.hint")
    return F.coalesce(
        F.when(hint != "", hint), _column(df, "beneficiary_name", "string"), F.col("description")
    )


def strip_noise(df: DataFrame, text: str, patterns: Sequence[Mapping] | None = None) -> DataFrame:
    """Apply the noise patterns in priority order to column ``text``.

    Adds ``removed_noise`` and ``kept_context``; each pattern sees the text the former ones left. A pattern that names a text which
    each match holds (``needs``) runs only on rows that hold it, and none is replaced where none is found.

    What is found is gathered every ``TOGETHER`` patterns, which are compiled apart from the next.
    """
    rules = load_config("noise_rules") if patterns is None else patterns
    none = F.array().cast("array<string>")
    found: dict[str, list[Column]] = {"removed_noise": [], "kept_context": []}

    def gathered() -> dict[str, Column]:
        return {n: F.coalesce(F.concat(*parts), none) if parts else none for n, parts in found.items()}

    ordered = sorted(rules, key=lambda r: r.get("priority", 99))
    for i, rule in enumerate(ordered):
        regex = rule["regex"]
        hits = F.regexp_extract_all(F.col(text), F.lit(regex), 0)
        if rule.get("needs"):
            hits = F.when(F.col(text).contains(rule["needs"]), hits).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_n{i}", hits)
        df = df.withColumn(text, F.when(F.size(f"_n{i}") > 0, F.regexp_replace(text, regex, " ")).otherwise(F.col(text)))
        found["kept_context" if rule.get("keep_as_context") else "removed_noise"].append(F.col(f"_n{i}"))
        if i % TOGETHER == TOGETHER - 1 and i + 1 < len(ordered):
            df = df.withColumns({text: _apart(F.col(text)), **{f"_{n}": c for n, c in gathered().items()}}).drop(*[f"_n{j}" for j in range(i + 1)])
            found = {n: [F.col(f"_{n}")] for n in found}
    return df.withColumns(gathered()).drop(*[f"_n{i}" for i in range(len(ordered))], *[f"_{n}" for n in found])


def tidy_name(df: DataFrame, text: str) -> DataFrame:
    """Column ``text`` with single spaces, no leading number, 3 to 100 characters (shorter is null)."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    tidy = df.withColumn(text, F.substring(F.regexp_replace(clean, r"^\d+\s+", ""), 1, MAX_NAME))
    return once(tidy, {text: F.when(F.length(text) >= MIN_NAME, F.col(text))})


def extract_merchants(df: DataFrame, patterns: Sequence[Mapping] | None = None) -> DataFrame:
    expected = F.col("merchant_expected")
    work = df.withColumn("_source", _apart(F.when(expected, merchant_text(df)))).withColumn("_name", F.col("_source"))
    work = tidy_name(strip_noise(work, "_name", patterns), "_name")
    clean = F.col("_name")
    ok = clean.isNotNull()
    scored = F.when(F.size("removed_noise") > 0, F.col("confidence") * NOISE_FACTOR).otherwise(F.col("confidence"))
    method = F.when(~ok, "fallback").when(F.col("counterparty.detected"), "post-counterparty")
    return work.withColumns(
        {
            "clean_merchant": F.when(expected, F.coalesce(clean, "_source", F.lit("UNKNOWN"))),
            "is_clean": F.when(expected, ok),
            "confidence": F.when(~expected, F.col("confidence")).when(ok, scored).otherwise(FALLBACK_CONFIDENCE),
            "stage_3": F.when(
                expected,
                F.struct(
                    method.otherwise("full-description").alias("method"),
                    F.size("removed_noise").alias("noise_count"),
                ),
            ),
        }
    ).drop("_source", "_name")


def extract(df: DataFrame) -> DataFrame:
    return extract_merchants(detect_counterparties(detect_types(df)))


def type_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("merchant_expected").alias("merchant_needed"),
        F.count_if(~F.col("merchant_expected")).alias("no_merchant"),
        F.avg("confidence").alias("avg_confidence"),
    )


def direction_report(df: DataFrame) -> DataFrame:
    return df.groupBy("direction").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("merchant_expected")).alias("ended_early"),
        (F.count_if(~F.col("merchant_expected")) / F.count(F.lit(1))).alias("ended_early_rate"),
    )


def counterparty_stats(df: DataFrame) -> DataFrame:
    with_merchant = F.col("merchant_expected")
    hit = with_merchant & F.col("counterparty.detected")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(with_merchant).alias("merchant_rows"),
        F.count_if(hit).alias("detected"),
        F.count_if(with_merchant & ~F.col("counterparty.detected")).alias("direct"),
        (F.count_if(hit) / F.count_if(with_merchant)).alias("detection_rate"),
    )


def by_counterparty(df: DataFrame, examples: int = 2) -> DataFrame:
    """Count and mean confidence per counterparty, with the first example descriptions."""
    hits = df.where(F.col("merchant_expected") & F.col("counterparty.detected")).select(
        F.col("counterparty.id").alias("counterparty_id"),
        F.col("counterparty.confidence").alias("confidence"),
        "description",
        "tx_id",
    )
    stats = hits.groupBy("counterparty_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence")
    )
    return stats.join(top_examples(hits, "counterparty_id", "description", examples), "counterparty_id", "left")


def top_examples(df: DataFrame, key: str, text: str, n: int, order: str = "tx_id") -> DataFrame:
    """The first ``n`` texts per key. Spark cuts such a ranking before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    kept = df.select(key, text, order).withColumn("_place", place).where(F.col("_place") <= n)
    picked = F.array_sort(F.collect_list(F.struct("_place", F.col(text).alias("text"))))
    return kept.groupBy(key).agg(F.transform(picked, lambda x: x["text"]).alias("examples"))


def extraction_stats(df: DataFrame) -> DataFrame:
    need = F.col("merchant_expected")
    done = need & F.col("clean_merchant").isNotNull()
    noise, length = F.size("removed_noise"), F.length("clean_merchant")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(need).alias("merchant_rows"),
        F.count_if(done).alias("extracted"),
        F.count_if(need & F.col("clean_merchant").isNull()).alias("failed"),
        F.avg(F.when(done, noise)).alias("avg_noise"),
        F.sum(F.when(done, noise)).alias("noise_total"),
        F.avg(F.when(done, length)).alias("avg_length"),
        F.min(F.when(done, length)).alias("min_length"),
        F.max(F.when(done, length)).alias("max_length"),
    )
