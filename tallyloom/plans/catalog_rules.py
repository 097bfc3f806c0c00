"""Queries over import, validation, classification and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import normalise as N
from tallyloom.functions.predicates import band_of
from tallyloom.operators import classify as C
from tallyloom.operators import cleaning, extraction, quality, review
from tallyloom.operators import registry as R
from tallyloom.operators.summaries import run_stats
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, view, with_views
from tallyloom.sources import lines as L
from tallyloom.sources import statements as S
from tallyloom.sources.tables import load_config

Q: dict = {}


def add(name, fn, views, body, *ctes):
    Q[name] = (lambda s, d: portable(fn(s, d)), None if body is None else with_views(views, body, *ctes))


def _quote(text):
    return "'" + str(text).replace("'", "''") + "'"


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


# ---- import ----------------------------------------------------------------------------------

_MERCHANT = """regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(merchant)),
  '\\s*,\\s*DES:.*$', ''), '\\s*PURCHASE\\s*:.*$', ''), '\\s*#.*$', ''), '\\s*ID:.*$', '')), '\\s+\\d{5,}$', '')"""
_TAGGED = f"""t AS (SELECT *, COALESCE(try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%Y-%m-%d')) AS day,
  ABS(TRY_CAST(regexp_replace(amount, '[$,]', '', 'g') AS DECIMAL(18,2))) AS money,
  CASE upper(type) WHEN 'GASTO' THEN 'expense' WHEN 'INGRESO' THEN 'income' WHEN 'PAGO_TARJETA' THEN 'transfer'
    WHEN 'TRASPASO' THEN 'transfer' ELSE 'unknown' END AS kind,
  {_case([("contains(upper(bank), " + _quote(w) + ")", _quote(v)) for w, v in N.BANK_WORDS], "'unknown'")} AS bank_id,
  {_case([("contains(lower(category), " + _quote(w) + ")", _quote(v)) for w, v in N.CATEGORY_WORDS], "'uncategorized'")} AS category_id,
  CASE WHEN length(merchant) > 0 THEN regexp_replace(regexp_replace(lower({_MERCHANT}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')
    ELSE 'unknown-merchant' END AS merchant_key FROM raw_rows)"""
_GOOD = """g AS (SELECT * FROM t WHERE day IS NOT NULL AND money > 0 AND kind <> 'unknown')"""
_TX = "'tx-' || substr(sha256(strftime(day, '%Y-%m-%d') || '|' || description || '|' || CAST(money AS STRING) || '|' || source_file || '|' || CAST(source_line AS STRING)), 1, 16)"

add("import_rows", lambda s, d: cleaning.import_rows(view(s, d, "raw_rows"))[0].select(
    "tx_id", "date", "amount", "type", "bank", "merchant", "category", "raw_amount", "idempotency_hash", "provenance.source_line"),
    ["raw_rows"], f"""
SELECT {_TX} AS tx_id, strftime(day, '%Y-%m-%d') AS date, CAST(money AS DOUBLE) AS amount, kind AS type, bank_id AS bank,
  merchant_key AS merchant, category_id AS category, amount AS raw_amount,
  sha256(strftime(day, '%Y-%m-%d') || '|' || CAST(money AS STRING) || '|' || merchant_key || '|' || bank_id) AS idempotency_hash,
  source_line FROM g""", _TAGGED, _GOOD)

add("import_quarantine", lambda s, d: cleaning.import_rows(view(s, d, "raw_rows"))[1].select(
    "source_line", "raw_date", "raw_amount", "raw_type", "reason"), ["raw_rows"], """
SELECT source_line, date AS raw_date, amount AS raw_amount, type AS raw_type,
  CASE WHEN date IS NOT NULL AND day IS NULL THEN 'bad-date' WHEN amount IS NOT NULL AND money IS NULL THEN 'bad-amount'
    WHEN kind = 'unknown' THEN 'bad-type' WHEN day IS NULL THEN 'missing-date' WHEN money IS NULL THEN 'missing-amount'
    ELSE 'amount-not-positive' END AS reason FROM t WHERE NOT (day IS NOT NULL AND COALESCE(money, 0) > 0 AND kind <> 'unknown')""", _TAGGED)


def _fail_loud(s, d):
    good = cleaning.import_rows(view(s, d, "raw_rows"))[0]
    raw = good.select(F.col("raw_date").alias("date"), F.col("raw_amount").alias("amount"), F.col("raw_type").alias("type"), "source_line")
    return cleaning.tag_rows(raw, on_error="fail").select("source_line", "date", "amount", "type")


add("import_fail_loud", _fail_loud, ["raw_rows"],
    "SELECT source_line, strftime(day, '%Y-%m-%d') AS date, CAST(money AS DOUBLE) AS amount, kind AS type FROM g", _TAGGED, _GOOD)

_BRAND = [("contains(upper(trim(merchant)), " + _quote(w) + ")", _quote(v)) for w, v in N.BRAND_WORDS]
add("merchant_with_brands", lambda s, d: view(s, d, "raw_rows").select(
    "source_line", N.normalise_merchant_brands(F.concat(F.col("merchant"), F.when(F.col("bank") == "Stripe Inc", " uber").otherwise(""))).alias("merchant")),
    ["raw_rows"], f"""
SELECT source_line, CASE WHEN length(merchant) > 0 THEN {_case(_BRAND, "CASE WHEN length(regexp_replace(lower(trim(" + _MERCHANT + ")), '\\s+', '-', 'g')) > 2 THEN regexp_replace(lower(trim(" + _MERCHANT + ")), '\\s+', '-', 'g') ELSE 'unknown-merchant' END")} END AS merchant
FROM (SELECT source_line, merchant || CASE WHEN bank = 'Stripe Inc' THEN ' uber' ELSE '' END AS merchant FROM raw_rows)""")


def _signed(s, d, text):
    return view(s, d, "raw_rows").where(~F.col("amount").isin("abc")).select(
        F.lit("f.csv").alias("source_file"), "source_line", *text)


add("parse_bofa", lambda s, d: S.project_bofa(_signed(s, d, [
    F.lit("03/20/2024").alias("date"), F.concat("description", F.lit(" DES:X "), F.when(F.col("category") == "MEDIUM", "credit card payment").otherwise("buy")).alias("description"),
    "amount"])).select("source_line", "date", "merchant", "amount", "type", "currency", "bank"), ["raw_rows"], """
SELECT source_line, '2024-03-20' AS date, split_part(description, ' ', 1) AS merchant, CAST(ABS(a) AS DOUBLE) AS amount,
  CASE WHEN a < 0 AND category = 'MEDIUM' THEN 'transfer' WHEN a > 0 THEN 'income' ELSE 'expense' END AS type, 'USD' AS currency, 'bofa' AS bank
FROM (SELECT *, CAST(replace(amount, '$', '') AS DECIMAL(18,2)) AS a FROM raw_rows WHERE amount <> 'abc')""")

add("parse_apple", lambda s, d: S.project_apple(_signed(s, d, [
    F.lit("03/20/2024").alias("date"), F.concat("description", F.when(F.col("category") == "MEDIUM", " thank you").otherwise("")).alias("description"),
    "amount", "category", F.when(F.col("merchant") != "", F.col("merchant")).alias("merchant")])).select(
        "source_line", "merchant", "amount", "type", "category_hint"), ["raw_rows"], """
SELECT source_line, CASE WHEN merchant <> '' THEN merchant ELSE split_part(description, ' ', 1) END AS merchant,
  CAST(ABS(CAST(replace(amount, '$', '') AS DECIMAL(18,2))) AS DOUBLE) AS amount,
  CASE WHEN category = 'MEDIUM' THEN 'transfer' ELSE 'expense' END AS type, category AS category_hint FROM raw_rows WHERE amount <> 'abc'""")

add("parse_wise", lambda s, d: S.project_wise(_signed(s, d, [
    F.lit("2024-03-20").alias("date"), "description", F.col("merchant").alias("payee_name"), "amount",
    F.when(F.col("category") == "MEDIUM", "EUR").otherwise("USD").alias("currency"), F.lit("1.25").alias("exchange_rate"),
    F.col("amount").alias("amount_usd"), F.when(F.col("bank") == "Wise EU", "Money In").when(F.col("bank") == "Stripe Inc", "money out").alias("type"),
    F.lit("done").alias("status")])).select("source_line", "description", "amount", "type", "original_amount", "original_currency", "exchange_rate"),
    ["raw_rows"], """
SELECT source_line, CASE WHEN category = 'MEDIUM' THEN description || ' | ' || a || ' EUR → $' || a || ' USD @ rate 1.2500' ELSE description END AS description,
  CAST(ABS(a) AS DOUBLE) AS amount, CASE bank WHEN 'Wise EU' THEN 'income' WHEN 'Stripe Inc' THEN 'expense' ELSE 'transfer' END AS type,
  CAST(a AS DOUBLE) AS original_amount, CASE WHEN category = 'MEDIUM' THEN 'EUR' ELSE 'USD' END AS original_currency, CAST(1.25 AS DOUBLE) AS exchange_rate
FROM (SELECT *, CAST(replace(amount, '$', '') AS DECIMAL(18,2)) AS a FROM raw_rows WHERE amount <> 'abc')""")

add("parse_stripe", lambda s, d: S.project_stripe(table(s, d, "events").select(F.lit("s.json").alias("source_file"), F.struct(
    F.concat(F.lit("txn_"), F.col("event_id").cast("string")).alias("id"), F.round(F.col("value") * 100).cast("bigint").alias("amount"),
    F.lit("usd").alias("currency"), F.concat(F.lit("Payment from user "), F.col("user_id").cast("string")).alias("description"),
    F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created"), F.when(F.col("event_type") == "error", "refund").otherwise("charge").alias("type")).alias("tx"))).select(
        "tx_id", "date", "merchant", "amount", "type", "currency"), [], """
SELECT 'txn_' || CAST(event_id AS STRING) AS tx_id, strftime(ts, '%Y-%m-%d') AS date, 'user ' || CAST(user_id AS STRING) AS merchant,
  CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) / 100 AS amount, CASE WHEN event_type = 'error' THEN 'expense' ELSE 'income' END AS type,
  'USD' AS currency FROM events""")
Q["parse_stripe"] = (Q["parse_stripe"][0], Q["parse_stripe"][1].replace("WITH \n", ""))

# The same projections over every row: bad and missing amounts give null amounts.


def _every(s, d, text):
    return view(s, d, "raw_rows").select(F.lit("f.csv").alias("source_file"), "source_line", *text)


add("parse_bofa_all", lambda s, d: S.project_bofa(_every(s, d, [
    F.lit("03/20/2024").alias("date"), F.concat("description", F.lit(" DES:X "), F.when(F.col("category") == "MEDIUM", "credit card payment").otherwise("buy")).alias("description"),
    "amount"])).select("source_line", "date", "merchant", "amount", "type", "currency", "bank"), ["raw_rows"], """
SELECT source_line, '2024-03-20' AS date, split_part(description, ' ', 1) AS merchant, CAST(ABS(a) AS DOUBLE) AS amount,
  CASE WHEN a < 0 AND category = 'MEDIUM' THEN 'transfer' WHEN a > 0 THEN 'income' ELSE 'expense' END AS type, 'USD' AS currency, 'bofa' AS bank
FROM (SELECT *, TRY_CAST(replace(amount, '$', '') AS DECIMAL(18,2)) AS a FROM raw_rows)""")

add("parse_apple_all", lambda s, d: S.project_apple(_every(s, d, [
    F.lit("03/20/2024").alias("date"), F.concat("description", F.when(F.col("category") == "MEDIUM", " thank you").otherwise("")).alias("description"),
    "amount", "category", F.when(F.col("merchant") != "", F.col("merchant")).alias("merchant")])).select(
        "source_line", "merchant", "amount", "type", "category_hint"), ["raw_rows"], """
SELECT source_line, CASE WHEN merchant <> '' THEN merchant ELSE split_part(description, ' ', 1) END AS merchant,
  CAST(ABS(TRY_CAST(replace(amount, '$', '') AS DECIMAL(18,2))) AS DOUBLE) AS amount,
  CASE WHEN category = 'MEDIUM' THEN 'transfer' ELSE 'expense' END AS type, category AS category_hint FROM raw_rows""")

add("parse_wise_all", lambda s, d: S.project_wise(_every(s, d, [
    F.lit("2024-03-20").alias("date"), "description", F.col("merchant").alias("payee_name"), "amount",
    F.when(F.col("category") == "MEDIUM", "EUR").otherwise("USD").alias("currency"), F.lit("1.25").alias("exchange_rate"),
    F.col("amount").alias("amount_usd"), F.when(F.col("bank") == "Wise EU", "Money In").when(F.col("bank") == "Stripe Inc", "money out").alias("type"),
    F.lit("done").alias("status")])).select("source_line", "description", "amount", "type", "original_amount", "original_currency", "exchange_rate"),
    ["raw_rows"], """
SELECT source_line, CASE WHEN category = 'MEDIUM' THEN description || ' | ' || COALESCE(CAST(a AS STRING), 'null') || ' EUR → $' || COALESCE(CAST(a AS STRING), 'null') || ' USD @ rate 1.2500' ELSE description END AS description,
  CAST(ABS(a) AS DOUBLE) AS amount, CASE bank WHEN 'Wise EU' THEN 'income' WHEN 'Stripe Inc' THEN 'expense' ELSE 'transfer' END AS type,
  CAST(a AS DOUBLE) AS original_amount, CASE WHEN category = 'MEDIUM' THEN 'EUR' ELSE 'USD' END AS original_currency, CAST(1.25 AS DOUBLE) AS exchange_rate
FROM (SELECT *, TRY_CAST(replace(amount, '$', '') AS DECIMAL(18,2)) AS a FROM raw_rows)""")

add("detect_source", lambda s, d: view(s, d, "raw_rows").groupBy(S.detect_source(F.lower(F.replace("bank", F.lit(" "), F.lit("-")))).alias("source")).agg(
    F.count(F.lit(1)).alias("rows")), ["raw_rows"], """
SELECT CASE WHEN bank IN ('BofA Checking', 'Bank of America') THEN 'bofa' WHEN bank = 'apple card' THEN 'apple-card'
  WHEN bank = 'Stripe Inc' THEN 'stripe' WHEN bank = 'Wise EU' THEN 'wise' ELSE 'unknown' END AS source, COUNT(*) AS rows FROM raw_rows GROUP BY 1""")

# ---- validation ------------------------------------------------------------------------------

_RULES = [
    {"field": "amount", "required": True, "type": "number", "min": 1000, "max": 90000},
    {"field": "date", "required": True, "type": "string", "pattern": r"\d{4}-\d{2}-\d{2}"},
    {"field": "merchant", "type": "string", "pattern": ".+", "error": "merchant is empty"},
    {"field": "bank", "one_of": ["BofA Checking", "Wise EU", "apple card"]},
    {"field": "account", "required": True},
]
_CHECKED = """c AS (SELECT source_line, CASE WHEN amount IS NULL THEN 'Field amount is required'
  WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'Field amount must be a number'
  WHEN TRY_CAST(amount AS DOUBLE) < 1000 THEN 'Field amount must be >= 1000' WHEN TRY_CAST(amount AS DOUBLE) > 90000 THEN 'Field amount must be <= 90000' END AS e1,
  CASE WHEN date IS NULL THEN 'Field date is required' WHEN NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN 'Field date does not match pattern' END AS e2,
  CASE WHEN merchant = '' THEN 'merchant is empty' END AS e3,
  CASE WHEN bank NOT IN ('BofA Checking', 'Wise EU', 'apple card') THEN 'Field bank must be one of the known values' END AS e4 FROM v)"""
_SRC = "v AS (SELECT source_line, date, merchant, bank, CASE WHEN source_line % 10 > 3 THEN replace(amount, '$', '') ELSE amount END AS amount, 'a' AS account FROM raw_rows)"


def _validated(s, d):
    rows = view(s, d, "raw_rows")
    plain = F.when(F.col("source_line") % 10 > 3, F.replace("amount", F.lit("$"), F.lit(""))).otherwise(F.col("amount"))
    return quality.validate_rows(rows.select("source_line", "date", "merchant", "bank", plain.alias("amount"), F.lit("a").alias("account")), _RULES)


add("validate_rows", lambda s, d: quality.field_errors(_validated(s, d)).select("source_line", "valid", "first_error", "error_text"), ["raw_rows"], """
SELECT source_line, COALESCE(e1, e2, e3, e4) IS NULL AS valid, COALESCE(e1, e2, e3, e4) AS first_error,
  concat_ws('; ', 'amount: ' || e1, 'date: ' || e2, 'merchant: ' || e3, 'bank: ' || e4) AS error_text FROM c""", _SRC, _CHECKED)
add("validation_summary", lambda s, d: quality.validation_summary(_validated(s, d)), ["raw_rows"], """
SELECT COUNT(*) AS total, COUNT(*) FILTER (COALESCE(e1, e2, e3, e4) IS NULL) AS valid_count,
  COUNT(*) FILTER (COALESCE(e1, e2, e3, e4) IS NOT NULL) AS invalid_count FROM c""", _SRC, _CHECKED)
add("violation_counts", lambda s, d: quality.violation_counts(_validated(s, d)), ["raw_rows"], """
SELECT field, message, COUNT(*) AS rows FROM (SELECT 'amount' AS field, e1 AS message FROM c UNION ALL SELECT 'date', e2 FROM c
  UNION ALL SELECT 'merchant', e3 FROM c UNION ALL SELECT 'bank', e4 FROM c) WHERE message IS NOT NULL GROUP BY ALL""", _SRC, _CHECKED)
add("closed_transaction_check", lambda s, d: quality.validate_rows(cleaning.import_rows(view(s, d, "raw_rows"))[0].select(
    F.col("tx_id").alias("id"), F.col("date").cast("string").alias("date"), "amount", "description", "type", "raw_type"),
    quality.TRANSACTION_RULES, closed=True).select("id", F.size("violations").alias("n"), "first_error"), ["raw_rows"], f"""
SELECT {_TX} AS id, CAST(2 AS BIGINT) AS n, 'Field id does not match pattern' AS first_error FROM g""", _TAGGED, _GOOD)

# ---- classification --------------------------------------------------------------------------

_ORDERED = sorted(load_config("merchant_rules"), key=lambda r: -r["priority"])


def _rule_test(r):
    if r["is_regex"]:
        return f"regexp_full_match(upper(description), {_quote(r['pattern'])}) OR regexp_full_match(upper(merchant), {_quote(r['pattern'])})"
    return f"upper(description) = {_quote(r['pattern'])} OR upper(merchant) = {_quote(r['pattern'])}"


_PICK = "k AS (SELECT *, " + _case([(_rule_test(r), i) for i, r in enumerate(_ORDERED)], "NULL") + " AS pos FROM raw_rows)"


def _attr(name, default):
    return "CASE pos " + " ".join(f"WHEN {i} THEN {_quote(r[name]) if isinstance(r[name], str) else r[name]}" for i, r in enumerate(_ORDERED)) + f" ELSE {default} END"


_CLASSIFIED = f"""y AS (SELECT source_line, {_attr('merchant', 'NULL')} AS merchant_id, {_attr('category', "'uncategorized'")} AS category_id,
  CAST({_attr('confidence', 0)} AS DOUBLE) AS confidence, {_attr('id', 'NULL')} AS rule_id, {_attr('type', 'type')} AS type FROM k)"""


def _classified(s, d):
    return C.classify(view(s, d, "raw_rows"))


_COLS = ["source_line", "merchant_id", "category_id", "confidence", "rule_id", "type"]
add("classify", lambda s, d: _classified(s, d).select(*_COLS), ["raw_rows"], "SELECT * FROM y", _PICK, _CLASSIFIED)
add("classify_high_confidence", lambda s, d: C.classify_batch(view(s, d, "raw_rows"), min_confidence="high").select(*_COLS, "classification_version"),
    ["raw_rows"], "SELECT *, '1.0.0' AS classification_version FROM y WHERE confidence >= 0.9", _PICK, _CLASSIFIED)
add("classify_rule_order", lambda s, d: C.classify(view(s, d, "raw_rows"), by_priority=False).select("source_line", "rule_id"), ["raw_rows"],
    "SELECT source_line, " + _case([(_rule_test(r), _quote(r["id"])) for r in load_config("merchant_rules")], "NULL") + " AS rule_id FROM raw_rows")
add("classification_stats", lambda s, d: C.classification_stats(_classified(s, d)), ["raw_rows"], """
SELECT COUNT(*) AS total, COUNT(*) FILTER (category_id <> 'uncategorized') AS classified, COUNT(*) FILTER (category_id = 'uncategorized') AS unclassified,
  COUNT(*) FILTER (confidence >= 0.9) AS high_confidence, COUNT(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium_confidence,
  COUNT(*) FILTER (confidence < 0.7) AS low_confidence FROM y""", _PICK, _CLASSIFIED)
add("classification_counts", lambda s, d: C.classification_counts(_classified(s, d)), ["raw_rows"], """
SELECT 'category_id' AS dimension, category_id AS value, COUNT(*) AS rows FROM y GROUP BY 2
UNION ALL SELECT 'merchant_id', merchant_id, COUNT(*) FROM y GROUP BY 2""", _PICK, _CLASSIFIED)


def _manual(s, d):
    rows = view(s, d, "orders_ledger").select("tx_id", F.col("merchant").alias("description"), "merchant", "type")
    labels = table(s, d, "labels")
    over = labels.select(F.col("doc_id").alias("tx_id"), F.when(F.col("quality") == 1, "good-shop").alias("merchant_id"),
                         F.when(F.col("toxic") == 1, "blocked").alias("category_id"), F.lit(None).cast("string").alias("type"),
                         F.when(F.col("toxic") == 1, 0.5).alias("confidence"))
    return C.classify_manual(C.classify(rows), over).select("tx_id", "merchant_id", "category_id", "confidence", "classified_manually")


add("classify_manual", _manual, ["orders_ledger"], """
SELECT tx_id, CASE WHEN quality = 1 THEN 'good-shop' END AS merchant_id, CASE WHEN toxic = 1 THEN 'blocked' ELSE 'uncategorized' END AS category_id,
  CASE WHEN doc_id IS NULL THEN 0.0 WHEN toxic = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, doc_id IS NOT NULL AS classified_manually
FROM orders_ledger LEFT JOIN labels ON tx_id = doc_id""")

_KNOWN = ["Gizmo", "Plate", "Bolt"]
_DETECT = "w AS (SELECT source_line, " + _case([(f"contains(upper(description), {_quote(m.upper())})", _quote(m)) for m in _KNOWN], "split_part(trim(description), ' ', 1)") + \
    " AS detected_merchant, CASE WHEN " + " OR ".join(f"contains(upper(description), {_quote(m.upper())})" for m in _KNOWN) + " THEN 0.95 ELSE 0.3 END::DOUBLE AS merchant_confidence FROM raw_rows)"


def _detected(s, d):
    rows = view(s, d, "raw_rows")
    table_ = s.createDataFrame([("Gizmo", "tools", "r1", None), ("Plate", "kitchen", "r2", 0.8)], "merchant STRING, category STRING, rule_id STRING, confidence DOUBLE")
    return C.category_of_merchant(C.classify_with(rows, lambda df: C.keyword_merchant(F.col("description"), _KNOWN)), table_)


_CAT = """x AS (SELECT *, CASE detected_merchant WHEN 'Gizmo' THEN 'tools' WHEN 'Plate' THEN 'kitchen' ELSE 'uncategorized' END AS detected_category,
  CASE detected_merchant WHEN 'Gizmo' THEN 0.95 WHEN 'Plate' THEN 0.8 ELSE 0.3 END::DOUBLE AS category_confidence,
  CASE WHEN detected_merchant IN ('Gizmo', 'Plate') THEN 'rule' ELSE 'review' END AS category_method FROM w)"""
add("keyword_merchant_and_category", lambda s, d: _detected(s, d).select("source_line", "detected_merchant", "merchant_confidence", "detected_category",
    "category_confidence", "category_method"), ["raw_rows"], "SELECT * FROM x", _DETECT, _CAT)
add("review_routing", lambda s, d: review.review_counts(review.route(_detected(s, d))), ["raw_rows"], """
SELECT CASE WHEN least(merchant_confidence, category_confidence) >= 0.9 THEN 'auto-approved' ELSE 'pending-review' END AS review_status,
  COUNT(*) AS rows, COUNT(*) FILTER (least(merchant_confidence, category_confidence) < 0.7) AS flagged FROM x GROUP BY 1""", _DETECT, _CAT)


def _decided(s, d):
    rows = _detected(s, d).withColumn("tx_id", F.col("source_line"))
    labels = table(s, d, "labels")
    made = labels.select((F.col("doc_id") * 10 + 1).alias("tx_id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("corrected").alias("kind"),
                         F.lit("ana").alias("decided_by"), F.lit("Fixed").alias("merchant"), F.lit(None).cast("string").alias("category"),
                         F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("doc_id").alias("seq"))
    later = made.where("kind = 'approved'").withColumns({"kind": F.lit("corrected"), "seq": F.col("seq") + 1000000}).where(F.col("tx_id") % 7 == 0)
    return review.apply_decisions(review.route(rows), made.unionByName(later))


_STATE = """dec AS (SELECT doc_id * 10 + 1 AS line, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND (doc_id * 10 + 1) % 7 = 0 THEN 'corrected'
  WHEN quality = 1 THEN 'approved' ELSE 'corrected' END AS kind FROM labels),
st AS (SELECT x.*, least(merchant_confidence, category_confidence) AS mc, kind FROM x LEFT JOIN dec ON source_line = line),
fin AS (SELECT *, CASE WHEN mc >= 0.9 THEN 'auto-approved' WHEN kind IS NOT NULL THEN kind ELSE 'pending-review' END AS review_status FROM st)"""
add("review_decisions", lambda s, d: _decided(s, d).select("source_line", "review_status", "final_merchant", "final_category"), ["raw_rows"], """
SELECT source_line, review_status, CASE WHEN kind = 'corrected' THEN 'Fixed' ELSE detected_merchant END AS final_merchant,
  detected_category AS final_category FROM fin""", _DETECT, _CAT, _STATE)
add("pending_reviews", lambda s, d: review.pending_reviews(_decided(s, d)).select("source_line", "min_confidence"), ["raw_rows"],
    "SELECT source_line, mc AS min_confidence FROM fin WHERE review_status = 'pending-review'", _DETECT, _CAT, _STATE)


def _methods(s, d):
    rows = view(s, d, "event_log")
    method = F.when(F.col("event_type") == "transaction-corrected", "manual").when(F.col("event_type") == "transaction-classified", "rule").otherwise("ml")
    return review.best_classification(rows.select(F.col("aggregate_id").alias("tx_id"), method.alias("method"), F.col("value").alias("confidence"), "ts", "seq"))


add("best_classification", lambda s, d: _methods(s, d).select("tx_id", "method", "confidence", "seq"), ["event_log"], """
SELECT tx_id, method, ROUND(confidence, 6) AS confidence, seq FROM (SELECT aggregate_id AS tx_id, seq, value AS confidence, ts,
  CASE event_type WHEN 'transaction-corrected' THEN 'manual' WHEN 'transaction-classified' THEN 'rule' ELSE 'ml' END AS method,
  row_number() OVER (PARTITION BY aggregate_id ORDER BY CASE event_type WHEN 'transaction-corrected' THEN 3 WHEN 'transaction-classified' THEN 2 ELSE 1 END DESC, value DESC, ts DESC) AS rn
  FROM event_log) WHERE rn = 1""")
add("confidence_bands", lambda s, d: view(s, d, "orders_ledger").groupBy(band_of(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("rows")),
    ["orders_ledger"], """
SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very-low' END AS band,
  COUNT(*) AS rows FROM orders_ledger GROUP BY 1""")

# ---- extraction ------------------------------------------------------------------------------

_TYPES = load_config("type_rules")
_PARTIES = load_config("counterparty_rules")
_NOISE = sorted(load_config("noise_rules"), key=lambda r: r["priority"])


def _found(text, pats, every=False):
    return "(" + (" AND " if every else " OR ").join(f"regexp_matches({text}, {_quote('(?i)' + p)})" for p in pats) + ")"


def _type_test(r):
    test = _found("full_text", r["patterns"], r["requires_all"])
    return test + (f" AND {r['field']} IS NOT NULL" if r["field"] else "")


def _of(rules, at, name, default):
    show = lambda v: "NULL" if v is None else (_quote(v) if isinstance(v, str) else str(v).lower())
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {show(r[name])}" for i, r in enumerate(rules)) + f" ELSE {default} END"


_S1 = "a1 AS (SELECT *, description || ' ' || context_line AS full_text FROM statement_rows), a2 AS MATERIALIZED (SELECT *, " + \
    _case([(_type_test(r), i) for i, r in enumerate(_TYPES)], "NULL") + " AS pos FROM a1)"
_S1B = f"""s1 AS MATERIALIZED (SELECT tx_id, description, context_line, beneficiary_name, full_text, {_of(_TYPES, 'pos', 'type', "'unknown'")} AS type,
  {_of(_TYPES, 'pos', 'direction', "'unknown'")} AS direction, {_of(_TYPES, 'pos', 'merchant_expected', 'true')} AS merchant_expected,
  CAST({_of(_TYPES, 'pos', 'confidence', 0.3)} AS DOUBLE) AS confidence FROM a2)"""
_S2 = "b1 AS MATERIALIZED (SELECT *, CASE WHEN merchant_expected THEN " + _case([(_found("full_text", r["patterns"]), i) for i, r in enumerate(_PARTIES)], "NULL") + " END AS cp FROM s1)"
_HINTS = _case([(f"cp = {i}", f"CASE WHEN regexp_matches(full_text, {_quote('(?i)' + r['extract_after'])}) THEN trim(regexp_extract(full_text, {_quote('(?is)^.*?(?:' + r['extract_after'] + ')(.*)$')}, 1)) END")
                for i, r in enumerate(_PARTIES) if r["extract_after"]], "NULL")
_S2B = f"""b2 AS MATERIALIZED (SELECT *, {_of(_PARTIES, 'cp', 'id', 'NULL')} AS counterparty_id, CAST({_of(_PARTIES, 'cp', 'confidence', 'NULL')} AS DOUBLE) AS cp_confidence,
  CASE WHEN merchant_expected AND type = 'domiciliacion' AND (contains(upper(description), 'COBRANZA') OR contains(upper(description), 'DOMICILIACION'))
    THEN NULLIF(regexp_extract(context_line, '([A-Z]{{3,4}}\\d{{6}}[A-Z0-9]{{3}})', 1), '') END AS rfc, {_HINTS} AS rule_hint FROM b1),
s2 AS MATERIALIZED (SELECT * EXCLUDE (confidence), CASE WHEN merchant_expected THEN COALESCE(rfc, CASE WHEN cp IS NOT NULL THEN rule_hint ELSE COALESCE(beneficiary_name, description) END) END AS hint,
  CASE WHEN cp IS NOT NULL THEN least(confidence, cp_confidence) ELSE confidence END AS confidence FROM b2)"""


def _noise_steps():
    steps = ["n0 AS MATERIALIZED (SELECT *, CASE WHEN merchant_expected THEN COALESCE(NULLIF(hint, ''), beneficiary_name, description) END AS source, "
             "CASE WHEN merchant_expected THEN COALESCE(NULLIF(hint, ''), beneficiary_name, description) END AS txt, 0 AS removed FROM s2)"]
    for i, r in enumerate(_NOISE):
        # The checking engine has no look-ahead: what follows is taken along and put back.
        regex = r["regex"].replace("(?=\\s|$)", "(\\s|$)")
        back = " " if regex == r["regex"] else " \\1"
        hit = "0" if r["keep_as_context"] else f"COALESCE(len(regexp_extract_all(txt, {_quote(regex)})), 0)"
        steps.append(f"n{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (txt, removed), regexp_replace(txt, {_quote(regex)}, {_quote(back)}, 'g') AS txt, removed + {hit} AS removed FROM n{i})")
    steps.append(f"n AS MATERIALIZED (SELECT *, substr(regexp_replace(trim(regexp_replace(txt, '\\s+', ' ', 'g')), '^\\d+\\s+', ''), 1, 100) AS tidy FROM n{len(_NOISE)})")
    steps.append("""s3 AS MATERIALIZED (SELECT * EXCLUDE (confidence), CASE WHEN merchant_expected THEN CASE WHEN length(tidy) >= 3 THEN tidy ELSE COALESCE(source, 'UNKNOWN') END END AS clean_merchant,
  CASE WHEN merchant_expected THEN length(tidy) >= 3 END AS is_clean, CASE WHEN NOT merchant_expected THEN confidence WHEN length(tidy) >= 3
  THEN CASE WHEN removed > 0 THEN confidence * 0.97 ELSE confidence END ELSE 0.1 END AS confidence FROM n)""")
    return ",\n".join(steps)


_STAGES = [_S1, _S1B]
_STAGES2 = [*_STAGES, _S2, _S2B]
_STAGES3 = [*_STAGES2, _noise_steps()]


def _statement(s, d):
    return view(s, d, "statement_rows").withColumn("context_lines", F.array("context_line"))


def _typed(s, d):
    return extraction.detect_types(_statement(s, d))


def _party(s, d):
    return extraction.detect_counterparties(_typed(s, d))


def _clean(s, d):
    return extraction.extract_merchants(_party(s, d))


add("detect_types", lambda s, d: _typed(s, d).select("tx_id", "type", "direction", "merchant_expected", "confidence"), ["statement_rows"],
    "SELECT tx_id, type, direction, merchant_expected, confidence FROM s1", *_STAGES)
add("type_stats", lambda s, d: extraction.type_stats(_typed(s, d)), ["statement_rows"], """
SELECT type, COUNT(*) AS rows, COUNT(*) FILTER (merchant_expected) AS merchant_needed, COUNT(*) FILTER (NOT merchant_expected) AS no_merchant,
  ROUND(AVG(confidence), 6) AS avg_confidence FROM s1 GROUP BY 1""", *_STAGES)
add("direction_report", lambda s, d: extraction.direction_report(_typed(s, d)), ["statement_rows"], """
SELECT direction, COUNT(*) AS rows, COUNT(*) FILTER (NOT merchant_expected) AS ended_early,
  ROUND(COUNT(*) FILTER (NOT merchant_expected) / COUNT(*), 6) AS ended_early_rate FROM s1 GROUP BY 1""", *_STAGES)
add("detect_counterparties", lambda s, d: _party(s, d).select("tx_id", "counterparty.id", "counterparty.hint", "counterparty.rfc", "confidence"),
    ["statement_rows"], "SELECT tx_id, counterparty_id AS id, hint, rfc, ROUND(confidence, 6) AS confidence FROM s2", *_STAGES2)
add("counterparty_stats", lambda s, d: extraction.counterparty_stats(_party(s, d)), ["statement_rows"], """
SELECT COUNT(*) AS total, COUNT(*) FILTER (merchant_expected) AS merchant_rows, COUNT(*) FILTER (cp IS NOT NULL) AS detected,
  COUNT(*) FILTER (merchant_expected AND cp IS NULL) AS direct, ROUND(COUNT(*) FILTER (cp IS NOT NULL) / COUNT(*) FILTER (merchant_expected), 6) AS detection_rate FROM s2""", *_STAGES2)
add("counterparty_report", lambda s, d: extraction.by_counterparty(_party(s, d)), ["statement_rows"], """
SELECT counterparty_id, COUNT(*) AS rows, ROUND(AVG(cp_confidence), 6) AS avg_confidence, string_agg(description, '|' ORDER BY tx_id) FILTER (rn <= 2) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY counterparty_id ORDER BY tx_id) AS rn FROM s2 WHERE cp IS NOT NULL) GROUP BY 1""", *_STAGES2)
add("extract_merchants", lambda s, d: _clean(s, d).select("tx_id", "clean_merchant", "is_clean", "confidence", F.size("removed_noise").alias("noise")),
    ["statement_rows"], "SELECT tx_id, clean_merchant, is_clean, ROUND(confidence, 6) AS confidence, CAST(removed AS BIGINT) AS noise FROM s3", *_STAGES3)
add("extraction_stats", lambda s, d: extraction.extraction_stats(_clean(s, d)), ["statement_rows"], """
SELECT COUNT(*) AS total, COUNT(*) FILTER (merchant_expected) AS merchant_rows, COUNT(clean_merchant) AS extracted,
  COUNT(*) FILTER (merchant_expected AND clean_merchant IS NULL) AS failed, ROUND(AVG(removed) FILTER (merchant_expected), 6) AS avg_noise,
  CAST(SUM(removed) FILTER (merchant_expected) AS BIGINT) AS noise_total, ROUND(AVG(length(clean_merchant)), 6) AS avg_length, MIN(length(clean_merchant)) AS min_length,
  MAX(length(clean_merchant)) AS max_length FROM s3""", *_STAGES3)
add("stage_reports", lambda s, d: quality.stage_reports(_clean(s, d), [1, 3]), ["statement_rows"],
    "SELECT COUNT(*) AS valid, CAST(0 AS BIGINT) AS invalid, unnest([1, 3])::BIGINT AS stage FROM statement_rows")
_TEXT_NOISE = [{"name": "mail", "regex": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "priority": 1}, {"name": "marks", "regex": r"[%#$&*]{3,}", "priority": 2},
               {"name": "numbers", "regex": r"\b[0-9]{4,}\b", "priority": 3, "keep_as_context": True}]
_MAIL, _MARKS, _NUMS = (_quote(r["regex"]) for r in _TEXT_NOISE)
add("strip_document_noise", lambda s, d: extraction.strip_noise(table(s, d, "documents").select("doc_id", "text"), "text", _TEXT_NOISE).select(
    "doc_id", F.sha2("text", 256).alias("digest"), F.size("removed_noise").alias("removed"), F.size("kept_context").alias("kept")), [], f"""
SELECT doc_id, sha256(regexp_replace(t2, {_NUMS}, ' ', 'g')) AS digest, CAST(r1 + len(regexp_extract_all(t1, {_MARKS})) AS BIGINT) AS removed,
  CAST(len(regexp_extract_all(t2, {_NUMS})) AS BIGINT) AS kept FROM (SELECT doc_id, r1, t1, regexp_replace(t1, {_MARKS}, ' ', 'g') AS t2 FROM (
  SELECT doc_id, len(regexp_extract_all(text, {_MAIL})) AS r1, regexp_replace(text, {_MAIL}, ' ', 'g') AS t1 FROM documents))""")
Q["strip_document_noise"] = (Q["strip_document_noise"][0], Q["strip_document_noise"][1].replace("WITH \n", ""))

_DIS = sorted([r for r in load_config("disambiguation_rules") if r["confidence"] >= 0.5], key=lambda r: (-len(r["pattern"]), r["merchant_id"]))


def _dis(s, d):
    return R.disambiguate(view(s, d, "raw_rows").select(
        "source_line", F.when(F.length("merchant") > 0, F.col("merchant")).alias("clean_merchant"), F.lit(0.9).alias("confidence")), load_config("disambiguation_rules"))


_DISQ = "q AS (SELECT source_line, NULLIF(merchant, '') AS name, " + _case([(f"contains(upper(merchant), {_quote(r['pattern'])})", i) for i, r in enumerate(_DIS)], "NULL") + " AS pos FROM raw_rows)"
add("disambiguate", lambda s, d: _dis(s, d).select("source_line", "merchant_id", "merchant_name", "merchant_category", "confidence", "fallback"), ["raw_rows"], f"""
SELECT source_line, COALESCE({_of(_DIS, 'pos', 'merchant_id', 'NULL')}, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '(^-+)|(-+$)', '', 'g')) AS merchant_id,
  COALESCE({_of(_DIS, 'pos', 'merchant_name', 'NULL')}, name) AS merchant_name, {_of(_DIS, 'pos', 'category', 'NULL')} AS merchant_category,
  ROUND(0.9 * {_of(_DIS, 'pos', 'confidence', 0.5)}, 6)::DOUBLE AS confidence, name IS NOT NULL AND pos IS NULL AS fallback FROM q""", _DISQ)
add("disambiguation_report", lambda s, d: R.disambiguation_report(_dis(s, d)), ["raw_rows"], f"""
SELECT merchant_category, fallback, COUNT(*) AS rows, ROUND(AVG(c), 6) AS avg_confidence FROM (SELECT {_of(_DIS, 'pos', 'category', 'NULL')} AS merchant_category,
  name IS NOT NULL AND pos IS NULL AS fallback, (0.9 * {_of(_DIS, 'pos', 'confidence', 0.5)})::DOUBLE AS c FROM q) GROUP BY 1, 2""", _DISQ)

# ---- statement lines -------------------------------------------------------------------------

_LINES = """ln AS (SELECT 'f' || CAST(l_suppkey AS STRING) AS file, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 7 AS base, l_linenumber AS ln, l_quantity AS q,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS amt, l_returnflag AS rf, l_partkey AS pk FROM lineitem),
first AS (SELECT file, base, min(amt) AS amt, max(rf) AS rf, max(ln) AS ln, max(q) AS q, max(pk) AS pk FROM ln GROUP BY file, base),
lines AS (SELECT file, base * 20 AS line_no, '17 JUN ' || CASE rf WHEN 'A' THEN 'ABONO PAGO' WHEN 'R' THEN 'CARGO TIENDA' ELSE 'VARIOS' END || ' $' || amt || ' $1.00' AS text FROM first WHERE ln <> 5
UNION ALL SELECT file, base * 20 + 1, 'RFC/CURP: ABC' || CAST(pk AS STRING) FROM first
UNION ALL SELECT file, base * 20 + 2, 'SALDO ANTERIOR' FROM first
UNION ALL SELECT file, base * 20 + 3, CASE WHEN ln < 3 THEN 'TRANSFERENCIA A JUANA  PEREZ/BANCO' ELSE 'MARIA LOPEZ DIAZ' END FROM first WHERE ln < 6
UNION ALL SELECT file, base * 20 + 4, 'FOLIO: ' || CAST(pk AS STRING) FROM first WHERE q > 25
UNION ALL SELECT file, base * 20 + 5, '-----' FROM first
UNION ALL SELECT file, base * 20 + 6 + k, 'nota ' || CAST(k AS STRING) || ' larga' FROM first, (SELECT unnest(range(9))::BIGINT AS k) WHERE rf = 'N')"""


def _lines(s, d):
    rows = table(s, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 7).alias("base"),
        F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amt"), F.col("l_returnflag").alias("rf"), F.col("l_partkey").alias("pk"))
    one = rows.groupBy("file", "base").agg(F.min("amt").alias("amt"), F.max("rf").alias("rf"), F.max("ln").alias("ln"), F.max("q").alias("q"), F.max("pk").alias("pk"))
    name = F.when(F.col("rf") == "A", "ABONO PAGO").when(F.col("rf") == "R", "CARGO TIENDA").otherwise("VARIOS")
    cell = lambda at, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(at).alias("at"), text.alias("text")))
    cells = [
        cell(0, F.concat(F.lit("17 JUN "), name, F.lit(" $"), "amt", F.lit(" $1.00")), F.col("ln") != 5),
        cell(1, F.concat(F.lit("RFC/CURP: ABC"), F.col("pk").cast("string"))),
        cell(2, F.lit("SALDO ANTERIOR")),
        cell(3, F.when(F.col("ln") < 3, "TRANSFERENCIA A JUANA  PEREZ/BANCO").otherwise("MARIA LOPEZ DIAZ"), F.col("ln") < 6),
        cell(4, F.concat(F.lit("FOLIO: "), F.col("pk").cast("string")), F.col("q") > 25),
        cell(5, F.lit("-----")),
        *[cell(6 + k, F.lit(f"nota {k} larga"), F.col("rf") == "N") for k in range(9)],
    ]
    flat = one.select("file", "base", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return flat.select("file", (F.col("base") * 20 + F.col("c.at")).alias("line_no"), F.col("c.text").alias("text"))


_SEG = """own AS (SELECT *, regexp_matches(text, '^\\d{1,2}\\s+[A-Z]{3}\\s+') AS st, max(CASE WHEN regexp_matches(text, '^\\d{1,2}\\s+[A-Z]{3}\\s+') THEN line_no END)
  OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS rec FROM lines),
ctx AS (SELECT file, rec, text, row_number() OVER (PARTITION BY file, rec ORDER BY line_no) AS k FROM own
  WHERE rec IS NOT NULL AND NOT st AND text NOT LIKE 'SALDO%' AND text <> '-----'),
grp AS (SELECT file, rec, string_agg(CASE WHEN k <= 10 THEN text END, '|' ORDER BY k) AS context_lines, min(CASE WHEN text LIKE 'RFC/CURP:%' THEN k END) AS rk, arg_min(CASE WHEN text LIKE 'RFC/CURP:%' THEN trim(replace(text, 'RFC/CURP:', '')) END, k) FILTER (text LIKE 'RFC/CURP:%') AS rfc,
  string_agg(CASE WHEN contains(text, 'FOLIO:') THEN text END, ' | ' ORDER BY k) AS reference,
  CASE WHEN bool_or(contains(text, 'TRANSFERENCIA A')) THEN 'JUANA PEREZ' WHEN bool_or(text = 'MARIA LOPEZ DIAZ') THEN 'MARIA LOPEZ DIAZ' END AS beneficiary_name
  FROM ctx GROUP BY 1, 2)"""
add("segment_statement_lines", lambda s, d: L.segment_statement_lines(_lines(s, d)).select(
    "file", "record_line", "date", "description", "amount", "retiro", "deposit", "beneficiary_name", "rfc", "reference", "context_lines"), [], """
SELECT m.file, m.line_no AS record_line, '17-JUN' AS date, regexp_extract(m.text, '^17 JUN (.+?) \\$', 1) AS description, a AS amount,
  CASE WHEN regexp_matches(m.text, 'CARGO') OR regexp_matches(m.text, 'VARIOS') THEN a END AS retiro, CASE WHEN regexp_matches(m.text, 'ABONO') THEN a END AS deposit,
  beneficiary_name, rfc, reference, COALESCE(context_lines, '') AS context_lines
FROM (SELECT *, CAST(regexp_extract(text, '\\$([\\d.]+) ', 1) AS DOUBLE) AS a FROM own WHERE st) m LEFT JOIN grp g ON m.file = g.file AND m.line_no = g.rec""", _LINES, _SEG)


def _run(s, d):
    return run_stats(_clean(s, d).withColumn("merchant_resolved", F.lit(None).cast("boolean")))


add("run_stats", _run, ["statement_rows"], """
SELECT COUNT(*) AS total, COUNT(*) FILTER (type <> 'unknown') AS typed, COUNT(*) FILTER (merchant_expected) AS merchant_expected,
  COUNT(*) FILTER (cp IS NOT NULL) AS counterparty_detected, COUNT(clean_merchant) AS extracted, CAST(0 AS BIGINT) AS merchant_resolved FROM s3""", *_STAGES3)
