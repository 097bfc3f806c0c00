"""Queries over the ledger: statistics, balances, filters, paging, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.skew import first_per_key
from tallyloom.operators import balance, ledger_query, sequences, summaries
from tallyloom.operators.anomaly import zscore_anomalies
from tallyloom.plans.portable import portable
from tallyloom.plans.views import view, with_views

Q: dict = {}

SIGNED = "CASE type WHEN 'income' THEN amount WHEN 'expense' THEN -amount ELSE 0 END"
INC = "SUM(CASE WHEN type = 'income' THEN amount ELSE 0 END)"
EXP = "SUM(CASE WHEN type = 'expense' THEN amount ELSE 0 END)"
DAY = "strftime(date, '%Y-%m-%d')"


def add(name, fn, views, body, *ctes):
    Q[name] = (lambda s, d: portable(fn(s, d)), None if body is None else with_views(views, body, *ctes))


def led(s, d):
    return view(s, d, "orders_ledger")


add("ledger_statistics", lambda s, d: summaries.ledger_statistics(led(s, d)), ["orders_ledger"], f"""
SELECT COUNT(*) AS total, CAST({INC} AS DOUBLE) AS income, CAST({EXP} AS DOUBLE) AS expenses,
  CAST({INC} - {EXP} AS DOUBLE) AS net, COUNT(*) FILTER (confidence >= 0.9) AS high_confidence,
  COUNT(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium_confidence,
  COUNT(*) FILTER (confidence < 0.7) AS low_confidence, COUNT(*) FILTER (NOT verified) AS unverified
FROM orders_ledger""")

add("ledger_counts", lambda s, d: summaries.counts_by(view(s, d, "ledger"), ["type", "bank", "category"]), ["ledger"], """
SELECT 'type' AS dimension, type AS value, COUNT(*) AS rows FROM ledger GROUP BY type
UNION ALL SELECT 'bank', bank, COUNT(*) FROM ledger GROUP BY bank
UNION ALL SELECT 'category', category, COUNT(*) FROM ledger GROUP BY category""")

add("monthly_summary", lambda s, d: summaries.monthly_summary(led(s, d)), ["orders_ledger"], f"""
SELECT strftime(date, '%Y-%m') AS month, CAST({INC} AS DOUBLE) AS income, CAST({EXP} AS DOUBLE) AS expenses,
  CAST({INC} - {EXP} AS DOUBLE) AS net, COUNT(*) AS rows FROM orders_ledger GROUP BY 1""")

add("sum_by_type", lambda s, d: balance.sum_by_type(led(s, d)), ["orders_ledger"],
    "SELECT COALESCE(type, 'unknown') AS type, CAST(SUM(amount) AS DOUBLE) AS total FROM orders_ledger GROUP BY 1")

add("net_cashflow", lambda s, d: balance.net_cashflow(led(s, d)), ["orders_ledger"],
    f"SELECT CAST({INC} - {EXP} AS DOUBLE) AS net FROM orders_ledger")

add("running_balance", lambda s, d: balance.running_balance(led(s, d), 1000).select(
    "tx_id", "account_id", "date", "balance"), ["orders_ledger"], f"""
SELECT tx_id, account_id, {DAY} AS date, CAST(1000 + SUM({SIGNED}) OVER (PARTITION BY account_id
  ORDER BY date, tx_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM orders_ledger""")

add("running_balance_hot", lambda s, d: balance.running_balance(
    led(s, d).withColumn("book", F.when(F.col("account_id") % 3 == 0, "main").otherwise("side")), 0, "book",
    share=0.2, floor=100).select("tx_id", "book", "balance"), ["orders_ledger"], f"""
SELECT tx_id, CASE WHEN account_id % 3 = 0 THEN 'main' ELSE 'side' END AS book,
  CAST(SUM({SIGNED}) OVER (PARTITION BY CASE WHEN account_id % 3 = 0 THEN 'main' ELSE 'side' END
  ORDER BY date, tx_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM orders_ledger""")

add("running_balance_global", lambda s, d: balance.running_balance(led(s, d), 0, None).select(
    "tx_id", "balance"), ["orders_ledger"], f"""
SELECT tx_id, CAST(SUM({SIGNED}) OVER (ORDER BY date, tx_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
FROM orders_ledger""")

add("final_balance", lambda s, d: balance.final_balance(led(s, d), 500, ["account_id"]), ["orders_ledger"],
    f"SELECT account_id, CAST(500 + SUM({SIGNED}) AS DOUBLE) AS final_balance FROM orders_ledger GROUP BY 1")


def _targets(s, d, key):
    sums = balance.final_balance(view(s, d, "ledger"), 100, [key])
    size = F.length(F.col(key).cast("string"))
    return sums.where(size != 2).select(
        key, F.lit(100).cast("decimal(18,2)").alias("starting_balance"),
        (F.col("final_balance") + F.when(size == 3, 0).otherwise(F.lit(0.25).cast("decimal(18,2)"))).alias("ending_balance"))


def _reconcile_sql(key, where="true"):
    return f"""
SELECT m.{key} AS {key}, m.rows AS rows, CAST(COALESCE(t.s, 0) + m.moved AS DOUBLE) AS calculated,
  CAST(COALESCE(t.e, 0) AS DOUBLE) AS expected, CAST(COALESCE(t.s, 0) + m.moved - COALESCE(t.e, 0) AS DOUBLE) AS difference,
  ABS(COALESCE(t.s, 0) + m.moved - COALESCE(t.e, 0)) <= 0.01 AS reconciled
FROM (SELECT {key}, COUNT(*) AS rows, SUM({SIGNED}) AS moved FROM ledger WHERE {where} GROUP BY 1) m
LEFT JOIN (SELECT {key}, 100 AS s, 100 + SUM({SIGNED}) + CASE WHEN length(CAST({key} AS STRING)) = 3 THEN 0 ELSE 0.25 END AS e
  FROM ledger WHERE length(CAST({key} AS STRING)) <> 2 GROUP BY {key}) t ON m.{key} = t.{key}"""


add("reconcile_accounts", lambda s, d: balance.reconcile(view(s, d, "ledger"), _targets(s, d, "account_id"), ["account_id"]),
    ["ledger"], _reconcile_sql("account_id"))
add("reconcile_currencies", lambda s, d: balance.reconcile(view(s, d, "ledger"), _targets(s, d, "currency"), ["currency"]),
    ["ledger"], _reconcile_sql("currency"))
add("reconcile_period", lambda s, d: balance.reconcile_period(
    view(s, d, "ledger"), "1996-01-01", "1997-12-31", _targets(s, d, "bank"), ["bank"]),
    ["ledger"], _reconcile_sql("bank", "date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"))
add("reconcile_ledger", lambda s, d: balance.reconcile_all(led(s, d), 10, 20), ["orders_ledger"], f"""
SELECT COUNT(*) AS rows, CAST(10 + SUM({SIGNED}) AS DOUBLE) AS calculated, CAST(20 AS DOUBLE) AS expected,
  CAST(10 + SUM({SIGNED}) - 20 AS DOUBLE) AS difference, ABS(10 + SUM({SIGNED}) - 20) <= 0.01 AS reconciled FROM orders_ledger""")


def _verify(s, d):
    sums = balance.final_balance(led(s, d), 0, ["account_id"]).select(
        "account_id", F.lit(0).cast("decimal(18,2)").alias("starting_balance"), F.col("final_balance").alias("ending_balance"))
    return balance.verify_balance(balance.reconcile(led(s, d), sums, ["account_id"])).select("account_id", "reconciled", "calculated")


add("verify_balances", _verify, ["orders_ledger"],
    f"SELECT account_id, true AS reconciled, CAST(SUM({SIGNED}) AS DOUBLE) AS calculated FROM orders_ledger GROUP BY 1")

add("reconciliation_report", lambda s, d: balance.reconciliation_report(
    view(s, d, "ledger"), _targets(s, d, "account_id"), _targets(s, d, "currency"))["by_account"].groupBy("reconciled").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("difference").alias("difference")), ["ledger"],
    f"SELECT reconciled, COUNT(*) AS accounts, ROUND(SUM(CAST(difference AS DECIMAL(18,2))), 2)::DOUBLE AS difference FROM ({_reconcile_sql('account_id')}) GROUP BY 1")

add("find_discrepancies", lambda s, d: balance.find_discrepancies(
    view(s, d, "coarse").withColumn("type", F.when(F.col("status") == "posted", F.col("type")))
    .withColumn("amount", (F.col("amount") * 250).cast("decimal(18,2)"))), ["coarse"], f"""
SELECT tx_id, {DAY} AS date, CAST(amount AS DOUBLE) AS amount, type, issue FROM c, LATERAL (
  SELECT unnest(list_filter([CASE WHEN type IS NULL THEN 'missing-type' END, CASE WHEN amount > 10000 THEN 'large-amount' END,
  CASE WHEN n > 1 THEN 'potential-duplicate' END], lambda x: x IS NOT NULL)) AS issue)""",
    """c AS (SELECT tx_id, date, CAST(amount * 250 AS DECIMAL(18,2)) AS amount, CASE WHEN status = 'posted' THEN type END AS type,
  COUNT(*) OVER (PARTITION BY date, amount) AS n FROM coarse)""")

add("currency_summary", lambda s, d: summaries.currency_summary(view(s, d, "ledger").select(
    F.col("currency").alias("original_currency"), F.col("amount").alias("original_amount"),
    (F.lit(1) + F.col("confidence")).alias("exchange_rate"))), ["ledger"], """
SELECT currency AS original_currency, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS total,
  ROUND(AVG(1 + confidence), 6) AS avg_rate FROM ledger GROUP BY 1""")

add("group_stats", lambda s, d: summaries.group_stats(view(s, d, "ledger"), "category", "amount"), ["ledger"], """
SELECT category, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS total, CAST(MIN(amount) AS DOUBLE) AS smallest,
  CAST(MAX(amount) AS DOUBLE) AS largest FROM ledger GROUP BY 1""")

add("sum_by_merchant", lambda s, d: summaries.sum_by(led(s, d), "merchant", "amount"), ["orders_ledger"],
    "SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total FROM orders_ledger GROUP BY 1")

add("api_stats", lambda s, d: summaries.api_stats(led(s, d)), ["orders_ledger"], """
SELECT COUNT(*) AS total, strftime(MIN(date), '%Y-%m-%d') AS first_date, strftime(MAX(date), '%Y-%m-%d') AS last_date,
  COUNT(*) FILTER (type = 'income') AS n_income, COUNT(*) FILTER (type = 'expense') AS n_expense,
  COUNT(*) FILTER (type = 'transfer') AS n_transfer, COUNT(*) FILTER (type = 'unknown') AS n_unknown FROM orders_ledger""")

add("history_stats", lambda s, d: summaries.history_stats(led(s, d).select(
    F.col("merchant").alias("source_file"), "type", F.col("verified").alias("merchant_resolved"),
    (F.col("confidence") < 0.5).alias("needs_classification"))), ["orders_ledger"], """
SELECT 'source_file' AS dimension, merchant AS value, COUNT(*) AS rows FROM orders_ledger GROUP BY 2
UNION ALL SELECT 'type', type, COUNT(*) FROM orders_ledger GROUP BY 2
UNION ALL SELECT 'resolved', CAST(verified AS STRING), COUNT(*) FROM orders_ledger GROUP BY 2
UNION ALL SELECT 'needs_classification', CAST(confidence < 0.5 AS STRING), COUNT(*) FROM orders_ledger GROUP BY 2""")

add("confidence_distribution", lambda s, d: summaries.confidence_distribution(led(s, d)), ["orders_ledger"], """
SELECT COUNT(*) FILTER (confidence >= 0.9) AS high, COUNT(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium,
  COUNT(*) FILTER (confidence < 0.7) AS low, ROUND(AVG(confidence), 6) AS average, MIN(confidence) AS lowest,
  MAX(confidence) AS highest FROM orders_ledger""")

add("type_report", lambda s, d: summaries.type_report(view(s, d, "ledger")), ["ledger"], """
SELECT type, COUNT(*) AS rows, ROUND(AVG(confidence), 6) AS avg_confidence,
  (SELECT string_agg(description, '|' ORDER BY tx_id) FROM (SELECT description, tx_id FROM ledger i WHERE i.type = o.type
   ORDER BY tx_id LIMIT 2)) AS examples FROM ledger o GROUP BY type""")

add("transactions_by_merchant", lambda s, d: ledger_query.query_ledger(led(s, d), {"filters": {"merchant": "2-HIGH"}}).select("tx_id", "amount"),
    ["orders_ledger"], "SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM orders_ledger WHERE merchant = '2-HIGH'")
add("transactions_by_bank", lambda s, d: ledger_query.query_ledger(view(s, d, "ledger"), {"filters": {"bank": "bank-3"}}).select("tx_id", "amount"),
    ["ledger"], "SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE bank = 'bank-3'")
add("transactions_by_category", lambda s, d: ledger_query.query_ledger(view(s, d, "ledger"), {"filters": {"category": "BUILDING"}}).select("tx_id", "amount"),
    ["ledger"], "SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE category = 'BUILDING'")
add("transactions_by_type", lambda s, d: ledger_query.query_ledger(led(s, d), {"filters": {"type": "expense"}}).select("tx_id", "amount"),
    ["orders_ledger"], "SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM orders_ledger WHERE type = 'expense'")
add("transactions_half_open", lambda s, d: ledger_query.in_half_open(led(s, d), "1996-03-01", "1996-04-01").select("tx_id", "date"),
    ["orders_ledger"], f"SELECT tx_id, {DAY} AS date FROM orders_ledger WHERE date >= DATE '1996-03-01' AND date < DATE '1996-04-01'")
add("transactions_closed_range", lambda s, d: ledger_query.in_closed(led(s, d), None, "1996-04-01").select("tx_id", "date"),
    ["orders_ledger"], f"SELECT tx_id, {DAY} AS date FROM orders_ledger WHERE date <= DATE '1996-04-01'")
for _level, _cond in (("high", "confidence >= 0.9"), ("medium", "confidence >= 0.7 AND confidence < 0.9"), ("low", "confidence < 0.7")):
    add(f"confidence_{_level}", lambda s, d, lv=_level: ledger_query.by_confidence(led(s, d), lv).select("tx_id", "confidence"),
        ["orders_ledger"], f"SELECT tx_id, ROUND(confidence, 6) AS confidence FROM orders_ledger WHERE {_cond}")
add("confidence_threshold", lambda s, d: ledger_query.above_confidence(led(s, d), 0.35).select("tx_id"),
    ["orders_ledger"], "SELECT tx_id FROM orders_ledger WHERE confidence >= 0.35")
add("unverified_transactions", lambda s, d: ledger_query.unverified(led(s, d)).select("tx_id"),
    ["orders_ledger"], "SELECT tx_id FROM orders_ledger WHERE NOT verified")

add("spec_query", lambda s, d: ledger_query.query_ledger(view(s, d, "ledger"), {"filters": {
    "amount": ("between", (50000, 250000)), "category": ("in", ["BUILDING", "MACHINERY"]), "type": ("!=", "transfer"),
    "merchant": ("matches", "[1-3]-.*"), "confidence": (">", 0.2), "account_id": ("<=", 1000), "bank": ("starts-with", "bank-1"),
    "description": ("contains", "-")}}).select("tx_id", "amount"), ["ledger"], """
SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE amount BETWEEN 50000 AND 250000
  AND category IN ('BUILDING', 'MACHINERY') AND type <> 'transfer' AND regexp_full_match(merchant, '[1-3]-.*')
  AND confidence > 0.2 AND account_id <= 1000 AND starts_with(bank, 'bank-1') AND contains(description, '-')""")
add("spec_query_rare_operators", lambda s, d: ledger_query.query_ledger(view(s, d, "ledger"), {"filters": {
    "category": ("not-in", ["BUILDING"]), "type": ("not", "income"), "merchant": ("ends-with", "W"), "bank": ("not-nil",),
    "amount": ("<", 200000), "confidence": (">=", 0.1)}}).select("tx_id"), ["ledger"], """
SELECT tx_id FROM ledger WHERE category NOT IN ('BUILDING') AND type <> 'income' AND suffix(merchant, 'W') AND bank IS NOT NULL
  AND amount < 200000 AND confidence >= 0.1""")
add("spec_query_ordered", lambda s, d: ledger_query.query_ledger(led(s, d), {"filters": {"type": "income"},
    "order": [("amount", "desc"), "tx_id"], "offset": 20, "limit": 30}).select("tx_id", "amount"), ["orders_ledger"], """
SELECT tx_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT * FROM orders_ledger WHERE type = 'income'
  ORDER BY amount DESC, tx_id LIMIT 30 OFFSET 20)""")


def _versions(s, d):
    rows = view(s, d, "event_log").select(
        F.col("event_type").alias("entity_type"), F.col("aggregate_id").alias("entity_id"), "ts",
        F.col("seq").alias("version"), "value")
    return ledger_query.query_ledger(rows, {"versions": "latest", "as_of": "2024-01-20 00:00:00",
                                            "filters": {"value": (">", 10.0)}}).select("entity_type", "entity_id", "version")


add("spec_query_latest_as_of", _versions, ["event_log"], """
SELECT entity_type, entity_id, version FROM (SELECT event_type AS entity_type, aggregate_id AS entity_id, seq AS version, value,
  row_number() OVER (PARTITION BY event_type, aggregate_id ORDER BY ts DESC, seq DESC) AS rn FROM event_log
  WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE rn = 1 AND value > 10""")

add("transaction_page", lambda s, d: ledger_query.list_transactions(
    led(s, d), "1996-01-01", None, "expense", offset=50, limit=25)[0].select("tx_id", "date"), ["orders_ledger"], f"""
SELECT tx_id, {DAY} AS date FROM (SELECT * FROM orders_ledger WHERE type = 'expense' AND date >= DATE '1996-01-01'
  ORDER BY date DESC, tx_id LIMIT 25 OFFSET 50)""")
add("transaction_page_total", lambda s, d: ledger_query.list_transactions(led(s, d), "1996-01-01", None, "expense")[1],
    ["orders_ledger"], "SELECT COUNT(*) AS total FROM orders_ledger WHERE type = 'expense' AND date >= DATE '1996-01-01'")


def _names(s, d):
    dims = view(s, d, "ledger")
    dim = lambda c: dims.select(F.col(c).alias("entity_id"), F.initcap(c).alias("canonical_name")).distinct()
    return ledger_query.with_names(dims.select("tx_id", "bank", "merchant", "category"), dim("bank"), dim("merchant"), dim("category")).select(
        "tx_id", F.lower("bank_name").alias("bank_name"), F.lower("merchant_name").alias("merchant_name"), F.lower("category_name").alias("category_name"))


add("readable_transactions", _names, ["ledger"], """
SELECT tx_id, lower(bank) AS bank_name, lower(merchant) AS merchant_name, lower(category) AS category_name FROM ledger""")

add("keep_first_by_key", lambda s, d: first_per_key(
    led(s, d).select("account_id", "merchant", "tx_id", "amount"), ["account_id", "merchant"], [F.col("tx_id")]), ["orders_ledger"], """
SELECT account_id, merchant, tx_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (
  PARTITION BY account_id, merchant ORDER BY tx_id) AS rn FROM orders_ledger) WHERE rn = 1""")

add("row_batches", lambda s, d: sequences.row_batches(led(s, d), ["date", "tx_id"], 50, ["tx_id", "amount"]).select(
    "batch", "rows", F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)")).alias("total"),
    F.col("items")[0]["tx_id"].alias("first_id")), ["orders_ledger"], """
SELECT CAST(p // 50 AS BIGINT) AS batch, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS total, arg_min(tx_id, p) AS first_id
FROM (SELECT *, row_number() OVER (ORDER BY date, tx_id) - 1 AS p FROM orders_ledger) GROUP BY 1""")

add("sliding_windows", lambda s, d: sequences.sliding_windows(
    led(s, d), ["date", "tx_id"], 3, ["tx_id", "amount"], chunk=1000).select(
        "start", F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)")).alias("total"),
        F.col("items")[2]["tx_id"].alias("last_id")), ["orders_ledger"], """
SELECT start, CAST(total AS DOUBLE) AS total, last_id FROM (SELECT p AS start, amount + LEAD(amount, 1) OVER w + LEAD(amount, 2) OVER w AS total,
  LEAD(tx_id, 2) OVER w AS last_id FROM (SELECT *, row_number() OVER (ORDER BY date, tx_id) - 1 AS p FROM orders_ledger)
  WINDOW w AS (ORDER BY p)) WHERE last_id IS NOT NULL""")

add("take_until", lambda s, d: sequences.take_until(led(s, d), ["date", "tx_id"], F.col("amount") > 499000).select("tx_id"),
    ["orders_ledger"], """
SELECT tx_id FROM orders_ledger WHERE (date, tx_id) < (SELECT (date, tx_id) FROM orders_ledger WHERE amount > 499000 ORDER BY date, tx_id LIMIT 1)
  OR NOT EXISTS (SELECT 1 FROM orders_ledger WHERE amount > 499000)""")

_MOMENTS = """m AS (SELECT *, COUNT(*) OVER w AS n, AVG(CAST(amount AS DOUBLE)) OVER w AS mean,
  VAR_POP(CAST(amount AS DOUBLE)) OVER w AS var FROM {v} WINDOW w AS (PARTITION BY {k})),
r AS (SELECT *, (n * mean - amount) / NULLIF(n - 1, 0) AS rm FROM m),
z AS (SELECT *, sqrt(greatest(var * n - (amount - mean) * (amount - rm), 0) / NULLIF({div}, 0)) AS sd FROM r)"""


def _zsql(v, k, div, limit):
    return [v], f"""
SELECT tx_id, n - 1 AS history_rows, ROUND(rm + 0.0000001, 4) AS history_mean, ROUND(CASE WHEN n - 1 >= 3 THEN ABS(amount - rm) / sd END, 4) AS z_score,
  COALESCE(n - 1 >= 3 AND ABS(amount - rm) / sd > {limit}, false) AS is_anomaly FROM z""", _MOMENTS.format(v=v, k=k, div=div)


def _zrows(df):
    return df.select("tx_id", "history_rows", F.round(F.col("history_mean") + 0.0000001, 4).alias("history_mean"),
                     F.round("z_score", 4).alias("z_score"), "is_anomaly")


add("amount_anomalies", lambda s, d: _zrows(zscore_anomalies(view(s, d, "feed"))), *_zsql("feed", "merchant", "n - 1", 2.5))
add("amount_anomalies_sample", lambda s, d: _zrows(zscore_anomalies(led(s, d), key="account_id", mode="sample")),
    *_zsql("orders_ledger", "account_id", "n - 2", 2.0))
