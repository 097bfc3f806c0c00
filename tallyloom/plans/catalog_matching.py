"""Queries of matching: card payments against charges, names inside texts, names within a few edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import card_payments, contained, duplicates, edit_join
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, view, with_views

Q: dict = {}


def add(name, fn, views, body, *ctes):
    sql = with_views(views, body, *ctes) if views or ctes else body
    Q[name] = (lambda s, d: portable(fn(s, d)), sql)


# ---- card payments ---------------------------------------------------------------------------

_CARD = {r["id"]: r for r in duplicates.load_duplicate_rules()}["credit-card-payment-matching"] | {"fields": ["date", "account_id"]}
_TRAILING = """c AS (SELECT *, datediff('day', DATE '1970-01-01', date) AS dn, CAST(round(amount * 100) AS BIGINT) AS ct FROM card_ledger),
t AS (SELECT account_id, dn, SUM(ct) AS ct, COUNT(*) AS n, min(tx_id) AS first_id FROM c WHERE bank = 'apple-card' GROUP BY 1, 2),
w AS (SELECT y.tx_id, y.account_id, y.date, y.ct, y.dn - a.dn AS days_back, SUM(b.n)::BIGINT AS charges, min(b.first_id) AS first_id FROM c y
  JOIN t a ON a.account_id = y.account_id AND y.dn - a.dn BETWEEN 0 AND 5 JOIN t b ON b.account_id = a.account_id AND b.dn BETWEEN a.dn AND y.dn
  WHERE y.bank = 'bofa' GROUP BY 1, 2, 3, 4, 5 HAVING SUM(b.ct) = y.ct)"""


def _settled(s, d, **kw):
    rows = view(s, d, "card_ledger").select("tx_id", "account_id", "bank", duplicates.day_number(F.col("date")).alias("day"), duplicates.cents(F.col("amount")).alias("cents"))
    return card_payments.settled_payments(rows.where("bank = 'bofa'").drop("bank"), rows.where("bank = 'apple-card'").drop("bank"), ["account_id"], 5, **kw)


add("card_payments_by_card", lambda s, d: _settled(s, d).select("tx_id", "account_id", "windows", "days_back", "charges", "first_id"), ["card_ledger"], """
SELECT tx_id, account_id, COUNT(*) AS windows, min(days_back) AS days_back, arg_min(charges, days_back) AS charges, arg_min(first_id, days_back) AS first_id FROM w GROUP BY 1, 2""", _TRAILING)
add("duplicates_card_payment_by_card", lambda s, d: duplicates.rule_links(view(s, d, "card_ledger"), _CARD).select("tx_id", "match_id", "matches"), ["card_ledger"], """
SELECT tx_id, arg_min(first_id, days_back) AS match_id, arg_min(charges, days_back) AS matches FROM w GROUP BY 1""", _TRAILING)


def _open_payments(s, d):
    rows = view(s, d, "card_ledger").where("bank = 'bofa'")
    met = _settled(s, d, share=0.0001, floor=1).select("tx_id", F.lit(True).alias("met"))
    return rows.join(met, "tx_id", "left").groupBy(F.coalesce("met", F.lit(False)).alias("settled")).agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"))


add("card_payments_open", _open_payments, ["card_ledger"], """
SELECT w.tx_id IS NOT NULL AS settled, COUNT(*) AS payments, CAST(SUM(amount) AS DOUBLE) AS amount FROM c LEFT JOIN (SELECT DISTINCT tx_id FROM w) w USING (tx_id) WHERE bank = 'bofa' GROUP BY 1""", _TRAILING)

# ---- names inside texts ----------------------------------------------------------------------


def _inside(s, d, **kw):
    """Parts, brands and segments looked for in the context of each kind of line."""
    texts = view(s, d, "statement_rows").select(F.lower("description").alias("text")).distinct()
    part = table(s, d, "part")
    names = part.select(F.col("p_name").alias("name"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("owner"))
    names = names.unionByName(part.select(F.lower("p_type").alias("name"), F.concat(F.lit("type-"), F.lower("p_brand")).alias("owner")))
    # Names of one to two hundred characters: numbers, and one that no text holds.
    names = names.unionByName(part.select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("key-"), F.col("p_partkey").cast("string")).alias("owner")))
    names = names.unionByName(part.select(F.repeat(F.concat("p_name", F.lit(" ")), 20).alias("name"), F.lit("long").alias("owner")))
    return contained.longest_contained(texts, names.groupBy("name").agg(F.min("owner").alias("owner")), **kw)


_NAMES = """texts AS (SELECT DISTINCT lower(description) AS text FROM statement_rows),
named_parts AS (SELECT name, min(owner) AS owner FROM (SELECT p_name AS name, 'part-' || p_partkey AS owner FROM part UNION ALL SELECT lower(p_type), 'type-' || lower(p_brand) FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'key-' || p_partkey FROM part UNION ALL SELECT repeat(p_name || ' ', 20), 'long' FROM part) GROUP BY 1)"""
_LONGEST = """
SELECT text, name, owner FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY length(name) DESC, owner, name) AS place FROM texts JOIN named_parts ON contains(text, name)) WHERE place = 1"""
add("names_inside", lambda s, d: _inside(s, d), ["statement_rows"], _LONGEST, _NAMES)
add("names_inside_sharded", lambda s, d: _inside(s, d, limit=3000, per_task=400), ["statement_rows"], _LONGEST, _NAMES)

# ---- names within a few edits ----------------------------------------------------------------


def _similar(s, d, **kw):
    """Part names of one size with their brand, compared with all others."""
    names = table(s, d, "part").select("p_size", F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("name")).groupBy("p_size", "name").agg(F.count(F.lit(1)).alias("parts"))
    pairs = edit_join.similar_pairs(names, ["p_size"], "name", 3, ["parts"], **kw)
    return pairs.select("p_size", F.col("a.name").alias("longer"), F.col("b.name").alias("shorter"), (F.col("a.parts") * F.col("b.parts")).alias("pairs"))


_SIMILAR = """
SELECT p_size, a.name AS longer, b.name AS shorter, a.parts * b.parts AS pairs FROM n a JOIN n b USING (p_size)
WHERE (length(a.name) > length(b.name) OR (length(a.name) = length(b.name) AND a.name > b.name)) AND levenshtein(a.name, b.name) <= 3"""
_SIZED = "n AS (SELECT p_size, p_name || ' ' || lower(p_brand) AS name, COUNT(*) AS parts FROM part GROUP BY 1, 2)"
add("similar_names", lambda s, d: _similar(s, d), [], "WITH " + _SIZED + _SIMILAR)
add("similar_names_crowded", lambda s, d: _similar(s, d, crowd=2, per_task=3), [], "WITH " + _SIZED + _SIMILAR)
