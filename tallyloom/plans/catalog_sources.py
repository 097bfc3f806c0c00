"""Queries of mixed files, registers of entities, saved rule versions and rule catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import classify as C
from tallyloom.operators import entities, quality, summaries, versions
from tallyloom.operators import registry as R
from tallyloom.plans.catalog_cases import _export
from tallyloom.plans.catalog_entities import _BANKED, _MATCH, _REG, _dims
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, with_views
from tallyloom.runtime import shared_path
from tallyloom.sources import statements as S

Q: dict = {}


def add(name, fn, views, body, *ctes):
    sql = with_views(views, body, *ctes) if views or ctes else body
    Q[name] = (lambda s, d: portable(fn(s, d)), sql)


# ---- files of several kinds ------------------------------------------------------------------


def _combined(s, d):
    """Orders as the combined export of fourteen columns, and some as lines that are too short."""
    root = shared_path(s, "combined")
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    money, text = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(None).cast("string")
    columns = [
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("SHOP, "), k.cast("string"), F.lit(' "é"')).alias("description"), F.concat(F.lit("$"), money).alias("amount_original"),
        F.when(k % 10 != 3, money).alias("amount_numeric"), F.col("o_orderstatus").alias("transaction_type"), F.lit("Food").alias("category"), F.when(k % 10 != 4, F.lit("Shop, one")).alias("merchant"), F.lit("USD").alias("currency"),
        text.alias("account_name"), F.lit("12").alias("account_number"), F.lit("bofa").alias("bank"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("source_file"),
        F.when(k % 10 == 9, F.lit("line x")).otherwise((k + 10**9).cast("string")).alias("line_number"), F.when(k % 2 == 0, F.lit("note")).alias("classification_notes"),
    ]
    whole = k % 20 != 7
    o.where(whole).select(*columns).write.option("header", True).option("escape", '"').csv(f"{root}/whole")
    o.where(~whole).select(*columns[:6]).write.option("header", True).option("escape", '"').csv(f"{root}/short")
    raw, short = S.read_combined(s, [f"{root}/whole", f"{root}/short"])
    key = lambda c: F.regexp_extract(c, r"SHOP, (\d+)", 1).cast("bigint")
    rows = raw.select(key("description").alias("k"), F.lit("row").alias("kind"), "amount", "merchant", F.col("type").alias("code"), "source_file",
                      F.when(F.col("source_line") == key("description") + 10**9, F.lit("given")).when(F.col("source_line") > 1, F.lit("counted")).alias("line"), "notes")
    none = lambda n: F.lit(None).cast("string").alias(n)
    return rows.unionByName(short.select(key("raw_line").alias("k"), F.col("reason").alias("kind"), none("amount"), none("merchant"), none("code"), none("source_file"), none("line"), none("notes")))


add("read_combined", _combined, [], """
SELECT o_orderkey AS k, 'row' AS kind, CASE WHEN o_orderkey % 10 = 3 THEN '$' ELSE '' END || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  CASE WHEN o_orderkey % 10 = 4 THEN 'SHOP, ' || CAST(o_orderkey AS VARCHAR) || ' "é"' ELSE 'Shop, one' END AS merchant, o_orderstatus AS code, 'f' || CAST(o_custkey AS VARCHAR) AS source_file,
  CASE WHEN o_orderkey % 10 = 9 THEN 'counted' ELSE 'given' END AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'note' END AS notes FROM orders WHERE o_orderkey % 20 <> 7
UNION ALL SELECT o_orderkey, 'short-row', NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 20 = 7""")


def _mixed(s, d):
    """The exports of three banks under names that tell them apart, in one folder with files of unknown origin, and Stripe feeds."""
    root, target = _export(s, d), shared_path(s, "mixed")
    table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("NOTE "), F.col("o_orderkey").cast("string")).alias("text")).write.option("header", True).csv(f"{root}/notes/0")
    path = s._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for bank in ("bofa", "apple-card", "wise", "notes"):
        for half in (0, 1) if bank != "notes" else (0,):
            for i, status in enumerate(fs.listStatus(path(f"{root}/{bank}/{half}"))):
                if status.getPath().getName().startswith("part-"):
                    fs.rename(status.getPath(), path(f"{target}/{bank}-{half}-{i}.csv"))
    rows, quarantine = S.read_statements(s, f"{target}/*.csv", f"{root}/stripe")
    found = rows.select("bank", F.lit("row").alias("kind"), "description", "date", "amount")
    none = [F.lit(None).cast("date").alias("date"), F.lit(None).cast("decimal(18,2)").alias("amount")]
    bank = F.when(F.col("reason") == "bad-json", "stripe").otherwise(S.detect_source(F.col("source_file")))
    text = F.regexp_extract("raw_line", r"(SHOP, [^\"]*|NOTE \d+)", 1)
    return found.unionByName(quarantine.select(bank.alias("bank"), F.col("reason").alias("kind"), F.when(F.col("reason") != "bad-json", text).alias("description"), *none))


add("read_statements", _mixed, [], """
SELECT bank, kind, 'SHOP, ' || CAST(o_orderkey AS STRING) || ' é' AS description, CASE WHEN kind = 'row' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN kind = 'row' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount
FROM (SELECT *, ['bofa', 'apple-card', 'wise', 'stripe'][(o_orderkey % 4 + 1)::INT] AS bank,
  CASE WHEN o_orderkey % 4 = 3 THEN 'row' WHEN o_orderkey % 10 = 3 THEN 'bad-amount' WHEN o_orderkey % 10 = 4 THEN 'bad-date' ELSE 'row' END AS kind FROM orders)
UNION ALL SELECT 'stripe', 'bad-json', NULL, NULL, NULL
UNION ALL SELECT 'unknown', 'unknown-source', 'NOTE ' || CAST(o_orderkey AS STRING), NULL, NULL FROM orders WHERE o_orderkey % 50 = 0""")

# ---- registers -------------------------------------------------------------------------------


def _register(s, d):
    """Customers registered, some renamed and moved later, some retracted, and of these some registered again."""
    rows = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    at, k = (lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")), F.col("c_custkey")
    first = entities.register(rows, "c_custkey", ["name", "segment", "balance"], at(1), k)
    moved = entities.register(rows.where(k % 3 == 0).withColumns({"segment": F.lit("MOVED"), "balance": F.lit(None)}), "c_custkey", ["segment", "balance"], at(2), k)
    gone = entities.retract(rows.where(k % 5 == 0), "c_custkey", at(3), k)
    back = entities.register(rows.where(k % 10 == 0), "c_custkey", ["name"], at(4), k)
    return first.unionByName(moved).unionByName(gone).unionByName(back)


add("registered_entities", lambda s, d: entities.current_entities(_register(s, d), ["name", "segment", "balance"]), [], """
SELECT CAST(c_custkey AS STRING) AS entity_id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0""")
add("registered_at", lambda s, d: entities.current_entities(_register(s, d), ["name", "segment"], "2024-01-03 12:00:00"), [], """
SELECT CAST(c_custkey AS STRING) AS entity_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0""")
add("registered_by_segment", lambda s, d: entities.current_entities(_register(s, d), ["name", "segment"]).groupBy("segment").agg(F.count(F.lit(1)).alias("entities"), F.min("entity_id").alias("first")), [], """
SELECT segment, COUNT(*) AS entities, min(id) AS first FROM (SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment
  FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0) GROUP BY 1""")

# ---- saved rules -----------------------------------------------------------------------------


def _saved(s, d):
    """Three versions of the parts as rules in one table, and one of another type."""
    path = shared_path(s, "versions")
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pattern"), F.col("p_size").alias("priority"))
    at = lambda n: F.lit(f"2024-0{n}-01 00:00:00").cast("timestamp")
    versions.save_version(part, path, "merchant-rules", at(1), "ana", "initial")
    versions.save_version(part.where("priority > 10"), path, "merchant-rules", at(2), "ben", "fewer")
    versions.save_version(part.where("priority > 20").withColumn("priority", F.col("priority") + 1), path, "merchant-rules", at(3), "ana", "raised")
    versions.save_version(part.where("priority < 5"), path, "duplicate-rules", at(2), "ben", "other")
    return s.read.parquet(path)


add("saved_versions", lambda s, d: versions.list_versions(_saved(s, d)), [], """
SELECT 'merchant-rules' AS rule_type, '2024-01-01 00:00:00.000000' AS ts, 'ana' AS author, 'initial' AS reason, COUNT(*) AS rules FROM part
UNION ALL SELECT 'merchant-rules', '2024-02-01 00:00:00.000000', 'ben', 'fewer', COUNT(*) FILTER (p_size > 10) FROM part
UNION ALL SELECT 'merchant-rules', '2024-03-01 00:00:00.000000', 'ana', 'raised', COUNT(*) FILTER (p_size > 20) FROM part
UNION ALL SELECT 'duplicate-rules', '2024-02-01 00:00:00.000000', 'ben', 'other', COUNT(*) FILTER (p_size < 5) FROM part""")
add("saved_version_at", lambda s, d: versions.version_at(_saved(s, d), "2024-02-15 00:00:00").select("rule_type", "id", "priority"), [], """
SELECT 'merchant-rules' AS rule_type, p_partkey AS id, p_size AS priority FROM part WHERE p_size > 10 UNION ALL SELECT 'duplicate-rules', p_partkey, p_size FROM part WHERE p_size < 5""")
add("saved_version_latest", lambda s, d: versions.load_version(_saved(s, d), "merchant-rules").select("id", "priority", "author"), [],
    "SELECT p_partkey AS id, p_size + 1 AS priority, 'ana' AS author FROM part WHERE p_size > 20")

# ---- what rules and definitions hold ---------------------------------------------------------


def _rules(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_size").collect()
    kind = lambda p: "income" if p.p_size > 45 else None
    return [C.Rule(str(p.p_partkey), p.p_name, False, p.p_name if p.p_partkey % 3 else None, "salary" if p.p_partkey % 7 == 0 else p.p_type if p.p_partkey % 5 else None, kind(p)) for p in rows]


add("rule_catalog", lambda s, d: C.rule_catalog(_rules(s, d), s), [], """
SELECT 'merchant' AS kind, p_name AS id, CAST(NULL AS VARCHAR) AS entry_type FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name
UNION ALL SELECT 'category', c, min(CASE WHEN c = 'salary' OR p_size > 45 THEN 'income' ELSE 'expense' END) FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'salary' WHEN p_partkey % 5 <> 0 THEN p_type END AS c FROM part) WHERE c IS NOT NULL GROUP BY c""")


def _definitions(s, d):
    """A definition for each part, with gaps."""
    k = F.col("p_partkey")
    gap = lambda n, c: F.when(k % n != 0, c)
    return table(s, d, "part").select(k.cast("string").alias("id"), gap(4, F.col("p_brand")).alias("registry"), gap(6, F.col("p_type")).alias("extraction"), gap(9, k % 2 == 0).alias("enabled"), F.col("p_size").alias("priority"))


add("check_definitions", lambda s, d: quality.check_definitions(_definitions(s, d)).select("id", "missing_fields", "valid"), [], """
SELECT CAST(p_partkey AS STRING) AS id, concat_ws('|', CASE WHEN p_partkey % 4 = 0 THEN 'registry' END, CASE WHEN p_partkey % 6 = 0 THEN 'extraction' END, CASE WHEN p_partkey % 9 = 0 THEN 'enabled' END) AS missing_fields,
  p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 AND p_partkey % 9 <> 0 AS valid FROM part""")
add("enabled_definitions", lambda s, d: R.enabled_definitions(_definitions(s, d)).select("id", "priority"), [],
    "SELECT CAST(p_partkey AS STRING) AS id, p_size AS priority FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 2 = 0")

# ---- what a run found ------------------------------------------------------------------------

_BREAK = {"match": "merchant_match", "merchant category": "merchant_category", "budget category": "budget_category", "tax category": "tax_category", "bank": "bank_entity"}
_RUN = f"""rn AS (SELECT tx_id, amount, {_MATCH} AS "match", CASE WHEN category_entity = 'shopping' THEN 'Shopping' WHEN category_entity IS NOT NULL THEN 'Restaurants' ELSE 'Unknown' END AS "merchant category",
  CASE WHEN category_entity = 'shopping' THEN 'Shopping' WHEN category_entity IS NOT NULL THEN 'Living' ELSE 'Uncategorized' END AS "budget category",
  CASE WHEN direction = 'income' THEN 'Taxable Income' WHEN mcc = 5912 THEN 'Medical Deductible' ELSE 'Non-Deductible' END AS "tax category", bank_entity AS "bank" FROM bk)"""
add("run_breakdowns", lambda s, d: summaries.run_breakdowns(_dims(s, d), _BREAK), ["named"], " UNION ALL ".join(
    f"""SELECT '{n}' AS dimension, "{n}" AS value, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS amount, min(tx_id) AS first_id, max(tx_id) AS last_id, ROUND(COUNT(*) / any_value(n), 6) AS share
FROM rn, (SELECT COUNT(*) AS n FROM rn) GROUP BY 2""" for n in _BREAK), _REG, _BANKED, _RUN)
