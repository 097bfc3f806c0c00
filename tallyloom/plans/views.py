"""The given tables seen as ledgers, statement rows, event logs and registries.

Each view is one SQL text that Spark and the checking engine both understand, so both start from the same
rows; ``<name>`` marks a table and ``SHA[ ... ]`` a SHA-256 digest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_SIZE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
_LINE_ID = (
    "'tx-' || substr(SHA[CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) || '|' || "
    "CAST(l_partkey AS STRING) || '|' || CAST(l_suppkey AS STRING) || '|' || " + _SIZE + "], 1, 16)"
)

VIEWS = {
    # Orders as a ledger; their customer gives bank, category and currency.
    "ledger": """
        SELECT o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'expense' ELSE 'transfer' END AS type,
               o_custkey AS account_id, 'bank-' || CAST(c_nationkey AS STRING) AS bank,
               c_mktsegment AS category, o_orderpriority AS merchant,
               CASE WHEN c_nationkey < 12 THEN 'USD' ELSE 'EUR' END AS currency,
               CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence,
               o_orderpriority = '1-URGENT' AS verified,
               o_orderpriority || ' ' || c_mktsegment AS description
        FROM <orders> JOIN <customer> ON o_custkey = c_custkey""",
    # The same ledger without the customer columns: no join for queries that need none.
    "orders_ledger": """
        SELECT o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'expense' ELSE 'transfer' END AS type,
               o_custkey AS account_id, o_orderpriority AS merchant,
               CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence,
               o_orderpriority = '1-URGENT' AS verified
        FROM <orders>""",
    # Order lines from three sources.
    "feed": f"""
        SELECT {_LINE_ID} AS tx_id, CAST(l_shipdate AS DATE) AS date,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag AS source,
               'supplier-' || CAST(l_suppkey AS STRING) AS merchant
        FROM <lineitem>""",
    # Order lines with round amounts, so that the duplicate rules have much to find.
    "coarse": f"""
        SELECT {_LINE_ID} AS tx_id, CAST(l_shipdate AS DATE) AS date,
               CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_discount > 0.08 THEN 0.01 ELSE 0.00 END AS amount,
               CASE l_linestatus WHEN 'O' THEN -1 ELSE 1 END AS sign,
               'shop ' || CAST(l_suppkey % 100 AS STRING) AS merchant,
               CASE l_linenumber WHEN 1 THEN 'bofa' WHEN 2 THEN 'apple-card' WHEN 3 THEN 'stripe'
                    WHEN 4 THEN 'wise' ELSE 'scotiabank' END AS bank,
               l_returnflag AS source,
               CASE WHEN l_tax < 0.04 THEN 'pending' ELSE 'posted' END AS status,
               CASE l_linestatus WHEN 'O' THEN 'expense' ELSE CASE WHEN l_tax < 0.03 THEN 'transfer' ELSE 'income' END END AS type,
               l_linestatus || l_returnflag AS description
        FROM <lineitem>""",
    # Order lines as charges of their customer's card over four days, and a payment an order: most settle the charges of a few days, some nothing.
    "card_ledger": f"""
        SELECT {_LINE_ID} AS tx_id, 'card-' || CAST(o_custkey AS STRING) AS account_id,
               CAST(o_orderdate AS DATE) + CAST(l_linenumber % 4 AS INTEGER) AS date, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               'apple-card' AS bank, 'expense' AS type
        FROM <lineitem> JOIN <orders> ON l_orderkey = o_orderkey
        UNION ALL
        SELECT 'pay-' || CAST(o_orderkey AS STRING), 'card-' || CAST(o_custkey AS STRING),
               CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 4 AS INTEGER),
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
                    ELSE CAST(SUM(CASE WHEN l_linenumber % 4 >= o_orderkey % 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) END,
               'bofa', 'transfer'
        FROM <orders> JOIN <lineitem> ON l_orderkey = o_orderkey
        GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice""",
    # Order lines rendered as the raw text of an import file, with faults.
    "raw_rows": f"""
        SELECT CASE WHEN l_quantity = 13 THEN 'n/a' WHEN l_quantity = 14 THEN NULL
                    WHEN l_linenumber < 4 THEN substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 1, 4)
                    ELSE {_DAY} END AS date,
               CASE WHEN l_quantity = 17 THEN 'abc' WHEN l_quantity = 18 THEN '0.00' WHEN l_quantity = 19 THEN NULL
                    WHEN l_returnflag = 'R' THEN '-' || {_SIZE} ELSE '$' || {_SIZE} END AS amount,
               CASE WHEN l_tax = 0.08 THEN 'otro' WHEN l_linestatus = 'O' THEN 'GASTO'
                    WHEN l_returnflag = 'A' THEN 'ingreso' WHEN l_returnflag = 'N' THEN 'TRASPASO' ELSE 'pago_tarjeta' END AS type,
               CASE l_linenumber WHEN 1 THEN 'BofA Checking' WHEN 2 THEN 'Bank of America' WHEN 3 THEN 'apple card'
                    WHEN 4 THEN 'Stripe Inc' WHEN 5 THEN 'Wise EU' WHEN 6 THEN 'Scotiabank' ELSE 'Other Bank' END AS bank,
               CASE WHEN l_discount = 0.01 THEN '' WHEN l_discount = 0.02 THEN p_name || ', DES:' || p_type
                    WHEN l_discount = 0.03 THEN p_name || ' 0012345' WHEN l_discount = 0.04 THEN p_name || ' ID:77 x'
                    ELSE p_name || ' ' || p_brand END AS merchant,
               CASE p_type WHEN 'ECONOMY' THEN 'Fast Food' WHEN 'SMALL' THEN 'Groceries' WHEN 'LARGE' THEN 'Online Shopping'
                    WHEN 'PROMO' THEN 'Transport' ELSE p_type END AS category,
               upper(p_name) AS description,
               'orders.csv' AS source_file,
               l_orderkey * 10 + l_linenumber AS source_line
        FROM <lineitem> JOIN <part> ON l_partkey = p_partkey""",
    # Order lines as bank statement rows with context, one shape per line number.
    "statement_rows": f"""
        SELECT {_LINE_ID} AS tx_id, CAST(l_shipdate AS DATE) AS date,
               CASE l_linenumber
                    WHEN 1 THEN 'CARG RECUR. ' || upper(p_name) || ' REF. ' || CAST(10000000 + l_orderkey AS STRING)
                    WHEN 2 THEN 'TRANSF INTERBANCARIA SPEI'
                    WHEN 3 THEN 'COBRANZA DOMICILIADA'
                    WHEN 4 THEN 'CLIP ' || upper(p_name) || ' AUT. ' || CAST(l_partkey AS STRING)
                    WHEN 5 THEN 'Paypal *' || p_name || ' AGREGADOR'
                    WHEN 6 THEN '12'
                    ELSE 'COMISION ' || p_type END AS description,
               CASE l_linenumber WHEN 3 THEN 'RFC ABC' || CAST(100000 + l_suppkey AS STRING) || 'XY1'
                    ELSE 'IVA: ' || {_SIZE} END AS context_line,
               CASE WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN upper(p_name) || ' OWNER' END AS beneficiary_name,
               CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS retiro,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS deposit
        FROM <lineitem> JOIN <part> ON l_partkey = p_partkey""",
    # Extracted names of order lines, to be resolved against registries.
    "named": f"""
        SELECT {_LINE_ID} AS tx_id, CAST(l_shipdate AS DATE) AS date,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               CASE l_linenumber WHEN 1 THEN upper(s_name) WHEN 2 THEN 'Paid to ' || s_name || ' today'
                    WHEN 3 THEN 's  ' || CAST(l_suppkey AS STRING) WHEN 4 THEN p_name
                    WHEN 5 THEN NULL ELSE lower(s_name) END AS clean_merchant,
               CASE l_returnflag WHEN 'A' THEN 'BofA' WHEN 'N' THEN 'scotia' ELSE 'My Unknown Bank' END AS bank,
               CASE l_linestatus WHEN 'O' THEN 'expense' ELSE 'income' END AS direction,
               CAST(l_quantity AS DOUBLE) / 50 AS confidence
        FROM <lineitem> JOIN <supplier> ON l_suppkey = s_suppkey JOIN <part> ON l_partkey = p_partkey""",
    # Events as the event log of user accounts.
    "event_log": """
        SELECT event_id AS seq, ts, CAST(user_id AS STRING) AS aggregate_id,
               CASE event_type WHEN 'signup' THEN 'transaction-imported' WHEN 'purchase' THEN 'transaction-classified'
                    WHEN 'view' THEN 'transaction-verified' WHEN 'click' THEN 'transaction-corrected'
                    ELSE 'discrepancy-detected' END AS event_type,
               value, props
        FROM <events>""",
    # Part attributes over time: prices as facts that lines assert, and retractions.
    "facts": f"""
        SELECT CAST(user_id AS STRING) AS entity_id, ts, event_id AS seq,
               CASE WHEN event_type = 'error' AND value > 90 THEN 'retract' ELSE 'assert' END AS op,
               CASE event_type WHEN 'signup' THEN 'name' WHEN 'purchase' THEN 'price' WHEN 'view' THEN 'name'
                    WHEN 'click' THEN 'price' ELSE 'note' END AS attribute,
               event_type || '-' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS value
        FROM <events>""",
    # Customers linked in chains and loops of neighbouring keys.
    "same_as": """
        SELECT CAST(c_custkey AS STRING) AS src,
               CAST(CASE WHEN c_custkey % 100 = 50 THEN c_custkey + 3 ELSE c_custkey - 1 END AS STRING) AS dst
        FROM <customer> WHERE c_custkey % 10 <> 0 OR c_custkey % 100 = 50""",
    # Parts as rules in two versions: some dropped, some changed, some new.
    "rule_versions": """
        SELECT 'merchant-rules' AS rule_type, TIMESTAMP '2024-01-01 00:00:00' AS ts, 'ana' AS author,
               'initial' AS reason, p_partkey AS id, p_name AS pattern, p_type AS category, p_size AS priority
        FROM <part>
        UNION ALL
        SELECT 'merchant-rules', TIMESTAMP '2024-02-01 00:00:00', 'ben', 'review',
               CASE WHEN p_size > 45 THEN p_partkey + 1000000 ELSE p_partkey END, p_name, p_type,
               CASE WHEN p_brand = 'Brand#7' THEN p_size + 1 ELSE p_size END
        FROM <part> WHERE p_size > 3""",
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views whose rows are parsed and matched as text, which costs far more than to move them; aggregates over the others do not gain from a shuffle before them.
TEXTS = ("raw_rows", "statement_rows", "named")
#: Tables whose rows such views work on one by one, and the size in bytes per core below which they are dealt to all cores.
FACTS, DEAL_BELOW = ("lineitem", "orders", "events"), 16 << 20


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The table in SQL. A small file is read by one task; its rows are then dealt to all cores, as the views' expressions cost
    more than moving them. Large tables have tasks enough and stay where they are."""
    source = f"parquet.`{sf_dir}/{name}.parquet`"
    cores = spark.sparkContext.defaultParallelism
    if name not in FACTS or cores < 2:
        return source
    size = int(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return f"(SELECT /*+ REPARTITION({cores}) */ * FROM {source})" if size < cores * DEAL_BELOW else source


def spark_sql(spark: SparkSession, text: str, sf_dir: str, deal: bool = False) -> str:
    text = re.sub(r"SHA\[(.*?)\](?=,)", r"sha2(\1, 256)", text, flags=re.S)
    return re.sub(r"<(\w+)>", lambda m: _dealt(spark, sf_dir, m.group(1)) if deal else f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text)


def check_sql(text: str) -> str:
    text = re.sub(r"SHA\[(.*?)\](?=,)", r"sha256(\1)", text, flags=re.S)
    return re.sub(r"<(\w+)>", r"\1", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(spark, VIEWS[name], sf_dir, name in TEXTS))


def with_views(names: list[str], body: str, *ctes: str) -> str:
    """SQL for the checking engine: the named views, further CTEs, then the query."""
    parts = [f"{n} AS ({check_sql(VIEWS[n])})" for n in names] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body
