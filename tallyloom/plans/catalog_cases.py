"""Queries for cases that the other catalogs do not reach: orders of any type, real files, short names, ties, late fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import normalise as N
from tallyloom.functions import predicates as P
from tallyloom.functions.skew import Running, running
from tallyloom.operators import classify as C
from tallyloom.operators import entities, events, graph
from tallyloom.operators import registry as R
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, view, with_views
from tallyloom.runtime import shared_path
from tallyloom.sources import lines as L
from tallyloom.sources import statements as S
from tallyloom.sources import tables as T

Q: dict = {}


def add(name, fn, views, body, *ctes):
    sql = with_views(views, body, *ctes) if views or ctes else body
    Q[name] = (lambda s, d: portable(fn(s, d)), sql)


# ---- running aggregates, on the plain and the split path -------------------------------------


def _both(df, keys, order, out):
    specs = [Running("n", "count", F.lit(1)), Running("total", "sum", F.col("amount")), Running("last_id", "last", F.when(F.col("tx_id") % 3 == 0, F.col("tx_id")))]
    paths = {"plain": {"floor": 10**12}, "split": {"share": 0.00001, "floor": 5}}
    parts = [running(df, keys, order, specs, **kw).select(F.lit(name).alias("path"), *out, "n", "total", "last_id") for name, kw in paths.items()]
    return parts[0].unionByName(parts[1])


def _amounts(s, d):
    part = F.col("tx_id") % 50
    rows = view(s, d, "orders_ledger").select("tx_id", "date", "amount", F.when(part > 1, F.col("amount")).alias("a"), F.when(part > 3, F.col("account_id") % 7).alias("k"))
    # Half of the days lie before 1970.
    return rows.withColumn("day", F.when(F.col("tx_id") % 40 > 0, F.date_sub("date", 9000)))


_AMOUNTS = """am AS (SELECT tx_id, amount, CASE WHEN tx_id % 50 > 1 THEN amount END AS a, CASE WHEN tx_id % 50 > 3 THEN account_id % 7 END AS k,
  CASE WHEN tx_id % 40 > 0 THEN date - INTERVAL 9000 DAY END AS day, 'tx-' || sha256(CAST(tx_id AS STRING)) AS name FROM orders_ledger)"""


def _running_sql(window):
    return f"""SELECT path, tx_id, n, CAST(total AS DOUBLE) AS total, last_id FROM (SELECT tx_id, COUNT(*) OVER w AS n, SUM(amount) OVER w AS total,
  last_value(CASE WHEN tx_id % 3 = 0 THEN tx_id END IGNORE NULLS) OVER w AS last_id FROM am WINDOW w AS ({window} ROWS UNBOUNDED PRECEDING)), (SELECT unnest(['plain', 'split']) AS path)"""


add("running_by_amount", lambda s, d: _both(_amounts(s, d), [], ["a", "tx_id"], ["tx_id"]), ["orders_ledger"], _running_sql("ORDER BY a NULLS FIRST, tx_id"), _AMOUNTS)
add("running_by_day", lambda s, d: _both(_amounts(s, d), ["k"], ["day", "tx_id"], ["tx_id"]), ["orders_ledger"], _running_sql("PARTITION BY k ORDER BY day NULLS FIRST, tx_id"), _AMOUNTS)
add("running_by_text", lambda s, d: _both(_amounts(s, d).withColumn("name", F.concat(F.lit("tx-"), F.sha2(F.col("tx_id").cast("string"), 256))), ["k"], ["name"], ["tx_id"]),
    ["orders_ledger"], _running_sql("PARTITION BY k ORDER BY name"), _AMOUNTS)

# ---- registries ------------------------------------------------------------------------------


def _short(s, d):
    n = table(s, d, "nation")
    registry = n.select(F.col("n_nationkey").cast("string").alias("entity_id"), F.concat(F.lit("NATION OF "), "n_name").alias("canonical_name"),
                        F.array(F.substring("n_name", 1, 2), F.when(F.col("n_regionkey") == 1, F.substring("n_name", 4, 1))).alias("variations"))
    texts = table(s, d, "customer").select("c_custkey", F.concat(F.lit("7 "), "c_mktsegment", F.lit(" 12")).alias("clean"))
    return R.lookup(texts, registry, F.col("clean"), "m", ["c_custkey"]).select("c_custkey", "m_entity", "m_match")


add("lookup_short_names", _short, [], """
WITH v AS (SELECT CAST(n_nationkey AS STRING) AS id, substr(n_name, 1, 2) AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS STRING), substr(n_name, 4, 1) FROM nation WHERE n_regionkey = 1),
t AS (SELECT DISTINCT '7 ' || c_mktsegment || ' 12' AS text FROM customer),
b AS (SELECT * FROM (SELECT text, id, row_number() OVER (PARTITION BY text ORDER BY length(name) DESC, id) AS rn FROM t JOIN v ON contains(text, name) AND name <> '') WHERE rn = 1)
SELECT c_custkey, id AS m_entity, CASE WHEN id IS NULL THEN 'no-match' ELSE 'substring-match' END AS m_match
FROM customer LEFT JOIN b ON text = '7 ' || c_mktsegment || ' 12'""")

# ---- statement lines and files ---------------------------------------------------------------


def _long_records(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    notes = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("nota larga "), i.cast("string")))
    text = F.concat(F.array(F.lit("17 JUN TIENDA $10.00 $20.00")), notes, F.array(F.concat(F.lit("RFC/CURP: ABC"), F.col("o_custkey").cast("string"))), F.array(F.lit("FOLIO: 9")))
    return orders.select(F.concat(F.lit("f"), F.col("o_orderkey") % 7).alias("file"), (F.col("o_orderkey") * 20).alias("_first"), F.posexplode(text).alias("i", "text")).select(
        "file", (F.col("_first") + F.col("i")).alias("line_no"), "text")


add("late_record_fields", lambda s, d: L.segment_statement_lines(_long_records(s, d)).select("file", "record_line", "rfc", "reference", F.size("context_lines").alias("stored")), [], """
SELECT 'f' || CAST(o_orderkey % 7 AS STRING) AS file, o_orderkey * 20 AS record_line, 'ABC' || CAST(o_custkey AS STRING) AS rfc, 'FOLIO: 9' AS reference, CAST(10 AS BIGINT) AS stored FROM orders""")


def _export(s, d):
    """Orders as exports of three banks in two folders each, with quoted commas and bad rows, and as Stripe feeds of which one is broken."""
    root = shared_path(s, "exports")
    o = table(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    bad = F.col("o_orderkey") % 10
    amount = F.when(bad == 3, "x1").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    us = F.when(bad == 4, "2024-99-99").otherwise(F.date_format("day", "MM/dd/yyyy"))
    name = F.concat(F.lit("SHOP, "), F.col("o_orderkey").cast("string"), F.lit(" é"))
    layouts = {
        "bofa": [us.alias("date"), name.alias("description"), amount.alias("amount")],
        "apple-card": [us.alias("date"), name.alias("description"), amount.alias("amount"), F.lit("Food").alias("category"), F.lit("Shop, one").alias("merchant")],
        "wise": [F.when(bad == 4, "nie").otherwise(F.col("day").cast("string")).alias("date"), F.lit("P").alias("payee_name"), amount.alias("amount"), F.lit("USD").alias("currency"),
                 F.lit("1.0").alias("exchange_rate"), amount.alias("amount_usd"), name.alias("description"), F.lit("money in").alias("type"), F.lit("done").alias("status")],
    }
    for i, (bank, columns) in enumerate(layouts.items()):
        own = o.where(F.col("o_orderkey") % 4 == i)
        for half in (0, 1):
            own.where(F.col("o_custkey") % 2 == half).select(*columns).write.option("header", True).csv(f"{root}/{bank}/{half}")
    feed = o.where("o_orderkey % 4 = 3").groupBy((F.col("o_custkey") % 5).alias("file")).agg(F.collect_list(F.struct(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"), F.lit("usd").alias("currency"),
        name.alias("description"), F.unix_timestamp(F.col("day").cast("timestamp")).alias("created"), F.lit("charge").alias("type"))).alias("data"))
    feed.select("data").write.option("maxRecordsPerFile", 1).json(f"{root}/stripe")
    o.limit(1).select(F.lit('{"data": [{"id": ').alias("value")).write.mode("append").text(f"{root}/stripe")
    return root


def _read_exports(s, d):
    root = _export(s, d)
    out = []
    for bank in ("bofa", "apple-card", "wise"):
        good, reject = S.read_delimited(s, [f"{root}/{bank}/{half}" for half in (0, 1)], bank)
        out.append(good.select(F.lit(bank).alias("bank"), F.lit("row").alias("kind"), "description", "date", "amount"))
        out.append(reject.select(F.lit(bank).alias("bank"), F.col("reason").alias("kind"), F.regexp_extract("raw_line", '"(SHOP, [^"]*)"', 1).alias("description"),
                                 F.lit(None).cast("date").alias("date"), F.lit(None).cast("decimal(18,2)").alias("amount")))
    rows, broken = S.read_stripe(s, f"{root}/stripe")
    out.append(rows.select(F.lit("stripe").alias("bank"), F.lit("row").alias("kind"), "description", "date", "amount"))
    out.append(broken.select(F.lit("stripe").alias("bank"), F.col("reason").alias("kind"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("decimal(18,2)").alias("amount")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


add("read_exports", _read_exports, [], """
SELECT bank, kind, 'SHOP, ' || CAST(o_orderkey AS STRING) || ' é' AS description, CASE WHEN kind = 'row' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN kind = 'row' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount
FROM (SELECT *, ['bofa', 'apple-card', 'wise', 'stripe'][(o_orderkey % 4 + 1)::INT] AS bank,
  CASE WHEN o_orderkey % 4 = 3 THEN 'row' WHEN o_orderkey % 10 = 3 THEN 'bad-amount' WHEN o_orderkey % 10 = 4 THEN 'bad-date' ELSE 'row' END AS kind FROM orders)
UNION ALL SELECT 'stripe', 'bad-json', NULL, NULL, NULL""")

# ---- classification and events ---------------------------------------------------------------

_SOME = [C.Rule("only-type", "1-URGENT", type="expense", priority=9), C.Rule("only-merchant", "2-HIGH", merchant="high", priority=8), C.Rule("all", "3-MEDIUM", merchant="m", category="c", confidence=0.5, priority=7)]
add("classify_keeps_values", lambda s, d: C.classify(view(s, d, "ledger").select("tx_id", "description", "merchant", F.col("category").alias("category_id"), "confidence", "type"), _SOME).select(
    "tx_id", "merchant_id", "category_id", "confidence", "type", "rule_id"), ["ledger"], """
SELECT tx_id, CASE merchant WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'm' END AS merchant_id, CASE WHEN merchant IN ('1-URGENT', '2-HIGH') THEN category WHEN merchant = '3-MEDIUM' THEN 'c' ELSE 'uncategorized' END AS category_id,
  ROUND(CASE WHEN merchant IN ('1-URGENT', '2-HIGH') THEN confidence WHEN merchant = '3-MEDIUM' THEN 0.5 ELSE 0.0 END, 6)::DOUBLE AS confidence, CASE WHEN merchant = '1-URGENT' THEN 'expense' ELSE type END AS type,
  CASE merchant WHEN '1-URGENT' THEN 'only-type' WHEN '2-HIGH' THEN 'only-merchant' WHEN '3-MEDIUM' THEN 'all' END AS rule_id FROM ledger""")


def _same_time(s, d):
    rows = view(s, d, "orders_ledger").withColumns({"merchant_id": F.lit(None).cast("string"), "category_id": F.lit("raw"), "description": F.lit("d")})
    at = F.col("date").cast("timestamp")
    done = rows.withColumns({"category_id": F.lit("done"), "merchant_id": F.lit("m")})
    log = events.verified(rows.where("verified"), at).unionByName(events.classified(done, at)).unionByName(events.imported(rows, at))
    return events.project_state(log).select("tx_id", "category_id", "merchant_id", "verified", "events")


add("events_of_one_time", _same_time, ["orders_ledger"], """
SELECT CAST(tx_id AS STRING) AS tx_id, 'done' AS category_id, 'm' AS merchant_id, CASE WHEN verified THEN TRUE END AS verified, CAST(CASE WHEN verified THEN 3 ELSE 2 END AS BIGINT) AS events FROM orders_ledger""")

# ---- chains and merged aliases ---------------------------------------------------------------


def _links(s, d):
    """Each customer points at the part of its orders, each part at the next of its ten."""
    orders = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("o_orderkey") % 100).alias("dst"), F.col("o_orderdate").cast("date").alias("ts"))
    parts = s.range(100).where("id % 10 < 9").select(F.concat(F.lit("p"), "id").alias("src"), F.concat(F.lit("p"), F.col("id") + 1).alias("dst"), F.lit(None).cast("date").alias("ts"))
    return orders.unionByName(parts)


_LATEST = """e AS (SELECT src, dst FROM (SELECT 'c' || CAST(o_custkey AS STRING) AS src, o_orderkey % 100 AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, 'p' || CAST(o_orderkey % 100 AS STRING)) AS rn FROM orders) WHERE rn = 1)"""
add("canonicalise_latest", lambda s, d: graph.canonicalise(_links(s, d)).where("id LIKE 'c%'").select("id", "canonical_id", "hops"), [],
    "SELECT src AS id, 'p' || CAST(dst - dst % 10 + 9 AS STRING) AS canonical_id, CAST(10 - dst % 10 AS BIGINT) AS hops FROM e", _LATEST)
add("chain_paths", lambda s, d: graph.chain_paths(_links(s, d), table(s, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))).withColumnRenamed("at", "place"), [], """
SELECT id, hop, place FROM (SELECT 'c' || CAST(c_custkey AS STRING) AS id, CAST(0 AS BIGINT) AS hop, 'c' || CAST(c_custkey AS STRING) AS place FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT src, CAST(k + 1 AS BIGINT), 'p' || CAST(dst + k AS STRING) FROM e, (SELECT unnest(range(10)) AS k) WHERE dst % 10 + k < 10 AND CAST(substr(src, 2) AS BIGINT) % 3 = 0)""", _LATEST)

# The same chains for every customer.
add("chain_paths_all", lambda s, d: graph.chain_paths(_links(s, d), table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))).withColumnRenamed("at", "place"), [], """
SELECT id, hop, place FROM (SELECT 'c' || CAST(c_custkey AS STRING) AS id, CAST(0 AS BIGINT) AS hop, 'c' || CAST(c_custkey AS STRING) AS place FROM customer
  UNION ALL SELECT src, CAST(k + 1 AS BIGINT), 'p' || CAST(dst + k AS STRING) FROM e, (SELECT unnest(range(10)) AS k) WHERE dst % 10 + k < 10)""", _LATEST)


def _aliases(s, d):
    made = table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("merchant_id"), F.col("c_mktsegment").alias("alias"), F.lit(1).cast("bigint").alias("rows"), F.lit("2024-01-01").cast("date").alias("first_seen"))
    merges = table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("source_id"), F.lit("asia").alias("target_id"))
    return entities.merge_aliases(made, merges)


add("merge_aliases", _aliases, [], """
SELECT merchant_id, alias, CAST(SUM(n) AS BIGINT) AS rows, max(day) AS first_seen FROM (
  SELECT CASE WHEN n_regionkey = 2 THEN 'asia' ELSE CAST(c_nationkey AS STRING) END AS merchant_id, c_mktsegment AS alias, 1 AS n, '2024-01-01' AS day FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'asia', CAST(n_nationkey AS STRING), 0, NULL FROM nation WHERE n_regionkey = 2) GROUP BY 1, 2""")

# ---- look-ups, enrichment and versions of entities -------------------------------------------


def _found(s, d):
    c = table(s, d, "customer")
    key = F.col("c_custkey")
    rows = c.select(key.alias("tx_id"), F.when(key % 3 == 0, F.concat(F.lit("m"), key)).alias("merchant_id"), F.col("c_mktsegment").alias("merchant_name"), F.when(key % 10 == 1, F.concat(F.lit("r"), F.col("c_nationkey"))).alias("rfc"))
    known = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("m"), key).alias("merchant_id"))
    aliases = c.where("c_mktsegment < 'F'").select(F.col("c_mktsegment").alias("alias"), F.concat(F.lit("seg "), F.col("c_mktsegment")).alias("merchant_id"))
    taxes = c.where("c_nationkey < 12").select(F.concat(F.lit("r"), F.col("c_nationkey")).alias("rfc"), F.concat(F.lit("tax "), F.col("c_nationkey")).alias("merchant_id"))
    return entities.find_entity(rows, known, aliases, taxes, share=0.001, floor=20).select("tx_id", "entity_id", "match_method")


add("find_entity", _found, [], """
SELECT c_custkey AS tx_id, CASE WHEN c_custkey % 6 = 0 THEN 'm' || CAST(c_custkey AS STRING) WHEN c_mktsegment < 'F' THEN 'seg ' || c_mktsegment WHEN c_custkey % 10 = 1 AND c_nationkey < 12 THEN 'tax ' || CAST(c_nationkey AS STRING) END AS entity_id,
  CASE WHEN c_custkey % 6 = 0 THEN 'merchant-id' WHEN c_mktsegment < 'F' THEN 'alias' WHEN c_custkey % 10 = 1 AND c_nationkey < 12 THEN 'tax-id' END AS match_method FROM customer""")


def _parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("category"), F.lit(1).alias("version"),
                                      F.array("p_brand", F.upper("p_type")).alias("variations"))


def _changes(s, d):
    return table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("entity_id"), F.when(F.col("p_size") > 40, F.upper("p_name")).alias("canonical_name"), F.lit("new").alias("category"))


add("entity_new_versions", lambda s, d: entities.bump_version(_parts(s, d), _changes(s, d), ["canonical_name", "category"]).select("entity_id", "canonical_name", "category", "version"), [], """
SELECT CAST(p_partkey AS STRING) AS entity_id, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS canonical_name, 'new' AS category, CAST(2 AS BIGINT) AS version FROM part WHERE p_size > 25""")
add("registry_enriched", lambda s, d: R.enrich_registry(_parts(s, d).select("entity_id", "category"), _changes(s, d), ["category", "canonical_name"]), [], """
SELECT CAST(p_partkey AS STRING) AS entity_id, CASE WHEN p_size > 25 THEN 'new' ELSE p_type END AS category, CASE WHEN p_size > 40 THEN upper(p_name) END AS canonical_name FROM part""")
add("registry_by_alias", lambda s, d: R.find_by_alias(_parts(s, d), "Brand#7").select("entity_id"), [], "SELECT CAST(p_partkey AS STRING) AS entity_id FROM part WHERE p_brand = 'Brand#7' OR upper(p_type) = 'Brand#7'")


def _variations(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("entity_id"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("variation"), F.col("p_name").alias("source"), (F.col("p_partkey") / 100000).alias("confidence"))


add("best_variation", lambda s, d: entities.best_variation(_variations(s, d), F.lit("promo")).select("entity_id", "source", "confidence"), [], """
SELECT p_brand AS entity_id, arg_max(p_name, p_partkey) AS source, ROUND(max(p_partkey) / 100000.0, 6)::DOUBLE AS confidence FROM part WHERE p_type = 'PROMO' GROUP BY 1""")

# ---- equivalences that arrive later, and rows with the history of their run ------------------


def _more_links(s, d):
    first = _links(s, d)
    later = first.where("src LIKE 'c%'").groupBy("src").agg(F.max("ts").alias("ts")).select("src", F.lit("p99").alias("dst"), F.date_add("ts", 1).alias("ts"))
    return graph.canonicalise(graph.add_equivalences(first, later.unionByName(later))).where("id LIKE 'c%'").select("id", "canonical_id", "hops")


add("equivalences_added", _more_links, [], "SELECT src AS id, 'p99' AS canonical_id, CAST(1 AS BIGINT) AS hops FROM e", _LATEST)
add("related_entities", lambda s, d: graph.related_entities(_parts(s, d), "category", "PROMO").select("entity_id"), [], "SELECT CAST(p_partkey AS STRING) AS entity_id FROM part WHERE p_type = 'PROMO'")


def _stamped(s, d):
    rows = view(s, d, "orders_ledger").select("tx_id")
    return T.stamp_history(rows, F.concat(F.lit("f"), F.col("tx_id") % 3), F.lit("2024-01-02 03:04:05").cast("timestamp"), "1.2")


add("stamped_history", _stamped, ["orders_ledger"], "SELECT tx_id, 'f' || CAST(tx_id % 3 AS STRING) AS source_file, '2024-01-02 03:04:05.000000' AS processed_at, '1.2' AS pipeline_version FROM orders_ledger")

# ---- text and value tests --------------------------------------------------------------------


def _texts(s, d):
    p = table(s, d, "part")
    slug = N.kebab(F.concat("p_name", F.lit(" "), "p_type"))
    price = F.concat(F.lit("$"), F.format_number(F.col("p_retailprice") * 10, 2))
    return p.select("p_partkey", N.title_from_kebab(slug).alias("title"), N.file_prefix(F.concat("p_type", F.lit("_march_1.csv"))).alias("prefix"), N.parse_number(price).alias("price"),
                    P.not_empty(F.when(F.col("p_size") > 20, F.lit("  ")).otherwise(F.lit(" x"))).alias("filled"), P.non_negative(F.col("p_size") - 25).alias("zero_or_more"), P.in_range(F.col("p_size"), 10, 20).alias("between"))


add("text_and_value_tests", _texts, [], """
SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title, lower(p_type) AS prefix,
  ROUND(CAST(ROUND(p_retailprice * 10, 2) AS DOUBLE), 6) AS price, p_size <= 20 AS filled, p_size >= 25 AS zero_or_more, p_size BETWEEN 10 AND 20 AS between FROM part""")

# ---- import with references ------------------------------------------------------------------


def _imported(s, d):
    rows = view(s, d, "ledger").select("tx_id", "amount", "bank", F.lower("category").alias("category_id"), N.kebab("merchant").alias("merchant_id"), "confidence",
                                       F.when(F.col("tx_id") % 3 > 0, F.col("currency")).alias("currency"))
    stored = rows.where("tx_id % 5 = 0")
    known = table(s, d, "nation").where("n_nationkey < 9").select(F.concat(F.lit("bank-"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("canonical_name"))
    more = rows.select(F.col("category_id").alias("entity_id"), F.col("category_id").alias("canonical_name")).where("entity_id < 'f'").distinct()
    kept, classified, after = T.import_with_references(rows, stored, known.unionByName(more), F.lit("2024-01-01").cast("timestamp"))
    none = F.lit(None).cast("string")
    return (kept.select(F.lit("row").alias("kind"), F.col("tx_id").cast("string").alias("id"), "bank", "category_id", "currency", none.alias("name"))
            .unionByName(classified.select(F.lit("classified").alias("kind"), F.col("tx_id").cast("string").alias("id"), none.alias("bank"), "category_id", none.alias("currency"), F.concat_ws(" ", "method", "version", "merchant_id").alias("name")))
            .unionByName(after.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), none.alias("bank"), none.alias("category_id"), none.alias("currency"), F.col("canonical_name").alias("name"))))


_KEBAB = "trim(regexp_replace(lower(merchant), '[^a-z0-9]+', ' ', 'g'))"
add("import_with_references", _imported, ["ledger"], f"""
SELECT 'row' AS kind, CAST(tx_id AS STRING) AS id, CASE WHEN CAST(substr(bank, 6) AS INT) < 9 THEN bank END AS bank, CASE WHEN lower(category) < 'f' THEN lower(category) END AS category_id,
  CASE WHEN tx_id % 3 > 0 THEN currency ELSE 'USD' END AS currency, NULL AS name FROM ledger WHERE tx_id % 5 <> 0
UNION ALL SELECT 'classified', CAST(tx_id AS STRING), NULL, lower(category), NULL, 'csv-import import-v1.0 ' || replace({_KEBAB}, ' ', '-') FROM ledger WHERE tx_id % 5 <> 0
UNION ALL SELECT 'entity', 'bank-' || CAST(n_nationkey AS STRING), NULL, NULL, NULL, n_name FROM nation WHERE n_nationkey < 9
UNION ALL SELECT DISTINCT 'entity', lower(category), NULL, NULL, NULL, lower(category) FROM ledger WHERE lower(category) < 'f'
UNION ALL SELECT DISTINCT 'entity', replace({_KEBAB}, ' ', '-'), NULL, NULL, NULL, array_to_string(list_transform(string_split({_KEBAB}, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') FROM ledger WHERE tx_id % 5 <> 0""")


def _store_seen(s, d):
    """Which rows of a batch the store has, where it has every third one."""
    rows = view(s, d, "orders_ledger").select(F.lit("transaction").alias("entity_type"), F.create_map(F.lit("id"), F.col("tx_id").cast("string"), F.lit("a"), F.col("amount").cast("string")).alias("data"), F.col("tx_id").alias("seq"))
    hashed = T.with_store_hash(rows)
    return T.flag_known(hashed, hashed.where("seq % 3 = 0").select("hash")).drop("hash", "data", "entity_type")


add("store_known_rows", _store_seen, ["orders_ledger"], "SELECT tx_id AS seq, tx_id % 3 = 0 AS duplicate FROM orders_ledger")

# ---- builders of the other event types -------------------------------------------------------


def _built(s, d):
    rows = view(s, d, "orders_ledger").select("tx_id", "account_id", F.col("date").cast("timestamp").alias("at"))
    odd = F.col("tx_id") % 2 == 1
    made = rows.withColumns({"calculated": F.col("tx_id"), "expected": F.col("tx_id") + 1, "difference": F.lit(-1), "reconciled": odd, "issue": F.when(odd, F.lit("gap")), "amount": F.col("tx_id"),
                             "original_id": F.col("tx_id") - 1, "duplicate_id": F.col("tx_id"), "similarity": F.lit(1)})
    at = F.col("at")
    out = events.reconciled(made, at).unionByName(events.discrepancy(made, at)).unionByName(events.duplicate_detected(made, at)).unionByName(events.system_event(made, "import-started", "tx_id", at, ["account_id"]))
    return out.select("event_type", "aggregate_type", "aggregate_id", "seq", "ts", "data")


_AT = "strftime(date, '%Y-%m-%d 00:00:00.000000') AS ts"
add("event_builders", _built, ["orders_ledger"], f"""
SELECT 'balance-reconciled' AS event_type, 'balance' AS aggregate_type, CAST(account_id AS STRING) AS aggregate_id, CAST(6 AS BIGINT) AS seq, {_AT},
  '{{"calculated":' || tx_id || ',"expected":' || (tx_id + 1) || ',"difference":-1,"reconciled":' || CASE WHEN tx_id % 2 = 1 THEN 'true' ELSE 'false' END || '}}' AS data FROM orders_ledger
UNION ALL SELECT 'discrepancy-detected', 'transaction', CAST(tx_id AS STRING), 7, {_AT}, CASE WHEN tx_id % 2 = 1 THEN '{{"issue":"gap","amount":' ELSE '{{"amount":' END || tx_id || '}}' FROM orders_ledger
UNION ALL SELECT 'duplicate-detected', 'transaction', CAST(tx_id AS STRING), 4, {_AT}, '{{"original_id":' || (tx_id - 1) || ',"duplicate_id":' || tx_id || ',"similarity":1}}' FROM orders_ledger
UNION ALL SELECT 'import-started', 'system', CAST(tx_id AS STRING), 8, {_AT}, '{{"account_id":' || account_id || '}}' FROM orders_ledger""")
