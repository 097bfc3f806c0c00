"""Queries of state and streams: snapshots, key stores, streamed decisions, progress; and of nested shapes and large rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import classify as C
from tallyloom.operators import events as E
from tallyloom.operators import graph, quality, rule_index, shapes
from tallyloom.operators.snapshots import StateStore, state_summary, whole_state
from tallyloom.plans.catalog_cases import _LATEST, _links
from tallyloom.plans.catalog_events import _FIELDS, _OUT, _STATE, log
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, view, with_views
from tallyloom.runtime import shared_path
from tallyloom.streaming import decisions, imports, progress

Q: dict = {}


def add(name, fn, views, body, *ctes):
    sql = with_views(views, body, *ctes) if views or ctes else body
    Q[name] = (lambda s, d: portable(fn(s, d)), sql)


# ---- snapshots -------------------------------------------------------------------------------


def _stored(s, d):
    """The log in two parts, the second of which is late for the last snapshot."""
    rows = log(s, d).withColumns({"aggregate_type": F.lit("transaction"), "event_id": F.col("seq").cast("string"), "author": F.lit("a"), "source": F.lit("s")})
    store = StateStore(shared_path(s, "state"), _FIELDS)
    late = (F.col("seq") % 50 == 0) & (F.col("ts") > F.lit("2024-01-08").cast("timestamp"))
    store.append(rows.where(~late))
    for t in ("2024-01-04 00:00:00", "2024-01-08 00:00:00", "2024-01-11 00:00:00"):
        store.snapshot(s, t)
    store.append(rows.where(late))
    store.snapshot(s, "2024-01-11 06:00:00")
    return store


_COLS = ["tx_id", "amount", "note", "flag", "has_import"]
add("state_from_snapshot", lambda s, d: _stored(s, d).state_at(s, "2024-01-12 00:00:00").select(*_COLS), ["event_log"], _OUT, _STATE.format(w="ts <= TIMESTAMP '2024-01-12 00:00:00'"))
add("state_between_snapshots", lambda s, d: _stored(s, d).state_at(s, "2024-01-09 17:00:00").select(*_COLS), ["event_log"], _OUT, _STATE.format(w="ts <= TIMESTAMP '2024-01-09 17:00:00'"))

def _eight(s, d):
    """A log of all eight event types: those of the event log, with its errors as what is known of duplicates and balances."""
    rows = view(s, d, "event_log")
    money, odd = F.col("value").cast("decimal(18,2)"), F.col("seq") % 4
    kind = F.when(F.col("event_type") != E.DISCREPANCY, F.col("event_type")).when(odd == 0, E.DUPLICATE_DETECTED).when(odd == 1, E.DUPLICATE_RESOLVED).when(odd == 2, E.RECONCILED).otherwise(E.DISCREPANCY)
    body = (
        F.when(kind == E.DUPLICATE_DETECTED, F.to_json(F.struct(F.lit("first").alias("original_id"), F.col("aggregate_id").alias("duplicate_id"), (money / 100).cast("double").alias("similarity"))))
        .when(kind == E.DUPLICATE_RESOLVED, F.to_json(F.struct(F.col("aggregate_id").alias("duplicate_id"), (F.col("value") > 20).alias("is_duplicate"))))
        .when(kind == E.RECONCILED, F.to_json(F.struct(money.alias("calculated"), F.lit(10).alias("expected"), (money - 10).alias("difference"), (money == 10).alias("reconciled"))))
        .otherwise(F.to_json(F.struct(F.lit("large-amount").alias("issue"), money.alias("amount"))))
    )
    return rows.select("seq", "ts", "aggregate_id", kind.alias("event_type"), body.alias("data"))


_EIGHT = """e8 AS (SELECT seq, ts, aggregate_id, value, CAST(value AS DECIMAL(18,2)) AS money, CASE WHEN event_type <> 'discrepancy-detected' THEN 'transactions'
  WHEN seq % 4 = 0 THEN 'duplicates' WHEN seq % 4 = 1 THEN 'verdicts' WHEN seq % 4 = 2 THEN 'reconciliations' ELSE 'discrepancies' END AS part FROM event_log)"""
add("state_summary", lambda s, d: state_summary(_eight(s, d)), ["event_log"], """
SELECT part, CASE WHEN part IN ('transactions', 'verdicts') THEN COUNT(DISTINCT aggregate_id) ELSE COUNT(*) END AS entries, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS changed_at FROM e8 GROUP BY 1""", _EIGHT)


def _parts(s, d):
    parts = whole_state(_eight(s, d))
    out = parts["transactions"].select(F.lit("transactions").alias("part"), F.col("tx_id").alias("id"), F.col("amount").cast("double").alias("value"), F.col("events"))
    one = F.lit(1).cast("bigint")
    out = out.unionByName(parts["duplicates"].select(F.lit("duplicates").alias("part"), F.col("duplicate_id").alias("id"), F.col("similarity").alias("value"), one.alias("events")))
    out = out.unionByName(parts["verdicts"].select(F.lit("verdicts").alias("part"), F.col("duplicate_id").alias("id"), F.col("is_duplicate").cast("double").alias("value"), F.col("verdicts").alias("events")))
    out = out.unionByName(parts["reconciliations"].select(F.lit("reconciliations").alias("part"), F.col("aggregate_id").alias("id"), F.col("difference").cast("double").alias("value"), one.alias("events")))
    return out.unionByName(parts["discrepancies"].select(F.lit("discrepancies").alias("part"), F.col("aggregate_id").alias("id"), F.col("amount").cast("double").alias("value"), one.alias("events")))


# Every event of a transaction carries an amount here, so its state has the last one.
add("whole_state", _parts, ["event_log"], """
SELECT part, aggregate_id AS id, CAST(arg_max(money, (ts, seq)) AS DOUBLE) AS value, COUNT(*) AS events FROM e8 WHERE part = 'transactions' GROUP BY 1, 2
UNION ALL SELECT part, aggregate_id, CAST(arg_max(value > 20, (ts, seq)) AS DOUBLE), COUNT(*) FROM e8 WHERE part = 'verdicts' GROUP BY 1, 2
UNION ALL SELECT part, aggregate_id, CASE part WHEN 'duplicates' THEN ROUND(CAST(money AS DOUBLE) / 100, 6) WHEN 'reconciliations' THEN CAST(money - 10 AS DOUBLE) ELSE CAST(money AS DOUBLE) END, 1 FROM e8
  WHERE part IN ('duplicates', 'reconciliations', 'discrepancies')""", _EIGHT)

# ---- streams ---------------------------------------------------------------------------------


#: Rows of one file of a stream.
FILE_ROWS = 500_000


def _files(df, name, key, parts=4, spread=None):
    """Rows as files, to be read in so many micro-batches; and the files of each, which are as many as keep a file to ``FILE_ROWS``. ``spread``: a column that tells rows of a key apart."""
    path = shared_path(df.sparkSession, name)
    lanes = max(1, -(-df.count() // (parts * FILE_ROWS)))
    df.repartition(parts * lanes, key, *([F.pmod(F.xxhash64(spread), F.lit(lanes))] if spread else [])).write.parquet(path)
    return path, lanes


def _keyed(s, d):
    rows = table(s, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder, lanes = _files(rows, "events-in", "event_id")
    out, mark = shared_path(s, "keyed"), shared_path(s, "keyed-mark")
    sink = imports.keyed_sink(out, "key", 8)

    def twice(batch, batch_id):
        """Each batch is replayed, as after a lost driver."""
        sink(batch, batch_id)
        sink(batch, batch_id)

    imports.run_available(imports.read_stream(s, folder, rows.schema, files_per_trigger=lanes), twice, mark, "keyed")
    return s.read.parquet(out)


add("stream_key_store", lambda s, d: _keyed(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("rows")), [], "SELECT event_type || '-' || CAST(user_id AS STRING) AS key, CAST(1 AS BIGINT) AS rows FROM events GROUP BY 1")

def _stateful(s, d):
    """Repeats are dropped by the stream's own state: the sink appends whatever comes."""
    rows = table(s, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder, lanes = _files(rows, "events-in", "event_id", 2)
    out, mark = shared_path(s, "once"), shared_path(s, "once-mark")
    once = imports.dedupe_stream(imports.read_stream(s, folder, rows.schema, files_per_trigger=lanes), "key", "ts", "400 days")
    imports.run_available(once, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), mark, "once")
    return s.read.parquet(out)


add("stream_dedupe_state", lambda s, d: _stateful(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("rows")), [], "SELECT event_type || '-' || CAST(user_id AS STRING) AS key, CAST(1 AS BIGINT) AS rows FROM events GROUP BY 1")


def _settled(s, d):
    """Orders as items of the queue. By order key: no decision, one before or after its item, or several; and decisions on orders that do not exist."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    key, at = F.col("o_orderkey"), F.lit("2024-03-01 00:00:00").cast("timestamp")
    later = lambda n: F.timestamp_seconds(F.unix_seconds(at) + n)
    items = orders.select(key.cast("string").alias("tx_id"), later(key % 600).alias("ts"), F.col("o_orderpriority").alias("detected_merchant"), F.lit("c").alias("detected_category"))
    kind = F.when(key % 4 == 1, "approved").when(key % 4 == 2, "rejected").otherwise("corrected")
    made = orders.where(key % 4 > 0).select(key.cast("string").alias("tx_id"), later(600 + key % 600).alias("ts"), key.alias("seq"), kind.alias("kind"), F.lit("ann").alias("decided_by"),
                                            F.when(key % 3 == 0, F.lit("N")).alias("merchant"), F.lit(None).cast("string").alias("category"))
    again = made.where("CAST(tx_id AS BIGINT) % 8 = 1").withColumns({"ts": later(1500), "kind": F.lit("rejected"), "decided_by": F.lit("bob")})
    alone = orders.select((-F.col("o_custkey") - 1).cast("string").alias("tx_id")).distinct().select("tx_id", at.alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.lit("approved").alias("kind"),
                                                                                                    F.lit("eve").alias("decided_by"), F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("string").alias("category"))
    (first, some), (second, more) = _files(items, "queue-in", "tx_id", 3), _files(made.unionByName(again).unionByName(alone), "decided-in", "kind", 3, "tx_id")
    # A month later one more item comes, and what is still open has waited too long.
    s.createDataFrame([("clock",)], "tx_id string").select("tx_id", F.lit("2024-04-01 00:00:00").cast("timestamp").alias("ts"), F.lit("m").alias("detected_merchant"), F.lit("c").alias("detected_category")) \
        .coalesce(1).write.mode("append").parquet(first)
    read = lambda p, like, files: imports.read_stream(s, p, like.schema, files_per_trigger=files)
    out, mark = shared_path(s, "settled"), shared_path(s, "settled-mark")
    rows = decisions.settle_stream(read(first, items, some), read(second, made, more), 24, "1 hour")
    imports.run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), mark, "settled")
    return decisions.latest_status(s.read.parquet(out))


add("stream_settled", lambda s, d: _settled(s, d).select("tx_id", "status", "merchant", "category", "decided_by"), [], """
SELECT CAST(o_orderkey AS STRING) AS tx_id, CASE WHEN o_orderkey % 4 = 0 THEN 'overdue' WHEN o_orderkey % 8 = 1 THEN 'rejected' WHEN o_orderkey % 4 = 1 THEN 'approved' WHEN o_orderkey % 4 = 2 THEN 'rejected' ELSE 'corrected' END AS status,
  CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'N' ELSE o_orderpriority END AS merchant, 'c' AS category,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 'bob' ELSE 'ann' END AS decided_by FROM orders
UNION ALL SELECT DISTINCT CAST(-o_custkey - 1 AS STRING), 'orphaned', NULL, NULL, 'eve' FROM orders
UNION ALL SELECT 'clock', 'pending-review', 'm', 'c', NULL""")


def _progress(s, d):
    """An import of all raw rows in four micro-batches with its counters."""
    raw = view(s, d, "raw_rows")
    folder, lanes = _files(raw, "raw-in", "source_line")
    path = {n: shared_path(s, n) for n in ("import-ledger", "import-mark", "import-events", "import-metrics")}
    rows = imports.read_stream(s, folder, raw.schema, files_per_trigger=lanes)
    counters = {"without_amount": F.count_if(F.col("amount").isNull()), "cards": F.count_if(F.col("type") == "pago_tarjeta")}
    progress.run_import(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path['import-ledger']}/batch_id={n}"), path["import-mark"], "raw-rows",
                        path["import-events"], path["import-metrics"], "orders.csv", counters)
    return s.read.parquet(path["import-metrics"]), s.read.parquet(path["import-events"])


_COUNTED = """k AS (SELECT COUNT(*) AS rows, COUNT(*) FILTER (amount IS NULL) AS without_amount, COUNT(*) FILTER (type = 'pago_tarjeta') AS cards FROM raw_rows)"""
add("stream_progress", lambda s, d: progress.metric_totals(_progress(s, d)[0]), ["raw_rows"], """
SELECT metric, CASE metric WHEN 'rows' THEN rows WHEN 'cards' THEN cards ELSE without_amount END AS value, CAST(4 AS BIGINT) AS batches FROM k, (SELECT unnest(['rows', 'without_amount', 'cards']) AS metric)""", _COUNTED)
add("import_events", lambda s, d: _progress(s, d)[1].select("event_type", "aggregate_id", F.get_json_object("data", "$.rows").cast("bigint").alias("rows"),
    F.get_json_object("data", "$.cards").cast("bigint").alias("cards")), ["raw_rows"], """
SELECT 'import-started' AS event_type, 'orders.csv' AS aggregate_id, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS cards UNION ALL SELECT 'import-completed', 'orders.csv', rows, cards FROM k""", _COUNTED)

# ---- equivalences added to a resolved graph --------------------------------------------------


def _updated(s, d):
    """Chains of the orders before a day, then those of the later ones."""
    links = _links(s, d)
    early = links.where("ts IS NULL OR ts < DATE '1997-01-01'")
    known, _, _ = graph.update_canonical(graph.canonicalise(early), graph.latest_links(early), links.where("ts >= DATE '1997-01-01'"))
    return known


add("canonical_updated", lambda s, d: _updated(s, d).where("id LIKE 'c%'").select("id", "canonical_id", "hops"), [],
    "SELECT src AS id, 'p' || CAST(dst - dst % 10 + 9 AS STRING) AS canonical_id, CAST(10 - dst % 10 AS BIGINT) AS hops FROM e", _LATEST)

# ---- nested shapes ---------------------------------------------------------------------------

_KEY = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"


def _nested(s, d):
    """Order lines as whole transactions; by their place, each of the fields is wrong once."""
    rows = table(s, d, "lineitem")
    k = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 18).cast("int")
    rows = rows.withColumn("k", k).withColumn("h", F.sha2(F.expr(_KEY), 256))
    uuid = F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # A few digests in ten million are all digits, which upper case leaves as they are; a letter in front makes the id wrong in each.
    capital = F.concat(F.lit("A"), F.substring(F.upper(uuid), 2, 35))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    bad = lambda n, wrong, right: F.when(F.col("k") == n, wrong).otherwise(right)
    none = F.lit(None).cast("string")
    money = F.col("l_extendedprice").cast("double")
    name, sure = F.concat(F.lit("shop "), F.col("l_suppkey").cast("string")), F.col("l_tax").cast("double")
    merchant = F.struct(name.alias("canonical_name"), bad(6, F.lit(1.5), sure).alias("confidence"), none.alias("extracted_from"))
    category = F.struct(bad(7, F.lit(""), F.lit("things")).alias("name"), bad(16, F.lit(None).cast("double"), sure).alias("confidence"), F.lit("r1").alias("rule_id"))
    source = F.struct(bad(9, F.lit(""), F.lit("a.csv")).alias("source_file"), F.col("l_linenumber").alias("source_line"), bad(15, F.lit("soon"), day).alias("imported_at"), none.alias("imported_by"),
                      F.lit("1").alias("parser_version"), bad(10, F.lit("x"), none).alias("extra"))
    return rows.select(
        F.col("h").alias("key"), "k", bad(1, capital, uuid).alias("id"), bad(2, F.date_format("l_shipdate", "dd/MM/yyyy"), day).alias("date"), F.when(F.col("k") == 3, 0.0).when(F.col("k") == 15, -money).otherwise(money).alias("amount"),
        F.when(F.col("k") == 4, "").when(F.col("k") == 14, none).otherwise("text").alias("description"), bad(5, F.lit("odd"), F.lit("credit-payment")).alias("type"),
        F.when(F.col("k") != 14, merchant).alias("merchant"), F.when(F.col("k") != 17, category).alias("category"), F.when(F.col("k") != 8, source).alias("provenance"),
        F.when(F.col("k") == 11, "usd").when(F.col("k") % 2 == 0, "USD").alias("currency"), bad(12, F.lit("x"), none).alias("account_id"), none.alias("notes"), bad(13, F.lit(1), F.lit(None).cast("int")).alias("unknown"))


_WRONG = {1: "id", 2: "date", 3: "amount", 4: "description", 5: "type", 6: "merchant.confidence", 7: "category.name", 8: "provenance", 9: "provenance.source_file", 10: "provenance.extra", 11: "currency",
          12: "account_id", 13: "unknown", 14: "description", 15: "amount|provenance.imported_at", 16: "category.confidence"}
_PATHS = "CASE k " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in _WRONG.items()) + " ELSE '' END"
_K = f"nk AS (SELECT (l_orderkey * 7 + l_linenumber) % 18 AS k, sha256({_KEY}) AS key FROM lineitem)"
add("closed_shape", lambda s, d: shapes.conform(_nested(s, d), ignore=("key", "k")).select("key", F.transform("problems", lambda p: p["path"]).alias("paths"), "valid"), [],
    "WITH " + _K + f" SELECT key, {_PATHS} AS paths, {_PATHS} = '' AS valid FROM nk")
add("closed_shape_counts", lambda s, d: shapes.problem_counts(shapes.conform(_nested(s, d), ignore=("key", "k"))), [], "WITH " + _K + """
SELECT path, CASE WHEN path IN ('id', 'account_id') THEN 'Must be a valid UUID' WHEN path = 'amount' THEN 'Number must be positive' WHEN path IN ('date', 'provenance.imported_at') THEN 'Date must be in YYYY-MM-DD format'
  WHEN path IN ('provenance', 'category.confidence') OR k = 14 THEN 'is missing' WHEN path IN ('description', 'category.name', 'provenance.source_file') THEN 'String must not be empty' WHEN path = 'type' THEN 'Invalid transaction type'
  WHEN path = 'merchant.confidence' THEN 'Confidence must be between 0.0 and 1.0' WHEN path = 'currency' THEN 'is out of bounds' ELSE 'is not allowed' END AS message, COUNT(*) AS rows
FROM (SELECT k, unnest(string_split(""" + _PATHS + """, '|')) AS path FROM nk) WHERE path <> '' GROUP BY 1, 2""")


def _split(s, d):
    good, bad = quality.split_valid(shapes.conform(_nested(s, d), ignore=("key", "k")))
    return good.select("key", F.lit("kept").alias("side")).unionByName(bad.select("key", F.lit("quarantine").alias("side")))


add("split_valid", _split, [], "WITH " + _K + f" SELECT key, CASE WHEN {_PATHS} = '' THEN 'kept' ELSE 'quarantine' END AS side FROM nk")


def _stages(s, d):
    """What each stage must add, null on every nth row; stages 3 and 4 let rows pass that expect no merchant."""
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("n"))
    names = [c for cs in quality.STAGE_COLUMNS.values() for c in cs]
    made = {c: F.when(F.col("n") % (i + 2) > 0, F.lit("x")) for i, c in enumerate(names) if c != "merchant_expected"}
    rows = rows.withColumns(made | {"merchant_expected": F.col("n") % 5 > 0})
    out = None
    for stage in range(1, 6):
        one = quality.stage_report(rows, stage).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out


def _stage_sql():
    names = [c for cs in quality.STAGE_COLUMNS.values() for c in cs]
    parts = []
    for stage, columns in quality.STAGE_COLUMNS.items():
        test = " AND ".join(f"n % {names.index(c) + 2} > 0" for c in columns if c != "merchant_expected")
        if stage in (3, 4):
            test = f"({test}) OR NOT n % 5 > 0"
        parts.append(f"SELECT COUNT(*) FILTER ({test}) AS valid, COUNT(*) FILTER (NOT ({test})) AS invalid, CAST({stage} AS BIGINT) AS stage FROM m")
    return "WITH m AS (SELECT l_orderkey * 7 + l_linenumber AS n FROM lineitem) " + " UNION ALL ".join(parts)


add("stage_reports_all", _stages, [], _stage_sql())

# ---- many rules ------------------------------------------------------------------------------


def _many(s, d):
    """A rule for each part: its name and the last digits of a reference; a plain rule for each line that is no card charge; and one that takes the rest of the clips."""
    part, key = table(s, d, "part"), F.col("p_partkey").cast("string")
    # Parts come in the order of their numbers, the others behind them. As its SQL says, a part without a size is no rule that could win.
    pattern = F.concat(F.lit(r"CARG RECUR\. "), F.upper("p_name"), F.lit(r" REF\. 1\d*"), F.lpad(F.pmod("p_partkey", F.lit(100)).cast("string"), 2, "0"))
    rules = part.where("p_size IS NOT NULL").select(F.col("p_partkey").alias("place"), F.concat(F.lit("r"), key).alias("id"), pattern.alias("pattern"), F.lit(True).alias("is_regex"), F.concat(F.lit("m"), key).alias("merchant"),
                        F.col("p_type").alias("category"), F.lit("expense").alias("type"), F.lit(0.9).alias("confidence"), F.col("p_size").alias("priority"))
    more = [C.Rule("transfer", "transf interbancaria spei", False, None, "transfer", "transfer", 0.8, 1), C.Rule("any", r"[A-Z]+ .*", True, "rest", None, None, None, -5), C.Rule("clip", r"CLIP .*", True, "clip", "card", None, 0.5, 2)]
    last = 1 << 62
    rules = rules.unionByName(s.createDataFrame([(last + i, r.id, r.pattern, r.is_regex, r.merchant, r.category, r.type, r.confidence, r.priority) for i, r in enumerate(more)], f"place long, {C.RULE_SCHEMA}"))
    rows = view(s, d, "statement_rows").select("tx_id", "description", F.lit(None).cast("string").alias("merchant"), F.lit("unknown").alias("type"))
    return rule_index.classify_indexed(rows, rules).select("tx_id", "rule_id", "merchant_id", "category_id", "type", "confidence")


add("classify_many_rules", _many, ["statement_rows"], r"""
SELECT tx_id, rule_id, merchant_id, category_id, type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY tx_id, description ORDER BY priority DESC, k) AS place FROM (
  SELECT tx_id, description, 'r' || p_partkey AS rule_id, 'm' || p_partkey AS merchant_id, p_type AS category_id, 'expense' AS type, 0.9::DOUBLE AS confidence, p_size AS priority, p_partkey AS k
    FROM (SELECT DISTINCT tx_id, description FROM statement_rows) t JOIN part ON regexp_extract(description, '^CARG RECUR\. (.*) REF\. 1[0-9]*$', 1) = upper(p_name) AND right(description, 2) = lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
  UNION ALL SELECT tx_id, description, 'transfer', NULL, 'transfer', 'transfer', 0.8, 1, 1000000000 FROM (SELECT DISTINCT tx_id, description FROM statement_rows) WHERE upper(description) = 'TRANSF INTERBANCARIA SPEI'
  UNION ALL SELECT tx_id, description, 'clip', 'clip', 'card', 'unknown', 0.5, 2, 1000000002 FROM (SELECT DISTINCT tx_id, description FROM statement_rows) WHERE regexp_full_match(upper(description), 'CLIP .*')
  UNION ALL SELECT tx_id, description, 'any', 'rest', NULL, 'unknown', NULL, -5, 1000000001 FROM (SELECT DISTINCT tx_id, description FROM statement_rows) WHERE regexp_full_match(upper(description), '[A-Z]+ .*')
  UNION ALL SELECT tx_id, description, NULL, NULL, 'uncategorized', 'unknown', 0.0, -100, 0 FROM (SELECT DISTINCT tx_id, description FROM statement_rows))) WHERE place = 1""")
