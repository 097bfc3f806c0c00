"""Queries over the event log, the append-only store and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import events as E
from tallyloom.operators import summaries
from tallyloom.operators.classify import load_rules
from tallyloom.plans.portable import portable
from tallyloom.plans.views import table, view, with_views
from tallyloom.runtime import shared_path
from tallyloom.sources import tables as T
from tallyloom.streaming import imports, review as stream_review

Q: dict = {}


def add(name, fn, views, body, *ctes):
    sql = None if body is None else with_views(views, body, *ctes) if views or ctes else body
    Q[name] = (lambda s, d: portable(fn(s, d)), sql)


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_FIELDS = {"amount": "decimal(18,2)", "note": "string", "flag": "boolean"}


def log(s, d):
    """The event log with payloads: imports carry amount and note, the others one field each."""
    rows = view(s, d, "event_log")
    money = F.col("value").cast("decimal(18,2)")
    body = (
        F.when(F.col("event_type") == E.IMPORTED, F.to_json(F.struct(money.alias("amount"), F.col("props").alias("note"))))
        .when(F.col("event_type") == E.MERGING[0], F.to_json(F.struct(F.col("props").alias("note"))))
        .when(F.col("event_type") == E.MERGING[1], F.to_json(F.struct(money.alias("amount"), F.lit("why").alias("reason"))))
        .when(F.col("event_type") == E.MERGING[2], F.to_json(F.struct((F.col("value") > 20).alias("flag"))))
        .otherwise(F.to_json(F.struct(F.lit("large-amount").alias("issue"), money.alias("amount"), (F.col("value") > 50).alias("resolved"))))
    )
    return rows.select("seq", "ts", "aggregate_id", "event_type", body.alias("data"), F.lit("{}").alias("metadata"))


_STATE = """lg AS (SELECT * FROM event_log WHERE {w}),
im AS (SELECT aggregate_id, max(seq) AS imp FROM lg WHERE event_type = 'transaction-imported' GROUP BY 1),
af AS (SELECT lg.*, imp FROM lg LEFT JOIN im USING (aggregate_id) WHERE event_type <> 'discrepancy-detected' AND seq >= COALESCE(imp, -1)),
st AS (SELECT aggregate_id AS tx_id, arg_max(CAST(value AS DECIMAL(18,2)), seq) FILTER (event_type IN ('transaction-imported', 'transaction-corrected')) AS amount,
  arg_max(props, seq) FILTER (event_type IN ('transaction-imported', 'transaction-classified')) AS note,
  arg_max(value > 20, seq) FILTER (event_type = 'transaction-verified') AS flag, max(imp) IS NOT NULL AS has_import FROM af GROUP BY 1)"""
_OUT = "SELECT tx_id, CAST(amount AS DOUBLE) AS amount, note, flag, has_import FROM st"
_COLS = ["tx_id", "amount", "note", "flag", "has_import"]
add("project_state", lambda s, d: E.project_state(log(s, d), _FIELDS).select(*_COLS), ["event_log"], _OUT, _STATE.format(w="TRUE"))
add("state_at_time", lambda s, d: E.project_state(log(s, d), _FIELDS, "2024-01-12 00:00:00").select(*_COLS), ["event_log"], _OUT,
    _STATE.format(w="ts <= TIMESTAMP '2024-01-12 00:00:00'"))
add("state_of_chosen", lambda s, d: E.project_state(log(s, d), _FIELDS, ids=table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("aggregate_id"))).select(*_COLS),
    ["event_log"], _OUT + " WHERE tx_id IN (SELECT CAST(s_suppkey AS STRING) FROM supplier)", _STATE.format(w="TRUE"))
add("get_transaction", lambda s, d: E.project_state(log(s, d).where("aggregate_id = '7'"), _FIELDS).select(*_COLS), ["event_log"], _OUT + " WHERE tx_id = '7'", _STATE.format(w="TRUE"))
add("statistics_at_time", lambda s, d: summaries.ledger_statistics(E.project_state(log(s, d), _FIELDS, "2024-01-12 00:00:00").select(
    "amount", F.when(F.col("flag"), "income").otherwise("expense").alias("type"), F.lit(0.8).alias("confidence"), F.col("flag").alias("verified"))), ["event_log"], """
SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN flag THEN amount ELSE 0 END) AS DOUBLE) AS income, CAST(SUM(CASE WHEN flag THEN 0 ELSE amount END) AS DOUBLE) AS expenses,
  CAST(SUM(CASE WHEN flag THEN amount ELSE 0 END) - SUM(CASE WHEN flag THEN 0 ELSE amount END) AS DOUBLE) AS net, CAST(0 AS BIGINT) AS high_confidence, COUNT(*) AS medium_confidence,
  CAST(0 AS BIGINT) AS low_confidence, COUNT(*) FILTER (NOT COALESCE(flag, false)) AS unverified FROM st""", _STATE.format(w="ts <= TIMESTAMP '2024-01-12 00:00:00'"))
add("events_as_of", lambda s, d: E.as_of(log(s, d), "2024-01-10 12:00:00").select("seq", "ts"), ["event_log"], f"SELECT seq, {_TS} AS ts FROM event_log WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'")
add("events_since", lambda s, d: E.since(log(s, d), "2024-01-10 12:00:00").select("seq"), ["event_log"], "SELECT seq FROM event_log WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
add("events_by_type", lambda s, d: E.events_by_type(log(s, d), E.IMPORTED).select("seq", "aggregate_id"), ["event_log"], "SELECT seq, aggregate_id FROM event_log WHERE event_type = 'transaction-imported'")
add("events_in_range", lambda s, d: E.events_in_range(log(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("seq"), ["event_log"],
    "SELECT seq FROM event_log WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
add("latest_event", lambda s, d: E.latest_event(log(s, d), E.IMPORTED).select("seq", "aggregate_id"), ["event_log"],
    "SELECT seq, aggregate_id FROM event_log WHERE event_type = 'transaction-imported' ORDER BY ts DESC, seq DESC LIMIT 1")
add("latest_event_per_type", lambda s, d: E.latest_per(log(s, d), ["event_type"]).select("event_type", "seq"), ["event_log"], "SELECT event_type, arg_max(seq, (ts, seq)) AS seq FROM event_log GROUP BY 1")
add("event_types", lambda s, d: E.event_types(log(s, d)), ["event_log"], "SELECT DISTINCT event_type FROM event_log")
add("event_counts", lambda s, d: E.event_counts(log(s, d)), ["event_log"], "SELECT event_type, COUNT(*) AS rows FROM event_log GROUP BY 1")
add("event_timeline", lambda s, d: E.event_timeline(log(s, d)), ["event_log"], "SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS rows FROM event_log GROUP BY 1")
add("aggregate_events", lambda s, d: E.aggregate_events(view(s, d, "event_log"), E.MERGING[1], ["aggregate_id"], [F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")]),
    ["event_log"], "SELECT aggregate_id, COUNT(*) AS rows, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM event_log WHERE event_type = 'transaction-corrected' GROUP BY 1")
add("transaction_history", lambda s, d: E.transaction_history(log(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("tx_id"))).select("seq", "aggregate_id", "event_type"),
    ["event_log"], "SELECT seq, aggregate_id, event_type FROM event_log WHERE aggregate_id IN (SELECT CAST(s_suppkey AS STRING) FROM supplier)")
add("unresolved_discrepancies", lambda s, d: E.unresolved_discrepancies(log(s, d)).select("seq", "aggregate_id", "issue", "amount"), ["event_log"],
    "SELECT seq, aggregate_id, 'large-amount' AS issue, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM event_log WHERE event_type = 'discrepancy-detected' AND NOT value > 50")


def _replayed(s, d):
    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"aggregate_id": [pdf["aggregate_id"].iloc[0]], "events": [len(pdf)], "last_type": [pdf["event_type"].iloc[-1]]})

    return E.replay(log(s, d), total, "aggregate_id STRING, events BIGINT, last_type STRING")


add("replay_events", _replayed, ["event_log"], "SELECT aggregate_id, COUNT(*) AS events, arg_max(event_type, (ts, seq)) AS last_type FROM event_log GROUP BY 1")


def _verdicts(s, d):
    """Duplicate verdicts on orders, some of them revised."""
    rows = view(s, d, "event_log")
    made = rows.select(F.col("aggregate_id").alias("duplicate_id"), (F.col("value") > 20).alias("is_duplicate"), "ts", "seq")
    return E.duplicate_resolved(made, F.col("ts"), seq=F.col("seq"))


_VERDICT = "vd AS (SELECT aggregate_id AS id, arg_max(value > 20, (ts, seq)) AS dup FROM event_log GROUP BY 1)"
add("confirmed_duplicates", lambda s, d: E.confirmed_duplicates(_verdicts(s, d)), ["event_log"], "SELECT id AS duplicate_id FROM vd WHERE dup", _VERDICT)
add("rejected_duplicates", lambda s, d: E.rejected_duplicates(_verdicts(s, d)), ["event_log"], "SELECT id AS duplicate_id FROM vd WHERE NOT dup", _VERDICT)
add("mark_duplicates", lambda s, d: E.mark_duplicates(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("tx_id")), _verdicts(s, d)), ["event_log"],
    "SELECT CAST(o_orderkey AS STRING) AS tx_id, COALESCE(dup, false) AS is_duplicate FROM orders LEFT JOIN vd ON id = CAST(o_orderkey AS STRING)", _VERDICT)


def _built(s, d):
    rows = view(s, d, "orders_ledger").withColumns({"description": F.col("merchant"), "merchant_id": F.lit(None).cast("string"), "category_id": F.lit("c")})
    at, seq = F.col("date").cast("timestamp"), F.col("tx_id")
    first = E.imported(rows, at, seq=seq)
    second = E.classified(rows.where("type = 'income'").withColumn("category_id", F.lit("pay")), at, seq=seq + 1)
    third = E.corrected(rows.withColumn("amount", F.col("amount") + 1).where("type = 'expense'"), at, ["amount", "reason"], seq=seq + 2)
    fourth = E.verified(rows.where("verified"), at, seq=seq + 3)
    state = E.project_state(first.unionByName(second).unionByName(third).unionByName(fourth))
    return state.select("tx_id", "amount", "category_id", "merchant_id", "verified", "events")


add("build_and_project", _built, ["orders_ledger"], """
SELECT CAST(tx_id AS STRING) AS tx_id, CAST(CASE WHEN type = 'expense' THEN amount + 1 ELSE amount END AS DOUBLE) AS amount, CASE WHEN type = 'income' THEN 'pay' ELSE 'c' END AS category_id,
  CAST(NULL AS STRING) AS merchant_id, CASE WHEN verified THEN true END AS verified, 1 + CASE WHEN type IN ('income', 'expense') THEN 1 ELSE 0 END + CASE WHEN verified THEN 1 ELSE 0 END::BIGINT AS events FROM orders_ledger""")


def _log_table(s, d):
    """The log written by day and read back with a time filter."""
    path = shared_path(s, "event-log")
    E.append_events(log(s, d), path)
    E.append_events(log(s, d).limit(0), path)
    return E.events_in_range(s.read.parquet(path).where("event_date = date'2024-01-05'"), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("seq", "event_type")


add("event_log_table", _log_table, ["event_log"], "SELECT seq, event_type FROM event_log WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
add("valid_at", lambda s, d: E.valid_at(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.when(F.col("o_orderstatus") != "O",
    F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("valid_until")), "1997-05-01 00:00:00").select("o_orderkey"), [], """
SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-05-01' AND (o_orderstatus = 'O' OR TIMESTAMP '1997-05-01' < o_orderdate + INTERVAL 30 DAY)""")

# ---- append-only store -----------------------------------------------------------------------


def _append_twice(s, d):
    rows = view(s, d, "feed").select("merchant", "date", "amount", "tx_id")
    path = shared_path(s, "ledger")
    first = [F.col("tx_id")]
    T.append_idempotent(rows.where("amount > 50000"), path, "merchant", first)
    T.append_idempotent(rows, path, "merchant", first)
    T.append_idempotent(rows, path, "merchant", first)
    return s.read.parquet(path).groupBy("merchant").agg(F.count(F.lit(1)).alias("stored"))


add("append_idempotent", _append_twice, ["feed"], "SELECT merchant, CAST(1 AS BIGINT) AS stored FROM feed GROUP BY 1")


def _store(s, d):
    rows = view(s, d, "coarse").select("tx_id", F.col("status").alias("entity_type"), F.create_map(F.lit("m"), F.col("merchant"), F.lit("a"), F.col("amount").cast("string")).alias("data"))
    return T.with_store_hash(rows).withColumn("seq", F.col("tx_id"))


add("store_duplicates", lambda s, d: T.flag_known(_store(s, d), _store(s, d).where("entity_type = 'posted'").limit(0)).select("tx_id", "duplicate"), ["coarse"],
    "SELECT tx_id, row_number() OVER (PARTITION BY status, merchant, amount ORDER BY tx_id) > 1 AS duplicate FROM coarse")
add("store_counts", lambda s, d: _store(s, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("distinct_rows")), ["coarse"],
    "SELECT status AS entity_type, COUNT(*) AS rows, COUNT(DISTINCT (merchant, amount)) AS distinct_rows FROM coarse GROUP BY 1")
add("import_metrics", lambda s, d: T.import_metrics(view(s, d, "feed").withColumn("category_id", F.when(F.col("source") == "N", "x")), view(s, d, "feed").where("source = 'A'")), ["feed"], """
SELECT COUNT(*) AS offered, COUNT(*) FILTER (source = 'A') AS skipped, COUNT(*) FILTER (source <> 'A') AS imported, COUNT(*) FILTER (source = 'N') AS classified FROM feed""")
add("unprocessed_files", lambda s, d: T.unprocessed_files(table(s, d, "documents").select(F.col("source").alias("source_file")).distinct(), table(s, d, "documents").where("n_chars > 15000").select(F.col("source").alias("source_file"))), [],
    "SELECT DISTINCT source AS source_file FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 15000)")

# ---- streams ---------------------------------------------------------------------------------


def _raw_stream(s, d):
    """Order lines as a stream of raw rows."""
    lines = imports.table_stream(s, d, "lineitem", table(s, d, "lineitem").schema)
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return lines.select(
        F.when(F.col("l_quantity") == 13, "bad").otherwise(day).alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "GASTO").otherwise("INGRESO").alias("type"), F.lit("bofa").alias("bank"),
        F.when(F.col("l_returnflag") == "A", "RED WIDGET").when(F.col("l_returnflag") == "N", "HOT GEAR").otherwise("PLAIN THING").alias("merchant"),
        F.when(F.col("l_returnflag") == "A", "RED WIDGET").otherwise("OTHER").alias("description"), F.lit("s.csv").alias("source_file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_line"))


def _streamed(s, d):
    ledger, events, mark = (shared_path(s, n) for n in ("stream-ledger", "stream-events", "stream-mark"))
    imports.stream_import(_raw_stream(s, d), ledger, events, mark, load_rules())
    return s.read.parquet(ledger), s.read.parquet(events)


_RAWS = """ids AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, l_returnflag = 'A' AS w, l_orderkey * 10 + l_linenumber AS n,
  l_returnflag AS f FROM lineitem WHERE l_quantity <> 13), one AS (SELECT d, a, w, n, min(f) AS f FROM ids GROUP BY ALL)"""
add("stream_import", lambda s, d: _streamed(s, d)[0].groupBy("description").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("tx_id").alias("ids"), F.sum("amount").alias("total")), [], """
SELECT CASE WHEN w THEN 'RED WIDGET' ELSE 'OTHER' END AS description, COUNT(*) AS rows, COUNT(*) AS ids, CAST(SUM(a) AS DOUBLE) AS total FROM one GROUP BY 1""", _RAWS)
add("stream_events", lambda s, d: _streamed(s, d)[1].groupBy("event_type").agg(F.count(F.lit(1)).alias("rows")), [], """
SELECT unnest(['transaction-imported', 'transaction-classified']) AS event_type, COUNT(*) AS rows FROM one""", _RAWS)


def _reviewed(s, d):
    raw = _raw_stream(s, d)
    ledger, _ = imports.parse_stream(raw)
    cats = s.createDataFrame([("Widget", "shopping", "w", 0.97)], "merchant STRING, category STRING, rule_id STRING, confidence DOUBLE")
    routed = stream_review.enrich_stream(ledger.drop("provenance"), ["Widget"], cats)
    yes, no, mark = (shared_path(s, n) for n in ("approved", "queue", "review-mark"))
    stream_review.stream_review(routed, yes, no, mark)
    side = lambda p, n: s.read.parquet(p).agg(F.lit(n).alias("queue"), F.count(F.lit(1)).alias("rows"))
    return side(yes, "approved").unionByName(side(no, "pending"))


add("stream_review", _reviewed, [], "SELECT CASE WHEN w THEN 'approved' ELSE 'pending' END AS queue, COUNT(*) AS rows FROM one GROUP BY 1", _RAWS)


def _deduped(s, d):
    events = imports.table_stream(s, d, "events", table(s, d, "events").schema).withColumns({"ts": F.col("ts").cast("timestamp"), "key": F.concat_ws("-", "event_type", F.col("user_id").cast("string"))})
    out, mark = shared_path(s, "deduped"), shared_path(s, "dedupe-mark")
    imports.run_available(imports.dedupe_stream(events, "key", "ts", "60 days").select("key", "ts", "event_id"), imports.idempotent_sink(out, "key"), mark, "dedupe")
    return s.read.parquet(out).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


add("stream_dedupe", _deduped, [], "SELECT event_type || '-' || CAST(user_id AS STRING) AS key, CAST(1 AS BIGINT) AS rows FROM events GROUP BY 1")


def _stream_decisions(s, d):
    rows = imports.table_stream(s, d, "labels", table(s, d, "labels").schema).select(F.col("doc_id").cast("string").alias("decision_id"), F.when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("kind"))
    out, mark = shared_path(s, "decisions"), shared_path(s, "decisions-mark")
    stream_review.stream_decisions(rows, out, mark)
    return s.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


add("stream_decisions", _stream_decisions, [], "SELECT CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS kind, COUNT(*) AS rows FROM labels GROUP BY 1")
