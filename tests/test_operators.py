from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import normalise as N
from tallyloom.functions.predicates import constraint
from tallyloom.functions.skew import Running, running, spread_join, hot_groups
from tallyloom.operators import balance, duplicates, graph, quality, versions
from tallyloom.operators import classify as C
from tallyloom.operators import registry as R
from tallyloom.operators.anomaly import zscore_anomalies
from tallyloom.operators.cleaning import import_rows, tag_rows
from tallyloom.sources import lines as L
from tallyloom.sources import statements as S


def values(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


RAW = "date STRING, amount STRING, merchant STRING, type STRING, bank STRING, description STRING, source_file STRING, source_line BIGINT"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_dates_are_strict(spark):
    df = spark.createDataFrame([("03/20/2024",), ("2024-03-20",), ("2024/03/20",), ("text",), (None,)], "d STRING")
    got = [str(r[0]) for r in df.select(N.parse_date(F.col("d"))).collect()]
    assert got == ["2024-03-20", "2024-03-20", "None", "None", "None"]


def test_money_and_merchants(spark):
    df = spark.createDataFrame([("$1,234.50", "STARBUCKS #123"), ("-45.99", "UBER RIDE 45678, DES: TRIP"), ("abc", ""), (None, None)], "a STRING, m STRING")
    got = [tuple(r) for r in df.select(N.parse_money(F.col("a")), N.normalise_merchant(F.col("m"))).collect()]
    assert got == [(Decimal("1234.50"), "starbucks"), (Decimal("45.99"), "uber-ride"), (None, "unknown-merchant"), (None, "unknown-merchant")]


def test_import_splits_and_is_stable(spark):
    rows = [
        ("03/20/2024", "$4.99", "STARBUCKS", "GASTO", "BofA", "STARBUCKS #1", "f.csv", 2),
        ("bad", "1", "X", "GASTO", "Wise", "X", "f.csv", 3),
        ("2024-01-01", "0", "X", "INGRESO", "Wise", "X", "f.csv", 4),
        ("2024-01-01", "5", "X", "OTRO", "HSBC", "X", "f.csv", 5),
    ]
    good, bad = import_rows(raw(spark, rows))
    assert values(good, "type", "bank", "merchant") == [("expense", "bofa", "starbucks")]
    assert values(bad, "source_line", "reason") == [(3, "bad-date"), (4, "amount-not-positive"), (5, "bad-type")]
    again, _ = import_rows(raw(spark, list(reversed(rows))))
    assert values(good, "tx_id") == values(again, "tx_id")


def test_fail_loud(spark):
    rows = [("bad", "1", "X", "GASTO", "Wise", "X", "f.csv", 3)]
    with pytest.raises(Exception, match="cannot read date"):
        tag_rows(raw(spark, rows), on_error="fail").collect()


def test_rules_by_priority_then_order(spark):
    rules = [C.Rule("prefix", "STAR.*", True, "star", "food", "expense", 0.9, 10), C.Rule("exact", "starbucks", False, "sbux", "coffee", "expense", 0.98, 20),
             C.Rule("tie", "STAR.*", True, "other", "x", "expense", 0.9, 10)]
    df = spark.createDataFrame([("STARBUCKS", None), ("Starbucks 12", None), ("none", "starbucks"), ("none", None)], "description STRING, merchant STRING")
    got = [tuple(r) for r in C.classify(df, rules).select("rule_id", "category_id", "confidence").collect()]
    assert got == [("exact", "coffee", 0.98), ("prefix", "food", 0.9), ("exact", "coffee", 0.98), (None, "uncategorized", 0.0)]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "ab"), (5, None)], "n INT, s STRING")
    keep = lambda spec, c="n": [r.n for r in df.where(constraint(F.col(c), spec)).collect()]
    assert keep((">", 1)) == [5] and keep(("between", (1, 2))) == [1] and keep(("in", [5])) == [5]
    assert keep(("nil",), "s") == [5] and keep(("matches", "a."), "s") == [1] and keep(("!=", "ab"), "s") == [5]
    with pytest.raises(ValueError):
        constraint(F.col("n"), ("like", 1))


@pytest.mark.parametrize("floor", [10**9, 5])
def test_running_equals_plain_window(spark, floor):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 11).cast("int")).alias("d"), F.col("id").alias("i"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    specs = [Running("s", "sum", F.col("v")), Running("n", "count", F.lit(1)), Running("l", "last", F.col("v")), Running("m", "max", F.col("v"))]
    got = running(df, ["k"], ["d", "i"], specs, share=0.2, floor=floor)
    df.createOrReplaceTempView("plain_rows")
    want = spark.sql("""SELECT k, d, i, sum(v) OVER w AS s, count(1) OVER w AS n, last(v, true) OVER w AS l, max(v) OVER w AS m
        FROM plain_rows WINDOW w AS (PARTITION BY k ORDER BY d, i ROWS UNBOUNDED PRECEDING)""")
    cols = ["k", "i", "s", "n", "l", "m"]
    assert values(got, *cols) == values(want, *cols)


def test_spread_join_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)] + [(99, "b")], "i INT, k STRING")
    lookup = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, x INT")
    hot = hot_groups(rows, ["k"], share=0.1, floor=3)
    assert len(hot) == 2
    got = values(spread_join(rows, lookup, ["k"], ["i"], hot), "i", "x")
    assert got == values(rows.join(lookup, "k", "left"), "i", "x")


def test_balance_last_row_is_final(spark):
    df = spark.createDataFrame([(1, "2024-01-02", 10.0, "income"), (2, "2024-01-01", 4.0, "expense"), (3, "2024-01-03", 7.0, "transfer")], "tx_id INT, date STRING, amount DOUBLE, type STRING")
    df = df.withColumns({"date": F.col("date").cast("date"), "amount": F.col("amount").cast("decimal(18,2)"), "account_id": F.lit("x")})
    got = values(balance.running_balance(df, 100), "tx_id", "balance")
    assert got == [(1, Decimal("106.00")), (2, Decimal("96.00")), (3, Decimal("106.00"))]
    assert balance.final_balance(df, 100).first()[0] == Decimal("106.00")
    with pytest.raises(Exception, match="balance differs"):
        balance.verify_balance(balance.reconcile_all(df, 100, 1)).collect()


def near_rows(spark):
    return spark.range(300).select(
        F.format_string("t%03d", F.col("id")).alias("tx_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"),
        (F.col("id") * 37 % 101 / 50).cast("decimal(18,2)").alias("amount"), F.format_string("s%d", F.col("id") % 6).alias("source"))


@pytest.mark.parametrize("floor", [10**9, 1])
def test_near_duplicates_equal_brute_force(spark, floor):
    df = near_rows(spark)
    rows = [r.asDict() for r in df.collect()]
    want = []
    for a in rows:
        hits = [(-(1 - 0.3 * abs((a["date"] - b["date"]).days) / 2 - 0.7 * float(abs(a["amount"] - b["amount"])) / 0.5), b["tx_id"])
                for b in rows if a["source"] != b["source"] and abs((a["date"] - b["date"]).days) < 2 and abs(a["amount"] - b["amount"]) < Decimal("0.5")]
        if hits:
            want.append((a["tx_id"], len(hits), round(-min(hits)[0], 9)))
    got = duplicates.near_duplicates(df, share=0.0001, floor=floor)
    assert sorted((r.tx_id, r.matches, round(r.best_score, 9)) for r in got.collect()) == sorted(want)


def test_only_points_with_matches_meet_cells(spark, monkeypatch):
    """Points at the borders of tiles, below zero, and of one source alone; what is written and looked around is only what has matches."""
    import datetime

    start, rows = datetime.date(1970, 1, 1) - datetime.timedelta(9), []
    for day in range(0, 20):
        for i, c in enumerate((-1049, -1000, -951, -1, 0, 48, 49, 950, 999, 1000, 1049)):
            rows.append((f"t{day:02d}-{i:02d}", start + datetime.timedelta(day), Decimal(c) / 100, "abc"[(day // 3 + i) % 3]))
    rows += [(f"far{i}", start + datetime.timedelta(400 + 2 * i), Decimal(5), "a") for i in range(300)]
    df = spark.createDataFrame(rows, "tx_id string, date date, amount decimal(18,2), source string")
    kept, made = duplicates.materialise, {}
    monkeypatch.setattr(duplicates, "materialise", lambda frame, label: made.setdefault(label, kept(frame, label)))
    got = {r.tx_id: r.matches for r in duplicates.near_duplicates(df).collect()}
    want = {a[0]: n for a in rows if (n := sum(a[3] != b[3] and abs((a[1] - b[1]).days) < 2 and abs(a[2] - b[2]) < Decimal("0.5") for b in rows))}
    assert got == want and made["points"].count() == len(want) < 300


def test_near_duplicate_pairs_meet_once(spark):
    pairs = duplicates.near_duplicate_points(near_rows(spark))
    total = pairs.agg(F.sum("row_pairs")).first()[0]
    matches = duplicates.near_duplicates(near_rows(spark)).agg(F.sum("matches")).first()[0]
    assert total * 2 == matches


def test_registry_tiers(spark):
    reg = spark.createDataFrame([("uber", "Uber", ["UBER EATS", "ube"]), ("eats", "Uber  Eats Co", ["EATS"])], "entity_id STRING, canonical_name STRING, variations ARRAY<STRING>")
    df = spark.createDataFrame([(1, " uber "), (2, "uber eats"), (3, "PAY UBER EATS NOW"), (4, "zzz"), (5, None)], "tx_id INT, t STRING")
    got = values(R.lookup(df, reg, F.col("t"), "m"), "tx_id", "m_entity", "m_confidence")
    assert got == [(1, "uber", 1.0), (2, "uber", 0.95), (3, "uber", 0.7), (4, None, 0.0), (5, None, None)]


def test_chains_and_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s")], "src STRING, dst STRING")
    got = values(graph.canonicalise(edges), "id", "canonical_id", "hops", "loop")
    assert got == [("a", "c", 2, False), ("b", "c", 1, False), ("s", "s", 1, True), ("x", "y", 3, True), ("y", "y", 2, True), ("z", "z", 2, True)]


def test_anomaly_modes(spark):
    df = spark.createDataFrame([(i, "m", 10.0) for i in range(5)] + [(9, "m", 99.0), (10, "few", 1.0)], "tx_id INT, merchant STRING, amount DOUBLE")
    pop = {r.tx_id: r for r in zscore_anomalies(df).collect()}
    assert not pop[9].is_anomaly and pop[9].history_std == 0 and pop[10].anomaly_reason == "not-enough-history"
    sample = {r.tx_id: r for r in zscore_anomalies(df, mode="sample").collect()}
    assert sample[9].is_anomaly and sample[9].anomaly_score == 1.0 and not sample[1].is_anomaly


def test_versions_diff_with_itself(spark):
    rules = spark.createDataFrame([("a", 1), ("b", 2)], "id STRING, p INT")
    assert values(versions.diff_counts(versions.compare_versions(rules, rules, ["p"])), "change", "rules") == [("unchanged", 2)]


def test_validation_first_failure(spark):
    df = spark.createDataFrame([("x", 5.0), (None, -1.0)], "name STRING, amount DOUBLE")
    rules = [{"field": "name", "required": True}, {"field": "amount", "type": "number", "min": 0, "max": 4, "error": "out of range"}]
    got = [(r.first_error, len(r.violations)) for r in quality.validate_rows(df, rules).collect()]
    assert got == [("out of range", 1), ("Field name is required", 2)]


def test_segment_lines(spark):
    text = ["header", "17 JUN TIENDA UNO $3,140.00 $3,319.18", "RFC/CURP: ABC1", "12345", "JUAN PEREZ LOPEZ", "18 JUN ABONO $1.00 $2.00"] + [f"note {i}" for i in range(15)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file STRING, line_no BIGINT, text STRING")
    got = sorted(L.segment_statement_lines(df).collect(), key=lambda r: r.record_line)
    assert [(r.date, r.retiro, r.deposit, r.beneficiary_name, r.rfc) for r in got] == [
        ("17-JUN", Decimal("3140.00"), None, "JUAN PEREZ LOPEZ", "ABC1"), ("18-JUN", None, Decimal("1.00"), None, None)]
    assert len(got[1].context_lines) == 10


def test_statement_files(spark, tmp_path):
    (tmp_path / "bofa_march.csv").write_text('Date,Description,Amount\n03/20/2024,"STARBUCKS, #1 DES:X",-45.99\n03/21/2024,short\nbad,X,1.00\n')
    (tmp_path / "apple_1.csv").write_text("Date,Description,Amount,Category,Merchant\n03/20/2024,PAYMENT THANK YOU,10.00,Payment,\n")
    (tmp_path / "other.csv").write_text("h\nx\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "bofa_march.csv").write_text("Date,Description,Amount\n03/22/2024,SHOP,x1\n")
    good, bad = S.read_statements(spark, [str(tmp_path / "*.csv"), str(tmp_path / "more" / "*.csv")])
    assert [(r.source_line, r.raw_line) for r in bad.where("reason = 'bad-amount'").collect()] == [(2, "03/22/2024,SHOP,x1")]
    bad = bad.where("reason <> 'bad-amount'")
    assert values(good, "bank", "source_line", "merchant", "amount", "type") == [
        ("apple-card", 2, "PAYMENT", Decimal("10.00"), "transfer"), ("bofa", 2, "STARBUCKS,", Decimal("45.99"), "expense")]
    assert values(bad, "source_line", "reason") == [(2, "unknown-source"), (3, "short-row"), (4, "bad-date")]


def test_combined_file(spark, tmp_path):
    head = ",".join(S.LAYOUTS["combined"])
    row = "2024-01-01,SHOP,5.00,,GASTO,Food,,USD,Acc,1,BofA,,x,note"
    (tmp_path / "all.csv").write_text(f"{head}\n{row}\na,b\n")
    rows, short = S.read_combined(spark, str(tmp_path / "all.csv"))
    assert values(rows, "amount", "merchant", "source_file", "source_line") == [("5.00", "SHOP", "all.csv", 2)]
    assert short.count() == 1


def test_stripe_feed(spark, tmp_path):
    (tmp_path / "stripe.json").write_text('{"data":[{"id":"t1","amount":286770,"currency":"usd","description":"Payment from Ana","created":1735084800,"type":"charge"}]}')
    (tmp_path / "stripe_broken.json").write_text('{"data":[{"id":')
    rows, broken = S.read_stripe(spark, str(tmp_path / "*.json"))
    assert [(r.source_file, r.reason) for r in broken.collect()] == [("stripe_broken.json", "bad-json")] and rows.count() == 1
    got = rows.first()
    assert (got.tx_id, got.amount, got.merchant, str(got.date), got.type, got.currency) == ("t1", Decimal("2867.70"), "Ana", "2024-12-25", "income", "USD")


def test_plans_have_no_cross_join_or_python(spark):
    df = near_rows(spark).withColumn("merchant", F.col("source"))
    for plan in (duplicates.near_duplicates(df), zscore_anomalies(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("floor", [10**9, 3])
@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("kind", ["decimal(18,2)", "double", "date", "string", "timestamp"])
def test_running_orders_any_type(spark, kind, keys, floor):
    made = {"decimal(18,2)": F.col("id") * 3.5 - 90, "double": F.col("id") * 1.25 - 50, "date": F.date_add(F.lit("1969-12-01").cast("date"), F.col("id").cast("int")),
            "string": F.concat(F.lit("tx-"), F.sha2(F.col("id").cast("string"), 256)), "timestamp": F.timestamp_seconds(F.col("id") * 1000 - 30000)}[kind]
    df = spark.range(120).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(made).cast(kind).alias("o"), "id")
    df = df.withColumn("k", F.when(F.col("k") == 2, F.lit(None)).otherwise(F.col("k")))
    got = running(df, keys, ["o", "id"], [Running("n", "count", F.lit(1)), Running("s", "sum", F.col("id"))], share=0.01, floor=floor)
    df.createOrReplaceTempView("typed_rows")
    want = spark.sql(f"SELECT id, count(1) OVER w AS n, sum(id) OVER w AS s FROM typed_rows WINDOW w AS ({'PARTITION BY k' if keys else ''} ORDER BY o NULLS FIRST, id ROWS UNBOUNDED PRECEDING)")
    assert values(got, "id", "n", "s") == values(want, "id", "n", "s")


def test_intermediates_can_be_dropped(spark):
    from tallyloom import runtime

    kept = runtime.materialise(spark.range(3), "kept")
    assert kept.count() == 3 and runtime.drop_intermediates(spark) >= 1
    with pytest.raises(Exception, match="kept-"):
        kept.collect()


def test_chains_of_all_customers(spark):
    from tallyloom.plans import catalog

    folder = "/root/testdata/sf0.001"
    got = catalog.all_queries()["chain_paths_all"][0](spark, folder)
    customers = spark.read.parquet(f"{folder}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    ordering = spark.read.parquet(f"{folder}/orders.parquet").select(F.concat(F.lit("c"), "o_custkey").alias("id")).distinct()
    assert values(got.where("hop = 0"), "id") == values(customers, "id")
    assert values(got.where("hop = 1"), "id") == values(ordering, "id")
    # Every chain ends at the last of its ten parts.
    ends = {i: p for i, _, p in values(got.where("hop > 0 AND place LIKE '%9'"), "id", "hop", "place")}
    assert len(ends) == ordering.count()


def test_bank_rows_with_bad_and_missing_amounts(spark):
    from tallyloom.plans import catalog
    from tallyloom.plans.views import view

    folder = "/root/testdata/sf0.001"
    raw_rows = view(spark, folder, "raw_rows")
    bad = raw_rows.where("amount IS NULL OR amount = 'abc'")
    assert bad.where("amount IS NULL").count() and bad.where("amount = 'abc'").count()
    for name in ("parse_bofa_all", "parse_apple_all", "parse_wise_all"):
        got = catalog.all_queries()[name][0](spark, folder)
        assert got.count() == raw_rows.count(), name
        assert values(got.where("amount IS NULL"), "source_line") == values(bad, "source_line"), name


def test_all_category_breakdowns(spark):
    from tallyloom.plans import catalog

    got = catalog.all_queries()["category_counts_all"][0](spark, "/root/testdata/sf0.001").groupBy("dimension").agg(F.sum("rows").alias("rows"))
    rows = values(got, "dimension", "rows")
    assert [d for d, _ in rows] == ["account_category", "budget_category", "payment_method", "tax_category"]
    assert len({n for _, n in rows}) == 1


def test_extraction_is_compiled_and_read_once(spark, capsys):
    """No method passes the 8,000 bytes up to which Java compiles it, and reports of two stages read the rows once."""
    import re

    from tallyloom.operators import extraction

    rows = spark.range(4).selectExpr(
        "concat(element_at(array('CLIP HOT BOLT AUT. 12', 'intereses', 'ıNTERESES', 'Paypal *one  two AGREGADOR'), cast(id + 1 AS int)), '') AS description",
        "CAST(array() AS array<string>) AS context_lines", "CAST(NULL AS string) AS beneficiary_name", "CAST(1 AS decimal(18,2)) AS deposit", "CAST(NULL AS decimal(18,2)) AS retiro")
    made = extraction.extract(rows)
    assert [(r.type, r.clean_merchant, r.removed_noise) for r in made.collect()] == [
        ("card-purchase", "BOLT", ["AUT. 12", "HOT"]), ("interest-earned", None, []), ("unknown", "ıNTERESES", []), ("unknown", "one two", [])]
    made.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    reports = quality.stage_reports(made, [1, 3])
    assert sorted(map(tuple, reports.collect())) == sorted((*quality.stage_report(made, n).first(), n) for n in (1, 3))
    assert reports._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_links_of_all_rules_are_found_for_points_and_merged_where_the_row_is(spark):
    """As the union of all rules by row, with copies, ids of several rows, null ids and null fields; without repeated ids nothing is grouped by row and match."""
    import datetime
    import random

    r = random.Random(4)
    names = "tx_id string, date date, amount decimal(18,2), sign int, merchant string, bank string, source string, status string, description string, type string"

    def rows(ids):
        out = []
        for i in ids:
            day = None if r.random() < 0.05 else datetime.date(2024, 1, 1) + datetime.timedelta(r.randrange(3))
            out.append((i, day, r.choice([None, Decimal(1), Decimal(1), Decimal("1.01"), Decimal(3)]), r.choice([1, -1, -1, None]), r.choice(["shop a", "shop a", "shop b", None]), r.choice(["bofa", "stripe", "wise", "apple-card", None]),
                        r.choice(["x", "y", None]), r.choice(["pending", "posted"]), r.choice(["d", None]), r.choice(["expense", "transfer"])))
        return spark.createDataFrame(out, names)

    rules = [dict(x, enabled=True) for x in duplicates.load_duplicate_rules()]
    enabled = duplicates.load_duplicate_rules()
    single = [f"t{i:03}" for i in range(150)]
    several = [*single[:80], *single[:30], *[None] * 20]
    for ids, some, kw in ((single, enabled[:2] + enabled[6:10], {}), (several, rules[3:6] + rules[9:10] + rules[12:], {"share": 0.001, "floor": 2}), (several, enabled[7:11], {})):
        df = rows(ids).cache()
        union = None
        for rule in (x for x in some if x["enabled"]):
            one = duplicates.rule_links(df, rule)
            union = one if union is None else union.unionByName(one)
        best = union.groupBy("tx_id", "match_id").agg(F.max(F.struct("priority", "rule_id", "confidence", "matches")).alias("b"), F.count(F.lit(1)).alias("rules_hit"))
        want = best.select("tx_id", "match_id", "b.rule_id", "b.priority", "b.confidence", "b.matches", "rules_hit")
        found = duplicates.duplicate_links(df, some, **kw)
        assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        if ids is single:
            assert found.count() > 100 and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_without_ids(spark):
    """Points without an id are counted; a spot whose lead has none gives its source the next id, others go on to spots around."""
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(None, day, 5, "a"), ("b1", day, 5, "b"), ("c1", day, 5, "c"), ("a2", day, 8, "a"), (None, day, 60, "a"), ("d1", day, 59, "d"), (None, day, 300, "a"), (None, day, 301, "b")]
    df = spark.createDataFrame([(i, d, Decimal(c) / 100, s) for i, d, c, s in rows], "tx_id string, date date, amount decimal(18,2), source string")
    got = {(r.source, int(r.amount * 100)): (r.matches, r.best_partner, r.best_score and round(r.best_score, 3)) for r in duplicates.near_duplicates(df).collect()}
    assert got == {("a", 5): (2, "b1", 1.0), ("b", 5): (3, "a2", 0.958), ("c", 5): (3, "a2", 0.958), ("a", 8): (2, "b1", 0.958), ("a", 60): (1, "d1", 0.986), ("d", 59): (1, None, None),
                   ("a", 300): (1, None, None), ("b", 301): (1, None, None)}


@pytest.mark.parametrize("spots", [50_000, 40])
def test_best_partners_are_found_in_tiles_without_a_join(spark, monkeypatch, spots):
    """Runs of spots of one source, spots of several, borders of tiles and days below zero; ties go to the smaller id."""
    import datetime
    import random

    r = random.Random(8)
    start, rows = datetime.date(1970, 1, 1) - datetime.timedelta(9), []
    for i in range(400):
        # Most of a stretch of cents has one source.
        day, c = r.randrange(20), r.choice([-1049, -1000, 0, 950, 1900]) + r.randrange(110)
        rows.append((f"t{r.randrange(10**6):06}-{i}", start + datetime.timedelta(day), Decimal(c) / 100, "abc"[c // 40 % 3] if r.random() < 0.8 else r.choice("abcd")))
    df = spark.createDataFrame(rows, "tx_id string, date date, amount decimal(18,2), source string")
    plans, kept = {}, duplicates.materialise
    monkeypatch.setattr(duplicates, "SPOTS", spots)
    monkeypatch.setattr(duplicates, "materialise", lambda frame, label: plans.update({label: frame._jdf.queryExecution().optimizedPlan().toString()}) or kept(frame, label))
    got = {x.tx_id: (x.matches, x.best_partner, round(x.best_score, 9)) for x in duplicates.near_duplicates(df).collect()}
    want = {}
    for a in rows:
        hits = [(-round(1 - 0.15 * abs((a[1] - b[1]).days) - 0.014 * int(abs(a[2] - b[2]) * 100), 9), b[0]) for b in rows if a[3] != b[3] and abs((a[1] - b[1]).days) < 2 and abs(a[2] - b[2]) < Decimal("0.5")]
        if hits:
            want[a[0]] = (len(hits), min(hits)[1], -min(hits)[0])
    assert got == want and len(want) > 300
    assert "Join" not in plans["links"] and "Join" not in plans["points"]
