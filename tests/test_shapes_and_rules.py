"""Closed nested shapes, and rules by the index of their literals."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import shapes
from tallyloom.operators.classify import Rule, classify, load_rules
from tallyloom.operators.rule_index import classify_indexed, required_literal
from tallyloom.operators.shapes import Shape, conform, conform_json, problem_counts, record, text

SCHEMA = (
    "id string, date string, amount double, description string, type string, merchant struct<canonical_name:string,confidence:double,extracted_from:string,odd:int>, "
    "category struct<name:string,confidence:double,rule_id:string>, provenance struct<source_file:string,source_line:int,imported_at:string,imported_by:string,parser_version:string>, "
    "currency string, account_id string, notes string"
)
UUID = "123e4567-e89b-12d3-a456-426614174000"
GOOD = {
    "id": UUID, "date": "2024-11-06", "amount": 45.99, "description": "STARBUCKS #12345", "type": "expense", "merchant": ("Starbucks", 0.95, "STARBUCKS #12345", None),
    "category": ("Coffee & Tea", 0.9, "rule-15"), "provenance": ("bofa.csv", 23, "2024-11-06", "d", "1.2.0"), "currency": "USD", "account_id": UUID, "notes": "",
}


def paths(spark, changed):
    rows = [tuple({**GOOD, **c}.values()) for c in changed]
    out = conform(spark.createDataFrame(rows, SCHEMA)).select("problems", "valid").collect()
    assert all(r.valid == (not r.problems) for r in out)
    return [[p.path for p in r.problems] for r in out]


def test_each_field_invalid_once(spark):
    cases = [
        ({}, []), ({"merchant": None, "category": None, "currency": None, "account_id": None, "notes": None}, []),
        ({"id": "not-a-uuid"}, ["id"]), ({"id": UUID.upper()}, ["id"]), ({"date": "06/11/2024"}, ["date"]), ({"date": "2024-13-40"}, []), ({"amount": 0.0}, ["amount"]), ({"amount": -45.99}, ["amount"]),
        ({"description": ""}, ["description"]), ({"type": "invalid"}, ["type"]), ({"type": "credit-payment"}, []), ({"merchant": ("", 1.5, "", 3)}, ["merchant.odd", "merchant.canonical_name", "merchant.confidence", "merchant.extracted_from"]),
        ({"category": (None, None, None)}, ["category.name", "category.confidence"]), ({"provenance": None}, ["provenance"]), ({"provenance": ("", None, "bad-date", None, None)}, ["provenance.source_file", "provenance.imported_at"]),
        ({"currency": "usd"}, ["currency"]), ({"currency": "USD\n"}, ["currency"]), ({"account_id": "x"}, ["account_id"]), ({"amount": None, "description": None, "type": None, "provenance": None}, ["amount", "description", "type", "provenance"]),
    ]
    assert paths(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_types_lists_and_maps(spark):
    shape = record(
        tags=Shape("list", low=1, high=3, item=text(low=1)), seen=Shape("map", optional=True, item=Shape("number", low=0)), inner=Shape("list", optional=True, item=record(n=Shape("whole"), on=Shape("flag", optional=True))),
        free=record(optional=True, closed=False, a=text(optional=True)), name=text(optional=True), gone=Shape("number"),
    )
    schema = "tags array<string>, seen map<string,double>, inner array<struct<n:int,on:string,x:int>>, free map<string,string>, name double, extra string, problems string"
    rows = [
        (["a"], {"k": 1.0}, [(1, None, None)], {"b": "c"}, None, None, "old"),
        ([], {"b": -1.0, "a": -2.0, "c": None}, [(None, "yes", None), (2, None, 3)], None, 2.0, "here", None),
        (["", "x", None, "y"], None, None, None, None, None, None), (None, None, None, None, None, None, None),
    ]
    out = conform(spark.createDataFrame(rows, schema), shape)
    assert [[p.path for p in r.problems] for r in out.collect()] == [
        ["gone"],
        ["extra", "tags", "seen.a", "seen.b", "seen.c", "inner[0].n", "inner[0].on", "inner[1].x", "name", "gone"],
        ["tags", "tags[0]", "tags[2]", "gone"], ["tags", "gone"],
    ]
    counts = {(r.path, r.message): r.rows for r in problem_counts(out).collect()}
    assert counts["gone", "is missing"] == 4 and counts["inner[].n", "is missing"] == 1 and counts["tags", "is out of bounds"] == 2
    assert conform(spark.createDataFrame([], "a int"), record()).count() == 0


def test_json_with_unknown_keys(spark):
    rows = [('{"a": "x", "n": {"b": 1}}',), ('{"a": "", "zz": 1, "n": null, "aa": 2}',), ("[1]",), ("{broken",), (None,)]
    shape = record(a=text(low=1), n=record(b=Shape("whole")))
    out = conform_json(spark.createDataFrame(rows, "j string"), "j", "a string, n struct<b:int>", shape)
    assert [[(p.path, p.message) for p in r.problems] for r in out.collect()] == [
        [], [("aa", "is not allowed"), ("zz", "is not allowed"), ("a", "is out of bounds"), ("n", "is missing")], [("", "is no record")], [("", "is no record")], [("", "is no record")],
    ]


def test_unknown_kinds_of_map_records(spark):
    df = spark.createDataFrame([({"canonical_name": "x", "confidence": "y", "more": "z"},)], "merchant map<string,string>")
    out = conform(df, record(merchant=shapes.TRANSACTION.fields["merchant"])).first()
    assert [p.path for p in out.problems] == ["merchant.more", "merchant.confidence"]


@pytest.mark.parametrize("pattern, literal", [
    (r"STARBUCKS.*", "STARBUCKS"), (r".*(UBER|LYFT).*", None), (r"A(BCD)+E?.*XY", "BCD"), (r"X{0,3}YZ", "YZ"), (r"[AB]C", "C"), (r"(?i)abc", None), (r"\QA.B\E", None), (r".*", None), (r"REF\. 10\d*", "REF. 10"),
    (r"(?:FOO BAR)\s+\d+", "FOO BAR"), (r"*broken", None), (r"\p{Lu}X", None),
])
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_index_equals_compiled_rules(spark):
    r = random.Random(2)
    words = ["UBER", "STARBUCKS", "PAYROLL", "RENT", "O'NEIL", "CAFÉ", "X+Y", "A1"]
    rules = load_rules()
    for i in range(160):
        a, b = r.choice(words), r.choice(words)
        pattern, is_regex = r.choice([(f"{a} {b}", False), (a.lower(), False), (f".*{a.replace('+', '[+]')}.*", True), (f"{a.replace('+', '.')} ?(?:{b.replace('+', '.')}|RENT)+", True), (f"[A-Z]+ {b.replace('+', '.')}", True), (r".*\d", True), (f"(?i){a.lower().replace('+', '.')}", True)])
        rules.append(Rule(f"r{i}", pattern, is_regex, r.choice([None, f"m{i}"]), r.choice([None, "c"]), r.choice([None, "income"]), r.choice([None, 0.5]), r.randrange(4)))
    rows = [(i, r.choice([None, "", " ".join(r.choices(words + ["zz", "7"], k=r.randint(1, 3)))]), r.choice([None, "uber", " ".join(r.choices(words, k=2))]), r.choice(["expense", None]), "old") for i in range(300)]
    df = spark.createDataFrame(rows, "tx_id long, description string, merchant string, type string, category_id string")
    for by_priority in (True, False):
        want = classify(df, rules, by_priority)
        got = classify_indexed(df, rules, by_priority).select(want.columns)
        assert results(got) == results(want)
    assert results(classify_indexed(df, []).select(classify(df, []).columns)) == results(classify(df, []))


def test_twenty_thousand_rules(spark):
    rules = [Rule(f"r{i}", rf"SHOP {i:05d} .*", True, f"m{i}", "c", None, 0.9, i % 3) for i in range(19_000)] + [Rule(f"p{i}", f"plain {i}", False, None, "d") for i in range(1_000)]
    df = spark.range(5000).select(F.col("id").alias("tx_id"), F.when(F.col("id") % 3 == 0, F.format_string("Shop %05d here", F.col("id") * 4)).when(F.col("id") % 3 == 1, F.concat(F.lit("PLAIN "), F.col("id").cast("string"))).alias("description"), F.lit(None).cast("string").alias("merchant"))
    got = classify_indexed(df, rules)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for row in got.collect():
        i = row.tx_id
        want = f"r{i * 4}" if i % 3 == 0 and i * 4 < 19_000 else f"p{i}" if i % 3 == 1 and i < 1000 else None
        assert row.rule_id == want and row.category_id == ("uncategorized" if want is None else "c" if want[0] == "r" else "d")


def test_run_breakdowns(spark):
    from tallyloom.operators.summaries import run_breakdowns

    df = spark.createDataFrame([("a", 1.0, "x", None), ("b", 2.0, "x", 7), ("c", None, "y", 7)], "tx_id string, amount double, kind string, n int")
    got = {(r.dimension, r.value): (r.rows, r.amount, r.first_id, r.last_id, round(r["share"], 3)) for r in run_breakdowns(df, {"kind": "kind", "number": "n"}).collect()}
    assert got == {("kind", "x"): (2, 3.0, "a", "b", 0.667), ("kind", "y"): (1, None, "c", "c", 0.333), ("number", None): (1, 1.0, "a", "a", 0.333), ("number", "7"): (2, 2.0, "b", "c", 0.667)}
    assert run_breakdowns(df.limit(0), {"kind": "kind"}).count() == 0


def test_an_id_in_upper_case_is_wrong_though_its_digest_has_no_letter(spark, tmp_path):
    import datetime as dt

    from tallyloom.plans.catalog_state import Q

    # The first 32 hex digits of this row's digest are 0 to 9.
    row = (636006, 3, 1, 7, 1.0, 10.0, 0.0, 0.01, "N", "O", dt.datetime(1996, 9, 13))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([row], names).write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: [tuple(r) for r in Q[name][0](spark, str(tmp_path)).drop("key").collect()]
    assert run("closed_shape") == [("id", False)]
    assert run("closed_shape_counts") == [("id", "Must be a valid UUID", 1)]
    assert run("split_valid") == [("quarantine",)]


def test_only_the_first_rule_of_a_regex_is_a_candidate(spark, monkeypatch):
    from tallyloom.operators import rule_index

    rules = [Rule(f"r{i}", rf"SHOP {i % 3}\d*", True, None, None, None, 0.5, 1) for i in range(60)]
    held = []
    kept = rule_index._candidates
    monkeypatch.setattr(rule_index, "_candidates", lambda texts, literals: held.append(literals) or kept(texts, literals))
    monkeypatch.setattr(rule_index, "BATCH", 2)
    texts = spark.createDataFrame([("SHOP 0",), ("SHOP 12",), ("SHOP 2",), ("SHOP 9",)], "text string")
    assert {r.text: r["rank"] for r in rule_index.best_ranks(texts, rules).collect()} == {"SHOP 0": 0, "SHOP 12": 1, "SHOP 2": 2}
    assert sorted(i for some in held[0].values() for i in some) == [0, 1, 2]
    # Regexes without a literal are tried in their order as well.
    loose = [Rule(f"l{i}", p, True, None, None, None, 0.5, 1) for i, p in enumerate([r"[A-Z]+ \d", r"[A-Z]+ \d+", r"[A-Z]+ \d"])]
    assert {r.text: r["rank"] for r in rule_index.best_ranks(texts, loose).collect()} == {"SHOP 0": 0, "SHOP 12": 1, "SHOP 2": 0, "SHOP 9": 0}


def test_a_filter_on_the_confidence_runs_no_rule_again(spark):
    from tallyloom.operators.classify import Rule, classify_batch

    rows = spark.range(3).selectExpr("concat('SHOP ', id) AS description", "concat('X', id) AS merchant", "'expense' AS type")
    rules = [Rule("one", "SHOP [1]", True, confidence=0.95), Rule("two", "SHOP .", True, confidence=0.5)]
    kept = classify_batch(rows, rules, min_confidence="high")
    assert [(r.description, r.rule_id) for r in kept.collect()] == [("SHOP 1", "one")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("SHOP [1]") == 2


@pytest.mark.parametrize("pattern, tail", [(r"SHOP .* REF\. 1\d*07", "07"), (r"A(BC)", ""), (r"AB|CB", ""), (r"AB+", ""), (r"REF\. 10", "REF. 10"), (r"ABC$", ""), (r"X (A|B) Y", " Y")])
def test_last_literals(pattern, tail):
    from tallyloom.operators.rule_index import last_literal

    assert last_literal(pattern) == tail


def test_more_rules_than_the_driver_holds(spark, monkeypatch):
    """A list over the bound, and a table with repeated places and null patterns, give what compiled rules give."""
    from tallyloom.operators import rule_index
    from tallyloom.operators.classify import RULE_SCHEMA

    monkeypatch.setattr(rule_index, "MOST_RULES", 60)
    r = random.Random(6)
    words = ["UBER", "STARBUCKS", "PAYROLL", "RENT", "CAFÉ", "SHOP"]
    rules = [Rule(f"s{i}", rf"SHOP {r.choice(words)} REF\. 1\d*{i % 10}{r.choice(['', '7'])}", True, f"m{i}", "c", None, 0.9, i % 5) for i in range(150)]
    rules += [Rule(f"p{i}", f"{r.choice(words).lower()} {i % 9}", False, None, "d", "income", None, i % 4) for i in range(40)] + [Rule("digit", r".*\d", True, "end", priority=-1), Rule("flag", "(?i)rent.*", True, "flag", priority=1), Rule("any", "[A-Z]+ .*", True, None, None, None, 0.2, -5)]
    text = lambda: r.choice([None, "", f"shop {r.choice(words)} ref. 1{r.randrange(1000)}", f"{r.choice(words)} {r.randrange(12)}", "zz"])
    df = spark.createDataFrame([(i, text(), text(), "expense", "old") for i in range(400)], "tx_id long, description string, merchant string, type string, category_id string")
    for by_priority in (True, False):
        want = classify(df, rules, by_priority)
        assert results(classify_indexed(df, rules, by_priority, limit=40, per_task=20).select(want.columns)) == results(want)
    each = [(7, x.id, x.pattern, x.is_regex, x.merchant, x.category, x.type, x.confidence, 1) for x in (Rule("a", r"SHOP UBER.*", True), Rule("b", r"RENT 1", False), Rule("c", None, True))]
    table = spark.createDataFrame([*each, *each], f"place long, {RULE_SCHEMA}")
    want = classify(df, [Rule("a", r"SHOP UBER.*", True), Rule("b", r"RENT 1", False)])
    got = classify_indexed(df, table).select(want.columns)
    assert got.count() == 400 and got.where("rule_id IS NOT NULL").count() == want.where("rule_id IS NOT NULL").count() > 0


def test_a_split_runs_checks_once_and_not_in_its_filters(spark):
    from tallyloom.operators import quality
    from tallyloom.operators.shapes import Shape, conform, record, text

    rows = spark.range(6).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"), F.lit(1).alias("a.b"))
    checked = conform(rows, record(id=text(pattern="[0-5].*"), n=Shape("whole", low=1)), ignore=("a.b",))
    good, bad = quality.split_valid(checked)
    assert good.columns == checked.columns
    want = {r.n: not r.problems for r in checked.collect()}
    assert {r.n for r in good.collect()} == {n for n, ok in want.items() if ok} and {r.n for r in bad.collect()} == {n for n, ok in want.items() if not ok}
    assert 0 < good.count() < 6 and good.count() + bad.count() == 6
    for side in (good, bad):
        plan = side.select("n")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("sha2" in line for line in plan.splitlines() if "Filter" in line)
