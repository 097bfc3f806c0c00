"""Ops 7 and 8 on edge cases; their queries are compared with SQL by tools/check.py."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, quality_rules
from tallyloom.llm.quality_rules import RULES, Rule, accepted, facts_and_verdict, in_order, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    places = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), failed)


GOOD = " ".join(f"Clean{i} wörd{i}," for i in range(40))
TEXTS = [None, "", " \n\t", "a b c", "a a a a", "a b c a b c", GOOD, GOOD.upper(), GOOD.replace(",", "!!"), GOOD.replace(",", " | "), "\n".join(["x y z"] * 60), GOOD + " x y", "1 " * 70, "😀 " * 55 + GOOD, "a b\x0bc\x0cd\re"]


def test_facts_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in facts_and_verdict(df).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == facts(t), t
    assert {i for i in got if got[i].kept} == {6, 11, 13}


def test_order_of_rules_never_changes_the_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = {r.doc_id for r in accepted(df).collect()}
    ready = quality_rules.prepared(df, "text")
    for rules in (RULES, RULES[::-1]):
        assert {r.doc_id for r in ready.where(quality_rules.cascade(list(rules), "text").isNull()).collect()} == want
    assert all((r.rejected_by is None) == (r.doc_id in want) for r in judge(df).collect())
    assert accepted(df.limit(0)).collect() == []
    a, b, c = (Rule(n, None) for n in "abc")
    assert [r.name for r in in_order([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 1.0, 0.0)])] == ["b", "a", "c"]


def test_quality_rules_run_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = facts_and_verdict(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abc"[min(2, i % 7)], i) for i in range(900)]
    rows += [(5000, None, "a", 0), (5001, "x y", None, 0), (5001, "x y", None, 0), (None, "n m o", "b", 0), (5002, "w " * 400, "tiny", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, position long")


@pytest.mark.parametrize("bucket_rows", [2000, 20])
def test_targets_are_met(spark, bucket_rows):
    out = mixing.mixed(docs(spark), bucket_rows=bucket_rows).collect()
    assert len(out) == 905
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r["__copies"] <= 2 and len(r["__positions"]) == r["__copies"]
        assert all(0 <= p <= 1 for p in r["__positions"])
        size[r.source] += r["__size"]
        taken[r.source] += r["__size"] * r["__copies"]
        target[r.source] = r["__target"]
        assert r["__source_size"] >= r["__size"]
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= (400 if s == "tiny" else 24) / 2 + 1e-6
    free = {s: target[s] / w for s, w in zip(["a", "b", "c", "tiny", None], [3, 1, 2, 3, 1]) if target[s] < 2 * size[s] - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6 * max(free.values())
    again = mixing.mixed(docs(spark).repartition(7), bucket_rows=bucket_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_schedule_and_curriculum(spark):
    df = docs(spark)
    mix = mixing.mixed(df).select("source", F.explode("__positions").alias("p"), F.col("__size").alias("n"))
    early = {r.source: r.share for r in mix.groupBy("source").agg((F.sum(F.when(F.col("p") < 0.5, F.col("n"))) / F.sum("n")).alias("share")).collect()}
    assert early["a"] == pytest.approx(0.625, abs=0.02) and early["b"] == pytest.approx(0.5, abs=0.02) and early["c"] == pytest.approx(0.375, abs=0.02)
    rows = mixing.curriculum(df.drop("position")).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert mixing.mixed(df.limit(0)).collect() == []


def test_mixing_leaves_other_columns_alone(spark):
    df = docs(spark)
    for clash in ("_before", "__bucket", "__key", "__order", "__rank", "_n", "__row", "__size", "size", "rank", "target"):
        df = df.withColumn(clash, F.lit(f"own {clash}"))
    out = mixing.mixed(df)
    assert out.columns == [c for c in df.columns if c != "__size"] + list(mixing.RESULTS)
    plain = sorted(map(str, mixing.mixed(docs(spark)).collect()))
    assert sorted(map(str, out.select(*docs(spark).columns, *mixing.RESULTS).collect())) == plain
    assert {r["__bucket"] for r in out.collect()} == {"own __bucket"}


def test_a_text_travels_once(spark):
    plan = mixing.mixed(docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "__text" in plan and ".text AS" not in plan


def test_query_is_in_training_order(spark, tmp_path):
    from tallyloom.llm.queries import op8_mixing

    docs(spark).drop("position").write.parquet(str(tmp_path / "documents.parquet"))
    out = op8_mixing(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "SQRT" in plan.upper()
    got = out.collect()
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    assert all((r.position is None) == (r.taken == 0 and r.size > 0) for r in got if r.size)
