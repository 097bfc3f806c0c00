"""Op 2 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tallyloom.llm.components import components
from tallyloom.llm.near_dedup import _large, near_duplicates, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)] + ["É", "ß", "Straße"]
    rows = []
    for base in range(14):
        words = [r.choice(vocabulary) for _ in range(r.randrange(6, 90))]
        for _ in range(r.choice([1, 1, 2, 6, 25])):
            copy = list(words)
            for _ in range(r.randrange(0, max(2, len(words) // 30))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary) + "x"
            if r.random() < 0.5:
                words = copy
            rows.append(r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in copy))
    rows += ["one two", "ONE  two", "one two three", "", None, " \n", "É x y z", "é x y z"]
    r.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("limit", [4_000_000, 300])
def test_groups_equal_brute_force(spark, limit):
    rows = corpus(limit)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near_duplicates(df, limit=limit).collect()) == brute(rows)


def test_large_clusters_never_meet_in_one_task(spark):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(60)]
    sets += [np.sort(np.append(s[:48], np.uint64(k))) for k, s in enumerate(sets[:9])]
    rows = [(i, 1 + i % 3 // 2, s.tobytes(), sum(len(x) for j, x in enumerate(sets) if j % 3 // 2 == i % 3 // 2)) for i, s in enumerate(sets)]
    links = _large(spark.createDataFrame(rows, "doc long, cluster long, members binary, total long").repartition(3), 80, 200)
    plan = links._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortMergeJoin [cluster" not in plan
    assert {tuple(sorted(x)) for x in links.collect()} == {(i, 60 + i) for i in range(9)}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (2, "A B c d  e"), (9, None), (7, "x y z w v"), (7, "a b c d e"), (8, "X y z w v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS label")
    out = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert out == [(-1, None, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 2, False), (7, 2, False), (8, 2, False), (9, 9, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.sort(values[:900]), np.sort(values[100:])
    got = superminhash(np.concatenate([a, b, a[:1]]), np.array([0, 900, 1800, 1801, 1801]), 96)
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.12
    assert len(set(got[2] >> np.uint64(56))) == 96 and (got[3] == np.uint64(2**64 - 1)).all()
    again = superminhash(a, np.array([0, 900]), 96)
    assert (again[0] == got[0]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = words[:]
    near[1000] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "x" * 300_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_patterns_that_cancel_in_a_polynomial_hash(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64; they are different words."""
    word = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    rows = [(1, word(1024, "a", "b")), (2, word(1024, "b", "a")), (3, word(2048, "a", "b")), (4, word(2048, "b", "a")), (5, "x y z " + word(1024, "a", "b")), (6, "x y z " + word(1024, "b", "a")), (7, word(1024, "A", "b"))]
    out = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == brute(rows) and [r[3] for r in out] == [True] * 6 + [False]


@pytest.mark.parametrize("sent", [1_000_000, 1])
def test_only_texts_that_are_compared_are_shuffled(spark, monkeypatch, sent):
    from pyspark.sql import functions as F

    from tallyloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SENT", sent)
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base + " end", "other " + base] + [" ".join(f"x{i}-{j}" for j in range(50)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = docs.where("doc_id < 3").select(F.col("doc_id").alias("doc"), F.lit(0).alias("cluster"), F.lit(b"").alias("digest"))
    found = near_dedup._texts(docs, wanted, "text", "doc_id")
    assert found.count() == 3 and ("LeftSemi" in found._jdf.queryExecution().executedPlan().toString()) == (sent > 1)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {i: 0 if i < 3 else i for i in range(23)}
