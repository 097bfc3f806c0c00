"""Op 11: runs equal those of trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import periodic
from tallyloom.llm.periodic import find_runs, periodic_runs, run_facts


def plain(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, times * q):
                found.setdefault((start, size), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 6)):
            words, kinds = [], r.choice([1, 2, 3, 6])
            for _ in range(r.randint(0, 7)):
                words += [r.randrange(kinds) for _ in range(r.randint(1, 9))] * r.randint(1, 9)
            texts.append(words)
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        least, times = r.choice([(24, 3), (6, 3), (2, 2), (9, 2)])
        got = find_runs(np.asarray([w for t in texts for w in t], np.int64), first, least, times)
        want = [(int(first[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in plain(t, least, times)]
        assert list(zip(*(x.tolist() for x in got))) == want


def test_few_suffixes_are_looked_at_together(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 7)
    words = [1, 2, 3] * 20 + [4] * 30
    got = find_runs(np.asarray(words, np.int64), np.asarray([0, len(words)]))
    assert list(zip(*(x.tolist() for x in got))) == plain(words)


def test_very_long_periodic_text():
    words = np.tile(np.arange(1000), 120)
    start, length, period = find_runs(words, np.asarray([0, len(words)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [120_000], [1000])
    start, length, period = find_runs(np.zeros(50_000, np.int64), np.asarray([0, 50_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [50_000], [1])


def test_odd_rows_and_clashing_names(spark):
    loop = "x y z\n" * 10
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "one two", "d"), (5, loop, "e"), (5, loop, "e"), (None, "w " * 24, "g"), (7, "ä ü " * 12 + "end", None), (8, "w " * 23, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("a", F.lit(1)).withColumn("words", F.lit(2))
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "a", "words", "runs", "best", "collapsed"]
    got = sorted(((r.doc_id or 0), [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in out.collect())
    five = (5, [(0, 30, 3)], (0, 30, 3), "x y z")
    assert got == [(0, [(0, 24, 1)], (0, 24, 1), "w"), (1, [], None, ""), (2, [], None, ""), (3, [], None, ""), (4, [], None, "one two"), five, five, (7, [(0, 24, 2)], (0, 24, 2), "ä ü end"), (8, [], None, " ".join("w" * 23))]
    assert periodic_runs(docs.limit(0)).count() == 0
    # The text itself may be called like a result.
    assert periodic_runs(spark.createDataFrame([("v " * 30,)], "runs string"), "runs").first().collapsed == "v"


def test_best_run_by_exact_ratio():
    run = "a b c d e f g h i j " * 3 + "z " + "p q r s t u v w x y " * 3 + "z " + "m " * 24
    piece = pa.table({"text": [run]})
    runs, best, _ = periodic._described(piece, "text", 24, 3)
    assert [tuple(r.values()) for r in runs[0]] == [(0, 30, 10), (31, 30, 10), (62, 24, 1)]
    assert tuple(best[0].values()) == (62, 24, 1)
    runs, best, _ = periodic._described(pa.table({"text": [run[:-48]]}), "text", 24, 3)
    assert tuple(best[0].values()) == (0, 30, 10)


def test_query_equals_plain_python(spark):
    r = random.Random(9)
    texts = {}
    for i in [*range(300), 12345678901, -7]:
        words = [r.choice("ab cd ef gh ij kl".split()) for _ in range(r.randint(0, 90))]
        texts[i] = r.choice([" ", "\n", "\t "]).join(words) if r.random() < 0.95 else None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {row[0]: tuple(row)[1:] for row in run_facts(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in texts.items():
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        runs = plain(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        lost = {k for s, size, q in runs for k in range(s + q, s + size)}
        kept = " ".join(w for k, w in enumerate(words) if k not in lost)
        assert got[i] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept)), i
    assert sum(v[0] > 0 for v in got.values()) > 5
