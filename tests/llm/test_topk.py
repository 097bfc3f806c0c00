"""Op 5 against all products."""

import numpy as np
import pytest

from tallyloom.llm.topk import top_products


def brute(rows, every, k):
    good = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-int(q @ v), j) for j, v in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_equals_all_products(spark, block_rows):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in (r.normal(size=6) * r.choice([0.1, 1, 3])).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, [0.0] * 6), (2001, [0.0] * 6), (2010, [float("nan")] * 6), (2020, None), (2030, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2040, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (2050, [0.5, -1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted(tuple(x) for x in top_products(df, every=10, block_rows=block_rows, first=2).collect())
    assert got == brute(rows, 10, 10)


def test_few_rows_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (100, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_products(df).collect())
    n = 1024 * 1024
    assert got == [(0, 1, 5, n), (0, 2, 5, n), (0, 3, 100, -2 * n), (100, 1, 5, 0), (100, 2, 5, 0), (100, 3, 0, -2 * n)]
    assert top_products(df.limit(0)).collect() == []


def test_scores_are_exact_either_way(monkeypatch):
    from tallyloom.llm import topk

    r = np.random.default_rng(5)
    monkeypatch.setattr(topk, "GATHERED", 40)
    for size in (1 << 10, 1 << 28):
        a, b = (np.floor(r.normal(size=(n, 6)) * size) for n in (30, 50))
        exact = np.abs(a).max() * np.abs(b).max() * 6 < 2**53
        assert exact == (size == 1 << 10)
        for share in (0.9, 0.05):
            q, v = np.nonzero(r.random((30, 50)) < share)
            want = [sum(int(x) * int(y) for x, y in zip(a[i], b[j])) for i, j in zip(q, v)]
            assert topk._scores(a, b, q, v, exact).tolist() == want
    assert topk._scores(a, b, q[:0], v[:0], False).tolist() == []
