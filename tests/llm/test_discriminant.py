"""Op 6: the fit equals numpy's, and held-out documents are told apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.discriminant import NAMES, described, discriminant, fit, quality, scored, statistics

CLEAN = "The river runs past the old mill, and the road follows it. Nobody knows how long the stones have been there"


def test_statistics_of_known_texts():
    texts = [None, "", " \n", "a a a a", "LOUD!! WORDS!!\nLOUD!! WORDS!!", "x### y###", CLEAN * 300]
    x = statistics(pa.array(texts))
    assert x.shape == (len(texts), len(NAMES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all() and (x[1] == x[2]).all()
    by = dict(zip(NAMES, x.T))
    assert by["same_as_before"][3] == pytest.approx(np.sqrt(3 / 24)) and by["shouts"][4] > by["shouts"][3] == 0
    assert by["same_lines"][4] == pytest.approx(np.sqrt(1 / 5)) and by["capital_words"][4] == pytest.approx(np.sqrt(4 / 24)) and by["symbol_words"][5] == pytest.approx(np.sqrt(2 / 22))
    assert (statistics(pa.chunked_array([texts[:3], texts[3:]])) == x).all()


def test_fit_equals_numpy(spark):
    r = np.random.default_rng(0)
    d = len(NAMES)
    x = np.concatenate([r.normal(size=(60, d)) * 2, r.normal(size=(90, d)) + 1])
    y = [0] * 60 + [1] * 90
    rows = spark.createDataFrame([(float(i), [float(z) for z in v], k) for i, (v, k) in enumerate(zip(x, y))] + [(200.0, [0.0] * d, None), (201.0, [9.0] * d, 7)], "id double, x array<double>, label int").repartition(4)
    model = fit(rows, shrink=0.1)
    means = np.stack([x[:60].mean(0), x[60:].mean(0)])
    spread = [np.cov(x[:60].T, bias=True), np.cov(x[60:].T, bias=True)]
    pooled = np.diag(np.diag((60 * spread[0] + 90 * spread[1]) / 150))
    log = []
    for k, n in ((0, 60), (1, 90)):
        c = 0.9 * spread[k] + 0.1 * pooled
        z = x - means[k]
        log.append(np.log(n / 150) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z))
    want = 1 / (1 + np.exp(log[0] - log[1]))
    assert np.allclose(model.score(x), want)
    got = {q.id: q.score for q in scored(rows, model).collect()}
    assert np.allclose([got[float(i)] for i in range(150)], want)
    assert discriminant(np.array([0.0, 3.0]), np.zeros((2, d)), np.zeros((2, d, d))) is None


def test_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    out = quality(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL")
    right = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("r"), F.count("*").alias("n")).first()
    assert right.n > 40 and right.r >= 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, CLEAN), (1, CLEAN), (2, None), (None, ""), (4, "### " * 30_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(1, None), (4, 0), (2, 1), (None, 1), (77, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = quality(docs, some).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert {r.doc_id: r.held_out for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, None, 4)}
    assert quality(docs.limit(0), labels).collect() == []
    assert described(docs.limit(0)).collect() == []
