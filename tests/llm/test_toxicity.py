"""Op 12: the index finds what comparing with every example finds, and held-out texts are told apart."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.toxicity import BlockMaxIndex, Sparse, counted, fit, logistic, term_hashes, toxicity, weighted


def sparse(rows):
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    return Sparse(first, np.asarray([t for r in rows for t in r], np.int64), np.asarray([w for r in rows for w in r.values()], float))


def test_index_equals_comparing_with_all():
    r = np.random.default_rng(3)

    def some(n, terms):
        return [{int(t): 1.0 for t in sorted(r.choice(terms, r.integers(0, 6), replace=False))} for _ in range(n)]

    for width, k in ((4, 3), (64, 7), (16, 40)):
        examples, queries = some(150, 30), some(60, 30)
        idf = r.uniform(1, 5, 30)
        unit = lambda rows: weighted(*(lambda s: (s.first, s.term, s.weight))(sparse(rows)), idf)
        e, q = unit(examples), unit(queries)
        ids = r.permutation(1000)[:150]
        own = np.where(np.arange(60) % 2 == 0, ids[:60], -1)
        score, place, seen = (index := BlockMaxIndex(e, ids, 30, width)).top(q, own, k)
        dense = lambda s: np.asarray([[dict(zip(s.term[a:b], s.weight[a:b])).get(t, 0.0) for t in range(30)] for a, b in zip(s.first, s.first[1:])])
        product = np.round(dense(q) @ dense(e).T, 9)
        for i in range(60):
            want = sorted((-product[i, j], ids[j]) for j in range(150) if product[i, j] > 0 and ids[j] != own[i])[:k]
            got = [(-round(s, 9), index.ids[p]) for s, p in zip(score[i], place[i]) if p >= 0]
            # Ties that differ by rounding only may swap, so scores and members above the last score are compared.
            assert [a for a, _ in got] == pytest.approx([a for a, _ in want], abs=1e-8)
            edge = want[-1][0] + 1e-7 if want else 0
            assert {b for a, b in got if a < edge - 2e-7} == {b for a, b in want if a < edge - 2e-7}
        assert seen <= 60 * index.blocks


def test_blocks_are_skipped():
    examples = [{i % 8: 1.0, 8 + i % 5: 0.2} for i in range(640)]
    e = weighted(*(lambda s: (s.first, s.term, s.weight))(sparse(examples)), np.ones(13) + np.arange(13) / 10)
    index = BlockMaxIndex(e, np.arange(640), 13, 16)
    _, _, seen = index.top(e.take(np.arange(100)), np.full(100, -1), 5)
    assert seen < 100 * index.blocks / 3


def test_terms_are_words_and_beginnings():
    hashes, rows, n = term_hashes(pa.array(["Losers, LOSER!", None, "", "été étéés x1y", "loser"]))
    of = [set(hashes[rows == i].tolist()) for i in range(n)]
    # losers, loser, lose-, loser-: "loser" as a beginning is a term of its own.
    assert n == 5 and len(of[0]) == 4 and not of[1] and not of[2]
    assert of[4] < of[0] and len(of[4]) == 2 and len(of[3]) == 5
    r, t, c = counted(np.asarray([1, 0, 1, 1]), np.asarray([5, 5, 5, 2]))
    assert (r.tolist(), t.tolist(), c.tolist()) == ([0, 1, 1], [5, 2, 5], [1, 1, 2])


def test_logistic_separates():
    slope, shift = logistic(np.asarray([0.0, 0.1, 0.9, 1.0] * 20), np.asarray([0, 0, 1, 1] * 20), np.ones(80))
    p = 1 / (1 + np.exp(-(slope * np.asarray([0, 0.5, 1]) + shift)))
    assert p[0] < 0.1 < p[1] < 0.9 < p[2]


BAD = {"en": "grobble snarfing", "xx": "plonkier plonkest plonkando"}


def corpus(n=900):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "xx"])
        words = ["".join(r.choice(["ba", "du", "ki", "lo", "ne"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            words[2:2] = [r.choice(BAD[lang].split()) for _ in range(2)]
        docs.append((i, " ".join(words), lang))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out_texts_are_told_apart(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("label", F.lit("clash")).withColumn("score", F.lit(9)).withColumn("terms", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit(1))
    rows = {r.doc_id: r for r in toxicity(frame, known).collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    wrong = [i for i, r in rows.items() if r.predicted != (i % 6 == 0)]
    assert len(wrong) <= 3, wrong
    learned = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    for i, r in rows.items():
        assert len(r.evidence) <= 15 and all(e.id in learned and e.id != i for e in r.evidence)
        assert [e.similarity for e in r.evidence] == sorted((e.similarity for e in r.evidence), reverse=True)
    # Held-out labels teach nothing: turning them over changes no score.
    turned = spark.createDataFrame([(i, y if i in learned else 1 - y) for i, y in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity(frame, turned).collect()} == {i: r.score for i, r in rows.items()}


def test_odd_rows(spark):
    docs, labels = corpus(300)
    odd = [(None, "grobble snarfing", "en"), (7000, None, "en"), (7001, "", None), (7002, "ba " * 20000 + "snarfing grobble", "en"), (0, docs[0][1], "en"), (7003, "12 !! 34", "en")]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")
    more = labels + [(None, 1), (7002, None), (7001, 5), (2, 0), (4, 1), (4, 0)]
    got = toxicity(frame, spark.createDataFrame(more, "doc_id long, toxic int"), examples=80).collect()
    assert len(got) == len(docs) + len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[0]) == 2 and by[0][0].score == by[0][1].score
    assert by[None][0].predicted == 1 and not by[None][0].held_out and by[7002][0].predicted == 1
    assert by[7000][0].score == by[7001][0].score == by[7003][0].score < 0.5 and by[7000][0].evidence == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(frame, none).collect()} == {0.0}
    assert toxicity(frame.limit(0), none).count() == 0
    assert {r.score for r in toxicity(frame, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")).collect()} == {1.0}


def test_copies_of_an_example_do_not_vote_for_themselves():
    rows = [(i, int(i < 5), [0] if i < 5 else [1], [1]) for i in range(10)]
    model = fit(rows, np.ones(2), np.asarray([5.0, 5.0]), 4)
    share, _, place = model.votes(weighted(np.asarray([0, 1]), np.asarray([0]), np.asarray([1]), np.ones(2)), np.asarray([3]))
    assert 0 < share[0] < 1 and share[0] > model.votes(weighted(np.asarray([0, 1]), np.asarray([1]), np.asarray([1]), np.ones(2)), np.asarray([8]))[0][0] == 0 and set(model.index.ids[place[0]]) == {0, 1, 2, 4}


def test_document_frequencies_are_added_up_in_tasks(spark):
    from tallyloom.llm.toxicity import document_frequencies

    rows = [(i, [t for t in range(5) if i % (t + 1) == 0]) for i in range(60)] + [(99, []), (100, None)]
    vector = spark.createDataFrame(rows, "doc_id long, terms array<int>").repartition(3)
    assert document_frequencies(vector, 6) == {0: 60, 1: 30, 2: 20, 3: 15, 4: 12}
    assert document_frequencies(vector.limit(0), 0) == {}
