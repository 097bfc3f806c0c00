"""The pipeline against a plain version of its stages, and its stages on odd tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.mixing import CYCLE

pieces = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAN = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = ["river", "stone", "mill", "für", "road", "a", "the", "follows", "été", "known,", "long."]
    word = lambda: r.choice(vocabulary) + (str(r.randrange(50)) if r.random() < 0.6 else "")
    passage = [word() + "p" for _ in range(60)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(r.randrange(20, 160))]
        if i % 5 == 0:
            at = r.randrange(len(words))
            words[at:at] = passage
        if i % 11 == 3:
            words = [w + "###" for w in words]
        if i % 13 == 4:
            words = (words[:4] * 40)[:120]
        text = "".join(w + ("\n" if r.random() < 0.05 else " ") for w in words)
        rows.append([i * 3, text, "en", r.choice(["a", "b", "c", None]), len(text), i])
        if i % 6 == 0:
            copy = words[:]
            copy[r.randrange(len(copy))] = "changed"
            rows.append([i * 3 + 1, " ".join(copy) if i % 12 else text, "en", "b", 0, i])
    rows += [[900, None, None, None, None, 0], [901, "", "en", "a", 0, 0]]
    return rows


def clean(text):
    words = WORD.findall(text or "")
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = collections.Counter(grams)
    again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    if n < 50 or 100 * len(again) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    return not (10 * sum(c in "#*$%&|<>" for c in text) > n or 10 * text.count("!") > n or 2 * (len(lines) - len(set(lines))) > len(lines)
                or chars < 2 * n or chars > 20 * n or 10 * capitals > 3 * letters or 2 * letters < chars)


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    rows = [r for r in rows if clean(r[1])]
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {i: i for i in sets}

    def find(i):
        return i if label[i] == i else find(label[i])

    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    rows = [list(r) for r in rows if find(r[0]) == r[0]]
    first = {}
    for r in rows:
        words = WORD.findall(r[1])
        for i in range(len(words) - 12):
            g = tuple(words[i : i + 13])
            first[g] = min(first.get(g, r[0]), r[0])
    for r in rows:
        words, spans = WORD.findall(r[1]), SPAN.findall(r[1])
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < r[0]:
                gone[i : i + 13] = [True] * 13
        if any(gone):
            r[1] = "".join(s for s, g in zip(spans, gone) if not g)
            r[4] = len(r[1])
    size = lambda r: len(WORD.findall(r[1]))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: CYCLE[i % 3] for i, s in enumerate(sources)}
    target, rest, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        rest -= sum(2.0 * total[s] for s in over)
        open_ -= set(over)
    for s in open_:
        target[s] = rest * weight[s] / sum(weight[x] for x in open_)
    out = collections.Counter()
    for s in sources:
        at = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"11-{r[0]}".encode()).hexdigest()):
            whole = int(target[s] / total[s] + 1e-12)
            part = target[s] - whole * total[s]
            copies = whole + (part > 0 and at + size(r) / 2 <= part)
            at += size(r)
            out[tuple(r)] += copies
    return +out


def test_run_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain([r[:5] for r in rows])
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.path("piece_bpe_32k.model"))
    assert all(r.decoded == r.text and r.ids == library.encode(r.text) and r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(1, text, None, 1), (1, text, None, 1), (None, text + " more", "a", 2), (3, None, "a", 3), (4, "", None, None), (5, " ".join(f"other{i}" for i in range(70)) + " tail" * 3, "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position long")
    # Names that operators use themselves.
    for clash in ("ids", "n_tokens", "decoded", "_before", "__bucket", "__kept", "__n", "__total", "__position", "__row", "__spans", "__part", "rejected_by", "digest", "label", "text_", "n_words"):
        docs = docs.withColumn(clash, F.lit(f"own {clash}"))
    out = stage(spark, docs, "")
    if name != "sentencepiece":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {tuple(r)[4:] for r in out.collect()} == {tuple(f"own {c}" for c in docs.columns[4:])}
    else:
        assert out.columns == [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")] + ["ids", "n_tokens", "decoded"]
    got = collections.Counter(r.doc_id for r in out.collect())
    assert {1, None, 5} <= set(got) and (name != "near_dedup" or got[1] == 1 and got[4] == 1)
    assert stage(spark, docs.limit(0), "").collect() == []


@pytest.mark.parametrize("sent", [1, 1000])
def test_near_copies_go_without_a_shuffle_of_all_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(corpus_pipeline, "SENT", sent)
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(i, words(i, 40), "a") for i in range(20)] + [(100 + i, words(i, 40), "b") for i in range(5)] + [(7, words(7, 40), "a"), (None, words(3, 40), None), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = collections.Counter(r.doc_id for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == collections.Counter([*range(20), None, None])
    assert ("SortMergeJoin" in plan) == (sent == 1)
