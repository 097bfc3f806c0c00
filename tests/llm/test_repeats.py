"""Ops 9 and 10 against brute force."""

import hashlib
import random
import re

import pytest

from tallyloom.llm.substring_dedup import SuffixAutomaton, against_reference, remove_repeats
from tallyloom.llm.suffix_index import remove_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "à", "ß", "x", "stone", "river", "light", "😀", "and"]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.randrange(0, 80))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            a = r.randrange(0, 20)
            words[at:at] = passage[a : a + r.randrange(10, 40)]
        if i % 7 == 3 and out:
            words = (out[r.randrange(len(out))] or "").split()
            if words:
                words[r.randrange(len(words))] = "changed"
        out.append("".join(w + r.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    out[5] = None
    out[6] = ""
    out[7] = out[8] = "same " * 100
    out[9] = "\x00" * 120
    out[10] = "\x00" * 130
    out[11] = "one two three"
    return list(enumerate(out))


def brute(rows, width, split, join):
    first = {}
    seqs = [(i, split(t or "")) for i, t in rows]
    for i, s in seqs:
        for a in range(len(s) - width + 1):
            key = tuple(s[a : a + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, s in seqs:
        gone = [False] * len(s)
        for a in range(len(s) - width + 1):
            if first[tuple(s[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        kept = join([x for x, g in zip(s, gone) if not g])
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r["__total"], r["__removed"], len(r["__spans"]), hashlib.sha256(bytes(r["__kept"])).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("hot,part", [(1000, 1 << 21), (2, 2000)])
def test_words_and_bytes_equal_brute_force(spark, hot, part):
    rows = corpus(hot)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 13, WORD.findall, lambda k: " ".join(k).encode())
    assert got(remove_repeats(df, hot=hot, part_bytes=part)) == want
    want = brute(rows, 50, lambda t: list(t.encode()), bytes)
    assert got(remove_repeated_bytes(df, hot=hot, part_bytes=part)) == want


def test_nulls_empty_tables_repeated_rows_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 2), (9, text, 3), (None, None, 4)], "doc_id long, text string, seen long")
    rows = sorted((r.doc_id or -1, r.seen, r["__removed"]) for r in remove_repeats(df).collect())
    assert rows == [(-1, 1, 0), (-1, 4, 0), (4, 2, 0), (4, 2, 0), (9, 3, 30)]
    empty = df.limit(0)
    assert remove_repeats(empty).collect() == [] and remove_repeated_bytes(empty).columns[:3] == ["doc_id", "text", "seen"]
    laid_out = remove_repeats(spark.createDataFrame([(1, "a\nb  c\n")], "doc_id long, text string"), joined=False).first()
    assert bytes(laid_out["__kept"]) == b"a\nb  c\n"


def test_automaton_matching_statistics():
    r = random.Random(3)
    known = ["".join(r.choice("ab") for _ in range(r.randrange(1, 30))) for _ in range(6)]
    automaton = SuffixAutomaton()
    for k in known:
        automaton.add(k)
    probe = "".join(r.choice("abc") for _ in range(200))
    want = [max(n for n in range(i + 2) if n == 0 or any(probe[i + 1 - n : i + 1] in k for k in known)) for i in range(len(probe))]
    assert automaton.matching(probe) == want


def test_broadcast_reference(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b " + item + " c"), (2, None), (3, "a b c")], "doc_id long, text string")
    reference = spark.createDataFrame([(item,), (None,)], "text string")
    out = {r.doc_id: [(s.start, s.end) for s in r.removed_spans] for r in against_reference(docs, reference).collect()}
    assert out == {1: [(2, 22)], 2: [], 3: []}
    with pytest.raises(ValueError):
        against_reference(docs, reference, max_reference_bytes=3)


def test_very_long_texts(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "start " + long + " end"), (3, "x" * 300_000), (4, "x" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r["__removed"] for r in remove_repeats(df).collect()} == {1: 0, 2: 60_000, 3: 0, 4: 0}
    got = {r.doc_id: (r["__removed"], len(r["__spans"])) for r in remove_repeated_bytes(df).collect()}
    assert got == {1: (0, 0), 2: (len(long), 1), 3: (0, 0), 4: (300_000, 1)}


def thue_morse(n, a, b):
    """Symbols whose polynomial hash modulo a power of two equals that of the sequence with both symbols swapped."""
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


@pytest.mark.parametrize("hot", [1000, 1])
def test_patterns_that_cancel_in_a_polynomial_hash(spark, hot):
    head = " ".join(f"w{i}" for i in range(12))
    words = ["".join(thue_morse(n, *pair)) for n in (1024, 2048) for pair in ("ab", "ba")]
    rows = [(i, f"{head} {w}") for i, w in enumerate(words)]
    rows += [(10 + i, " ".join(thue_morse(n, *pair))) for i, (n, pair) in enumerate((n, p) for n in (1024, 2048) for p in (("up", "down"), ("down", "up")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(remove_repeats(df, hot=hot))
    assert [out[i][1] for i in range(4)] == [0] * 4
    assert out == brute(rows, 13, WORD.findall, lambda k: " ".join(k).encode())
    assert got(remove_repeated_bytes(df, hot=hot)) == brute(rows, 50, lambda t: list(t.encode()), bytes)
