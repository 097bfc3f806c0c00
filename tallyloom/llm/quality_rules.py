"""Rules that reject documents of low quality, as a cascade in the cheapest order. Only built-in functions.

Each rule's share of rejected rows and its cost are measured on a sample; the cascade then tests the rules by rejection per cost
and stops at the first that rejects (a CASE expression). A document is rejected if any rule rejects it, so the order, which
depends on the clock, never changes the verdict. The sample decides nothing else.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.cleaning import once
from tallyloom.runtime import materialise

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WORDS, CHARS, LINES, GRAMS = "__words", "__chars", "__lines", "__grams"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    """Number of characters of a class."""
    return F.regexp_count(text, F.lit(f"[{pattern}]")).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.btrim(text, F.lit(SPACES)), "[ \\t-\\r]+"), "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def n_words(_: str = "") -> Column:
    return F.size(WORDS).cast("long")


def word_chars(_: str = "") -> Column:
    return F.col(CHARS)


def letters(text: str) -> Column:
    """Word characters but those that are no letters, which are few."""
    return word_chars() - count_of(_text(text), "^\\p{L} \\t-\\r")


def n_symbols(text: str) -> Column:
    return count_of(_text(text), SYMBOLS)


def n_lines(_: str = "") -> Column:
    return F.size(LINES).cast("long")


def n_dup_lines(_: str = "") -> Column:
    return (F.size(LINES) - F.size(F.array_distinct(LINES))).cast("long")


def n_repeat_words(_: str = "") -> Column:
    """Words in 3-word windows that occur more than once: sort the windows' hashes with their places, keep those equal to a neighbour."""
    grams = F.col(GRAMS)
    beside = lambda g, j: (g["h"] == F.get(grams, j + 1)["h"]) | (g["h"] == F.get(grams, j - 1)["h"])
    places = F.flatten(F.transform(F.filter(grams, beside), lambda g: F.array(g["i"], g["i"] + 1, g["i"] + 2)))
    return F.size(F.array_distinct(places)).cast("long")


def grams_of() -> Column:
    w = F.col(WORDS)
    at = F.sequence(F.lit(0), F.size(w) - 3)
    some = F.transform(at, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    kind = "array<struct<h:bigint,i:int>>"
    return F.when(F.size(w) >= 4, F.sort_array(some)).otherwise(F.array().cast(kind))


@dataclass(frozen=True)
class Rule:
    """``reject(text column)`` is true for a document to reject; ``uses`` are helper columns it reads."""

    name: str
    reject: object


def _short(text):
    return n_words() < 50


def _repeats(text):
    return 100 * n_repeat_words() > 50 * n_words()


BASE = (Rule("short", _short), Rule("repeated_words", _repeats))
MORE = (
    Rule("symbols", lambda t: 10 * n_symbols(t) > n_words()),
    Rule("exclamations", lambda t: 10 * count_of(_text(t), "!") > n_words()),
    Rule("repeated_lines", lambda t: 2 * n_dup_lines() > n_lines()),
    Rule("word_length", lambda t: (word_chars(t) < 2 * n_words()) | (word_chars(t) > 20 * n_words())),
    Rule("capitals", lambda t: 10 * count_of(_text(t), "\\p{Lu}") > 3 * letters(t)),
    Rule("letters", lambda t: 2 * letters(t) < word_chars(t)),
)
RULES = BASE + MORE


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the helper columns that rules read; those that no expression reads are pruned."""
    return docs.withColumn(WORDS, words_of(_text(text))).withColumn(CHARS, F.char_length(F.array_join(WORDS, "")).cast("long")).withColumn(LINES, lines_of(_text(text))).withColumn(GRAMS, grams_of())


def measure(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """For each rule the seconds it takes on a sample and the share of the sample that it rejects.

    ``sample_rows`` is about the size of the sample; it serves to order rules only.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    sample = materialise(docs.sample(fraction=share, seed=seed).select(text), "sample")
    ready = prepared(sample, text)
    out = []
    for rule in rules:
        begin = time.perf_counter()
        row = ready.agg(F.avg(rule.reject(text).cast("int")).alias("share")).first()
        out.append((rule, time.perf_counter() - begin, row["share"] or 0.0))
    return out


def in_order(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per cost first."""
    return [m[0] for m in sorted(measured, key=lambda m: -m[2] / max(m[1], 1e-9))]


def cascade(rules: list[Rule], text: str) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.reject(text), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules=RULES, text: str = "text", verdict: str = "rejected_by") -> DataFrame:
    """Adds ``rejected_by``: a rule that rejects the row, or null. Null texts have no words and are rejected as short."""
    order = in_order(measure(docs, rules, text))
    # Made once, so that no filter on it is pushed below the helper columns and works them out for each window.
    return once(prepared(docs, text), {verdict: cascade(order, text)}).drop(WORDS, CHARS, LINES, GRAMS)


def accepted(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Rows that no rule rejects, with their columns."""
    return judge(docs, rules, text, "__rejected").where("__rejected IS NULL").drop("__rejected")


def facts_and_verdict(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each document, ``base_failed`` and ``kept``: the base rules on the counts, then the cascade of the others.

    Each row is judged by itself, so null ids and repeated rows stay as they are; null and wordless texts have no words and fail.
    """
    order = in_order(measure(docs, MORE, text))
    ready = prepared(docs.select(id_column, text), text)
    facts = ready.select(
        id_column, text, WORDS, CHARS, LINES,
        n_words().alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines().alias("n_dup_lines"), n_repeat_words().alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = facts.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, text).isNull()))
    return judged.drop(text, WORDS, CHARS, LINES)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts, len(ls) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * shouts > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * capitals > 3 * letters OR 2 * letters < word_chars) AS kept
FROM b
"""
