"""Text quality by a regularised quadratic discriminant.

Each text is described by transformed statistics. For each class, the number of labelled texts, the sums of their statistics and of products
of two are added up by Spark over all labelled rows (no sample), so the fit sends the driver a few hundred numbers. Class covariances are shrunk towards the
diagonal of the pooled one; their Cholesky factors are made once and shipped with the model. The score is the logistic of the difference of log densities,
which are Mahalanobis distances through the factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import grams
from tallyloom.runtime import materialise

UPPER, LOWER_CASE, DIGIT, HIGH, SYMBOL, SHOUT, POINT, OTHER, BLANK = range(9)
CLASS = np.full(256, OTHER)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER_CASE, DIGIT, HIGH
CLASS[grams.SPACE] = BLANK
CLASS[list(b"#*$%&|<>{}[]~^=_\\/@+")] = SYMBOL
CLASS[ord("!")] = SHOUT
CLASS[list(b".,;:?")] = POINT

NAMES = (
    "log_words", "word_length", "capitals", "digits", "symbols", "shouts", "others", "pointed_words", "new_words", "same_as_before", "new_pairs",
    "symbol_words", "capital_words", "same_lines", "words_per_line",
)


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each row."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n)


def statistics(column, steady: float = 20.0) -> np.ndarray:
    """A row of ``NAMES`` for each text; null and wordless texts are alike.

    Shares are taken with ``steady`` words of an ordinary text added, and their square root, so that short texts do not stray.
    """
    data, offsets = grams.utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = CLASS[data]
    chars = np.bincount(np.repeat(np.arange(n), size) * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    starts, ends, first = grams.word_bounds(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    name = grams.content_hash(data, starts, ends)

    def inside(which: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind == which))
        return sums[ends] - sums[starts]

    per_row = lambda marks: np.bincount(row[marks], minlength=n)
    near = np.zeros(len(starts), bool)
    near[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    pair_row = row[1:][row[1:] == row[:-1]]
    pair = grams.mix(name[1:] * np.uint64(3) + name[:-1])[row[1:] == row[:-1]]
    capital = (inside(UPPER) > 1) & (inside(LOWER_CASE) == 0)
    pointed = kind[ends - 1] == POINT if len(ends) else np.zeros(0, bool)
    # Lines with a word, by where words' lines begin.
    breaks = np.append(0, np.cumsum(data == 10))
    line = breaks[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(starts)) - 1
    line_row = row[at]
    lines = np.bincount(line_row, minlength=n)
    fresh_lines = _distinct(line_row, grams.content_hash(data, starts[at], ends[last]) if len(at) else name, n)
    letters = chars[:, [UPPER, LOWER_CASE, HIGH]].sum(1)
    in_words = size - chars[:, BLANK]

    def share(count, total, usual: float, weight: float = steady):
        return np.sqrt((count + usual * weight) / (total + weight))

    return np.column_stack([
        np.log1p(words),
        np.log((in_words + 5.0 * steady) / (words + steady)),
        share(chars[:, UPPER], letters, 0.02, 5 * steady),
        share(chars[:, DIGIT], in_words, 0.0, 5 * steady),
        share(chars[:, SYMBOL], in_words, 0.0, 5 * steady),
        share(chars[:, SHOUT], in_words, 0.0, 5 * steady),
        share(chars[:, OTHER], in_words, 0.0, 5 * steady),
        share(per_row(pointed), words, 0.14),
        share(_distinct(row, name, n), words, 0.78),
        share(per_row(near), words, 0.0),
        share(_distinct(pair_row, pair, n), np.bincount(pair_row, minlength=n), 0.98),
        share(per_row(inside(SYMBOL) > 0), words, 0.0),
        share(per_row(capital), words, 0.0),
        share(lines - fresh_lines, lines, 0.0, 3.0),
        np.log((words + 10.0 * 3) / (lines + 3.0)),
    ]).reshape(n, len(NAMES))


def described(docs: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = "x") -> DataFrame:
    """``id_column`` and the statistics of each text as an array ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.slices(batch, text):
                x = statistics(piece.column(text))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(id_column), lists], [id_column, name])

    narrow = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).cast("string").alias(text))
    return narrow.mapInArrow(run, f"{id_column} long, {name} array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes; ``None`` for a class without rows."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class."""
        away = [np.einsum("ij,nj->ni", f, x - m) for f, m in zip(self.factors, self.means)]
        log = [c - 0.5 * (a * a).sum(1) for a, c in zip(away, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def discriminant(count: np.ndarray, total: np.ndarray, products: np.ndarray, shrink: float = 0.05, floor: float = 1e-4) -> Discriminant | None:
    """From the number, sums and sums of products of each class. None if a class has no rows.

    ``shrink``: weight of the pooled diagonal in each covariance; ``floor``: least variance of a statistic.
    """
    if (count < 1).any():
        return None
    means = total / count[:, None]
    scatter = products - count[:, None, None] * np.einsum("ki,kj->kij", means, means)
    pooled = np.diag(scatter.sum(0)) / count.sum()
    pooled = np.diag(np.maximum(pooled, floor))
    covariance = (1 - shrink) * scatter / count[:, None, None] + shrink * pooled
    lower = np.linalg.cholesky(covariance)
    factors = np.stack([np.linalg.inv(c) for c in lower])
    spread = np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)
    return Discriminant(means, factors, np.log(count / count.sum()) - spread)


def fit(rows: DataFrame, label: str = "label", name: str = "x", **options) -> Discriminant | None:
    """From rows with a label (0 or 1; others are left out) and statistics."""
    d = len(NAMES)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            x = np.asarray(batch.column(name).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(label))
            for k in (0, 1):
                some = x[y == k]
                sums[k] += np.concatenate([[len(some)], some.sum(0), (some.T @ some)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(sums.shape[1]), 2).astype(np.int32)), pa.array(sums.ravel())], ["k", "i", "v"])

    parts = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias(label), name).mapInArrow(run, "k int, i int, v double")
    sums = np.zeros((2, 1 + d + len(upper[0])))
    for r in parts.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums[r.k, r.i] = r.v
    products = np.zeros((2, d, d))
    products[:, upper[0], upper[1]] = sums[:, 1 + d :]
    products = products + np.triu(products, 1).transpose(0, 2, 1)
    return discriminant(sums[:, 0], sums[:, 1 : 1 + d], products, **options)


def scored(rows: DataFrame, model: Discriminant | None, name: str = "x", score: str = "score") -> DataFrame:
    """``rows`` with the score of their statistics; 0.5 if there is no model."""
    if model is None:
        return rows.withColumn(score, F.lit(0.5))

    @F.pandas_udf("double")
    def of(x):
        import pandas as pd

        return pd.Series(model.score(np.stack(x.to_list()))) if len(x) else pd.Series([], dtype=float)

    return rows.withColumn(score, of(name))


def held_out(id_column: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(folds)) == 0


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """``id_column``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``.

    Learns from labelled ids whose CRC-32 is not divisible by ``folds``. Null texts count as empty and are scored, rows with a null id are scored and
    are not held out, repeated rows are alike; a label that is null or not 0 or 1 is left out, and repeated labels count as often as they stand.
    """
    x = materialise(described(docs, id_column, text), "statistics")
    known = labels.select(F.col(id_column).cast("long").alias(id_column), F.col(label).cast("int").alias("label")).where(~held_out(F.col(id_column), folds))
    model = fit(x.join(known, id_column), **options)
    out = scored(x, model)
    return out.select(id_column, F.coalesce(held_out(F.col(id_column), folds), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
