"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first few letters, so that inflected forms share one. The fit takes a bounded sample of labelled texts of each class (``examples`` rows),
chooses at most ``terms`` terms that tell the classes apart there (chi-square), and counts in how many of all documents each occurs. Vectors of all documents
over these terms are written once. The examples' vectors become an inverted index whose size has that bound, so it is broadcast: postings of each term lie in blocks of
examples, with the largest weight of a term in a block. The sum of query weight times that maximum bounds every score in the block, so blocks are visited by falling bound
until none can hold a nearer example; similar examples share blocks. The result is that of comparing with every example.

Neighbours vote with weights that fall with their distance; the share of toxic votes is put through a logistic fitted on the examples themselves, each without its own vote.
A text without any of the terms has no neighbour, and gets the rate of such texts among the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import grams
from tallyloom.llm.discriminant import held_out
from tallyloom.runtime import materialise

#: Letters are ASCII letters and all bytes of longer characters.
BETWEEN = np.ones(256, bool)
BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False
#: Term kinds: whole words, and beginnings of longer words of so many letters.
BEGINNINGS = (4, 5)
#: Bounds of blocks held at a time, and blocks of a query that are visited at a time.
BOUNDS, STEPS = 1 << 21, 16
#: Votes against a text from the start, as a share of the neighbours asked for.
AGAINST = 1.0
EVIDENCE = "array<struct<id:bigint,similarity:double,label:int>>"


def term_hashes(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of every term of each text, the text's row, and the number of rows. Null texts have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = grams.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = grams.word_bounds(data, offsets, BETWEEN)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, rows = [grams.content_hash(data, starts, ends)], [row]
    letter = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(letter, starts)
    for size in BEGINNINGS:
        stop = np.append(letter, np.full(size, len(data)))[at + size]
        some = stop < ends
        hashes.append(grams.mix(grams.content_hash(data, starts[some], stop[some]) + np.uint64(size)))
        rows.append(row[some])
    return np.concatenate(hashes), np.concatenate(rows), len(offsets) - 1


def counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in order, with how often each occurs."""
    order = np.lexsort((terms, rows))
    r, t = rows[order], terms[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    start = np.flatnonzero(new)
    return r[start], t[start], np.diff(np.append(start, len(r)))


def chosen_terms(sample: DataFrame, text: str, label: str, terms: int, chi_square: float, least: int, ratio: float) -> np.ndarray:
    """Sorted hashes of the ``terms`` terms of the highest chi-square between the classes of ``sample``, of those in ``least`` texts or more and ``ratio`` times
    as frequent in one class as in the other. Without the ratio, the larger the sample, the more common words would pass that hardly differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.slices(batch, text):
                hashes, rows, n = term_hashes(piece.column(text))
                r, t, _ = counted(rows, hashes)
                toxic = np.asarray(piece.column(label))[r] == 1
                value, place = np.unique(t, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(place[~toxic], minlength=len(value))), pa.array(np.bincount(place[toxic], minlength=len(value)))], ["term", "clean", "toxic"])

    size = {r[label]: r["n"] for r in sample.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.uint64)
    found = sample.select(text, label).mapInArrow(run, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = F.col("clean") + F.col("toxic")
    away = F.col("toxic") * F.lit(float(n0)) - F.col("clean") * F.lit(float(n1))
    chi = away * away * (n0 + n1) / (F.lit(float(n0) * n1) * both * F.greatest(F.lit(n0 + n1) - both, F.lit(1)))
    often = [(F.col(c) + 0.5) / (n + 1) for c, n in (("clean", n0), ("toxic", n1))]
    apart = F.greatest(*often) >= F.least(*often) * ratio
    best = found.where((both >= least) & apart).withColumn("chi", chi).where(F.col("chi") >= chi_square).orderBy(F.desc("chi"), "term").limit(terms)
    return np.sort(np.asarray([r["term"] for r in best.select("term").collect()], np.int64).view(np.uint64))


def vectors(docs: DataFrame, known: np.ndarray, text: str, id_column: str) -> DataFrame:
    """``id_column``, and the places in ``known`` of each text's terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for piece in grams.slices(batch, text):
                hashes, rows, n = term_hashes(piece.column(text))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
                r, t, c = counted(rows[hit], at[hit])
                ends = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(id_column), pa.ListArray.from_arrays(ends, pa.array(t.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32)))], [id_column, "terms", "counts"])

    return docs.mapInArrow(run, f"{id_column} long, terms array<int>, counts array<int>")


def document_frequencies(vector: DataFrame, terms: int) -> dict[int, int]:
    """In how many rows of ``vectors`` each of ``terms`` terms occurs. A task adds up its rows, so one row a task and term is dealt, whatever the number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column("terms").flatten(), np.int64), minlength=terms)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["term", "n"])

    counts = vector.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}


@dataclass(frozen=True)
class Sparse:
    """Rows of weights: ``first`` entry of each row with the end, ``term`` and ``weight`` of each entry."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.first)[rows]
        stop = np.cumsum(size)
        at = np.repeat(self.first[:-1][rows] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        return Sparse(np.append(0, stop), self.term[at], self.weight[at])


def weighted(first: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> Sparse:
    """Unit vectors of (1 + ln count) * idf."""
    weight = (1 + np.log(count)) * idf[term]
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    norm = np.sqrt(np.bincount(rows, weight * weight, len(first) - 1))
    return Sparse(first, term, weight / norm[rows])


class BlockMaxIndex:
    """Postings of unit vectors by term and block of ``width`` rows, with the largest weight of each term in each block."""

    def __init__(self, examples: Sparse, ids: np.ndarray, terms: int, width: int = 64) -> None:
        n = len(examples.first) - 1
        # Rows of one heaviest term share blocks, so that maxima are tight.
        heavy = np.full(n, terms)
        rows = examples.rows
        order = np.lexsort((examples.weight, rows))
        heavy[rows[order]] = examples.term[order]
        self.order = np.lexsort((ids, heavy))
        examples = examples.take(self.order)
        self.ids, self.width, self.blocks = ids[self.order], width, max(1, -(-n // width))
        rows = examples.rows
        key = examples.term.astype(np.int64) * self.blocks + rows // width
        by = np.lexsort((rows, key))
        self.slot, self.weight = rows[by] % width, examples.weight[by]
        self.first = np.searchsorted(key[by], np.arange(terms * self.blocks + 1))
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most.reshape(-1), key, examples.weight)

    def top(self, queries: Sparse, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and places (-1: none) of the ``k`` nearest rows of each query with a positive score, ties to the smaller id; then how many blocks were
        visited. A row whose id is the query's ``own`` is not its neighbour; an own id of -1 with no such row leaves all. Queries are taken some at a time, so that bounds stay small."""
        n = len(own)
        edges = [0]
        while edges[-1] < n:
            room = queries.first[edges[-1]] + BOUNDS // self.blocks
            edges.append(min(n, edges[-1] + max(1, BOUNDS // (STEPS * self.width)), max(edges[-1] + 1, int(np.searchsorted(queries.first, room, "right")) - 1)))
        parts = [self._top(queries.take(np.arange(a, b)), own[a:b], k) for a, b in zip(edges, edges[1:])]
        if not parts:
            return np.zeros((0, k)), np.zeros((0, k), np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _top(self, queries: Sparse, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        n, width = len(queries.first) - 1, self.width
        rows = queries.rows
        bound = np.zeros((n, self.blocks))
        filled = np.flatnonzero(np.diff(queries.first))
        if len(filled):
            bound[filled] = np.add.reduceat(queries.weight[:, None] * self.most[queries.term], queries.first[:-1][filled], axis=0)
        bound *= 1 + 1e-9
        by = np.argsort(-bound, axis=1, kind="stable")
        score, place = np.zeros((n, k)), np.full((n, k), -1)
        seen, at, step = 0, 0, 1
        while at < self.blocks:
            # Some blocks of each query at a time, more in each turn; none that cannot hold a nearer row than the k-th so far.
            block = by[:, at : at + step]
            limit = np.take_along_axis(bound, block, 1)
            query, turn = np.nonzero((limit > 0) & (limit >= score[:, -1:]))
            if not len(query):
                break
            seen += len(query)
            at, step = at + step, min(2 * step, STEPS)
            block = block[query, turn]
            some = queries.take(query)
            key = some.term.astype(np.int64) * self.blocks + block[some.rows]
            start, count = self.first[key], self.first[key + 1] - self.first[key]
            stop = np.cumsum(count)
            entry = np.repeat(start - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)
            slot = np.repeat(some.rows, count) * width + self.slot[entry]
            got = np.bincount(slot, np.repeat(some.weight, count) * self.weight[entry], len(query) * width)
            hit = np.flatnonzero(got)
            row, found = query[hit // width], block[hit // width] * width + hit % width
            got = np.round(got[hit], 12)
            better = (got > 0) & (got >= score[row, -1]) & (self.ids[found] != own[row])
            row, found, got = row[better], found[better], got[better]
            # The best of a query so far and the new ones, in order; each has at most k places.
            old = np.unique(row)
            row = np.concatenate([row, np.repeat(old, k)])
            found, got = np.concatenate([found, place[old].ravel()]), np.concatenate([got, score[old].ravel()])
            order = np.lexsort((np.where(found >= 0, self.ids[found], np.iinfo(np.int64).max), -got, row))
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            score[row[top], rank[top]], place[row[top], rank[top]] = got[order][top], found[order][top]
        return score, place, seen


@dataclass(frozen=True)
class Neighbours:
    """The fitted classifier. ``rate``: score of texts without terms; ``slope`` and ``shift``: the logistic on the share of toxic votes."""

    index: BlockMaxIndex
    idf: np.ndarray
    label: np.ndarray
    class_weight: np.ndarray
    k: int
    rate: float
    slope: float = 1.0
    shift: float = 0.0

    def votes(self, queries: Sparse, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of toxic votes, nan without a neighbour; scores and places of the neighbours. Some votes stand against each text from the start, so that few or far neighbours say less."""
        score, place, _ = self.index.top(queries, own, self.k)
        # Votes fall with the distance of unit vectors.
        strength = np.where(place >= 0, 1 / (0.1 + np.sqrt(np.maximum(0, 2 - 2 * score))), 0) * self.class_weight[self.label[place]]
        total = strength.sum(1)
        with np.errstate(invalid="ignore"):
            return (strength * (self.label[place] == 1)).sum(1) / np.where(total > 0, total + self.k * AGAINST, np.nan), score, place

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(share), self.rate, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(share) + self.shift))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit with smoothed targets (Platt), by Newton steps."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (target - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _stacked(lists_t, lists_c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.asarray([len(x) for x in lists_t], np.int64)
    flat = lambda lists: np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
    return np.append(0, np.cumsum(size)), flat(lists_t), flat(lists_c)


def fit(rows: list, idf: np.ndarray, totals: np.ndarray, k: int) -> Neighbours:
    """From the examples (id, label, terms, counts), and how many labelled rows each class has in all."""
    ids = np.asarray([r[0] for r in rows], np.int64)
    label = np.asarray([r[1] for r in rows], np.int64)
    examples = weighted(*_stacked([r[2] for r in rows], [r[3] for r in rows]), idf)
    index = BlockMaxIndex(examples, ids, len(idf))
    inside = np.maximum(np.bincount(label, minlength=2), 1)
    class_weight = totals / inside / max(1e-9, (totals / inside).max())
    sorted_label = label[index.order]
    empty = np.diff(examples.first) == 0
    share = class_weight[label]
    one, zero = (share[empty & (label == v)].sum() for v in (1, 0))
    model = Neighbours(index, idf, sorted_label, class_weight, k, float((one + 0.5 * share.min()) / (one + zero + share.max() + share.min())))
    votes, _, _ = model.votes(examples, ids)
    known = ~np.isnan(votes)
    if len(np.unique(label[known])) < 2:
        return Neighbours(index, idf, sorted_label, class_weight, k, model.rate, 16.0, -4.0)
    slope, shift = logistic(votes[known], label[known], share[known] / share[known].mean())
    return Neighbours(index, idf, sorted_label, class_weight, k, model.rate, slope, shift)


def score_rows(rows: DataFrame, model: Neighbours, id_column: str) -> DataFrame:
    """``id_column``, ``score`` and ``evidence`` (the neighbours: id, similarity and label, nearest first)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                piece = batch.slice(a, 1024)
                terms, counts = piece.column("terms"), piece.column("counts")
                first = np.append(0, np.cumsum(np.asarray(pc.list_value_length(terms), np.int64)))
                queries = weighted(first, np.asarray(terms.flatten(), np.int64), np.asarray(counts.flatten(), np.int64), model.idf)
                own = np.asarray(pc.fill_null(piece.column(id_column), np.iinfo(np.int64).min))
                share, score, place = model.votes(queries, own)
                has = place >= 0
                ends = pa.array(np.append(0, np.cumsum(has.sum(1))).astype(np.int32))
                at = place[has]
                found = pa.StructArray.from_arrays([pa.array(model.index.ids[at]), pa.array(score[has]), pa.array(model.label[at].astype(np.int32))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([piece.column(id_column), pa.array(model.calibrated(share)), pa.ListArray.from_arrays(ends, found)], [id_column, "score", "evidence"])

    return rows.mapInArrow(run, f"{id_column} long, score double, evidence {EVIDENCE}")


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, folds: int = 5, examples: int = 8192, terms: int = 2048, k: int = 15, chi_square: float = 15.0, least: int = 3, ratio: float = 4.0) -> DataFrame:
    """``id_column``, ``held_out``, ``score``, ``predicted`` and ``evidence`` of each row of ``docs``.

    Learns from labelled ids whose CRC-32 is not divisible by ``folds``: at most ``examples / 2`` of each class, those of the smallest hashes. Document frequencies are counted over all rows. Null texts count as
    empty; a text without a chosen term is scored with the rate of such texts. Rows with a null id are scored and not held out, repeated rows are alike, and no text is its own neighbour. A label that is not 0 or 1
    is left out, and so is an id with both; of rows with one id the smallest text is the example. Without labelled rows every score is 0; of one class only, it is that class's label. Other columns take no part.
    """
    source = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).cast("string").alias("text"))
    ids = F.col(id_column)
    known = labels.select(F.col(id_column).cast("long").alias(id_column), F.col(label).cast("int").alias("label")).where(ids.isNotNull() & F.col("label").isin(0, 1) & ~held_out(ids, folds))
    known = materialise(known.groupBy(id_column).agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most"), "labels")
    totals = np.zeros(2)
    for r in known.groupBy("label").agg(F.count("*").alias("n")).collect():
        totals[r["label"]] = r["n"]
    drawn = [known.where(F.col("label") == c).orderBy(F.xxhash64(id_column), id_column).limit(examples // 2) for c in (0, 1)]
    # At most ``examples`` ids.
    sample = source.join(F.broadcast(drawn[0].union(drawn[1])), id_column).groupBy(id_column, "label").agg(F.min("text").alias("text"))
    sample = materialise(sample, "examples")
    chosen = chosen_terms(sample, "text", "label", terms, chi_square, least, ratio)
    vector = materialise(vectors(source, chosen, "text", id_column), "vectors")
    frequency = document_frequencies(vector, len(chosen))
    n = vector.count()
    idf = 1 + np.log((1 + n) / (1 + np.asarray([frequency.get(i, 0) for i in range(len(chosen))], float)))
    rows = [tuple(r) for r in vectors(sample.select(id_column, "text"), chosen, "text", id_column).join(F.broadcast(sample.select(id_column, "label")), id_column).select(id_column, "label", "terms", "counts").orderBy(id_column).collect()]
    if not totals.all():
        out = vector.select(id_column, F.lit(float(totals[1] > 0)).alias("score"), F.array().cast(EVIDENCE).alias("evidence"))
    else:
        out = score_rows(vector, fit(rows, idf, totals, k), id_column)
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return out.select(id_column, F.coalesce(held_out(ids, folds), F.lit(False)).alias("held_out"), "score", predicted, "evidence")
