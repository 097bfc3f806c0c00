"""Exact search for the largest inner products, over blocks of vectors in descending order of length.

Vectors are turned by the eigenvectors of their sums of products (an SVD of the table, from sums that Spark adds up), so that the first few
turned components carry most of each product. They are sorted by length and packed into blocks. The block of the longest gives each query a first threshold;
then a query meets the blocks whose longest vector could still reach it, by Cauchy-Schwarz. Inside a block, runs of vectors are skipped by
length, then vectors by the product of their first turned components plus the bound on the rest; what is left is computed exactly, and the threshold rises.
Queries come in blocks too, so a task holds one block of each, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

#: Numbers gathered at a time.
GATHERED = 1 << 20
BLOCK = "block long, top double, ids binary, vectors binary"


def _dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as rows, padded by zeros, and which of them are whole: not null, without null or non-finite components."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    values = np.asarray(flat.fill_null(np.nan), float)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = values
    return out, np.isfinite(out).all(1) & ~np.asarray(lists.is_null())


def _pack(ids: np.ndarray, vectors: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype(np.int64).tobytes(), vectors.astype(np.float64).tobytes()


def _unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-numbered rows, as int64."""
    if not len(a):
        return np.zeros(0, np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    # Python's integers; a product beyond 64 bits is an error.
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)], np.int64)


def _scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Products of the pairs (q, v). Whole numbers whose sums stay below 2**53 are exact in any order, so where many pairs are left one matrix product gives all;
    else rows are gathered for a bounded number of pairs at a time."""
    if exact and 4 * len(q) > len(queries) * len(vectors):
        return (queries @ vectors.T)[q, v].astype(np.int64)
    step = max(1, GATHERED // queries.shape[1])
    parts = [_products(queries[q[i : i + step]], vectors[v[i : i + step]]) for i in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def search_block(query_ids, queries, least, ids, vectors, turn, k: int, first: int, run: int = 512):
    """The ``k`` best of a block for each query that reach ``least``: positions of queries, ids and scores.

    ``vectors`` are in descending order of length; ``turn`` is the rotation, ``first`` how many of its components are summed first.
    """
    least = least.copy()
    turned_q, turned_v = queries @ turn, vectors @ turn
    length_q, length_v = np.sqrt((queries**2).sum(1)), np.sqrt((vectors**2).sum(1))
    rest_q, rest_v = np.sqrt((turned_q[:, first:] ** 2).sum(1)), np.sqrt((turned_v[:, first:] ** 2).sum(1))
    exact = len(ids) > 0 and len(queries) > 0 and np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53
    none = np.zeros(0, np.int64)
    found_q, found_id, found_score = none, none, none
    for begin in range(0, len(ids), run):
        end = min(begin + run, len(ids))
        # Bounds are in floating point, so they are let out a little.
        loose = 1e-9 * length_q * length_v[begin] + 1e-6
        live = np.flatnonzero(length_q * length_v[begin] + loose >= least)
        if not len(live):
            break
        bound = turned_q[live, :first] @ turned_v[begin:end, :first].T + np.outer(rest_q[live], rest_v[begin:end])
        q, v = np.nonzero(bound + loose[live, None] >= least[live, None])
        other = query_ids[live[q]] != ids[v + begin]
        q, v = q[other], v[other]
        score = _scores(queries[live], vectors[begin:end], q, v, exact)
        q, v = live[q], v + begin
        good = score >= least[q]
        found_q, found_id, found_score = (np.concatenate(x) for x in ((found_q, q[good]), (found_id, ids[v[good]]), (found_score, score[good])))
        keep = best_of(found_q, found_id, found_score, k)
        found_q, found_id, found_score = found_q[keep], found_id[keep], found_score[keep]
        count = np.bincount(found_q, minlength=len(queries))
        full = np.flatnonzero(count >= k)
        if len(full):
            worst = np.full(len(queries), np.inf)
            np.minimum.at(worst, found_q, found_score)
            least[full] = np.maximum(least[full], worst[full])
    return found_q, found_id, found_score


def top_products(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: float = 1024.0, first: int = 16, block_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest whole-numbered inner products of each query.

    Components become floor(``scale`` * x). Queries are the ids divisible by ``every``, against all rows but those of the query's own id; ties go to
    the smaller id. Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; shorter vectors
    are padded by zeros. Repeated rows are candidates each; a repeated query id is asked once, with the smallest of its vectors.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    width = max(1, source.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("n")).first()["n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _dense(batch.column("vector"), width)
            ok &= ~np.asarray(batch.column("id").is_null())
            x = np.floor(x[ok] * scale)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), flat, pa.array(np.sqrt((x**2).sum(1)))], ["id", "v", "length"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _dense(batch.column("v"), width)[0]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    vectors = materialise(source.mapInArrow(whole, "id long, v array<double>, length double"), "vectors")
    size = vectors.count()
    gram = np.zeros(width * width)
    # Twelve bytes a pair of components.
    summed = vectors.select("v").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    gram[np.asarray(summed.column("i"))] = np.asarray(summed.column("v"))
    turn = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()
    first = min(first, width)
    tasks = max(1, size // (8 * block_rows))

    def blocks_of(per_block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            held, count = [], 0
            for batch in [*batches, None]:
                if batch is not None and batch.num_rows:
                    held.append((np.asarray(batch.column("id")), _dense(batch.column("v"), width)[0], np.asarray(batch.column("length"))))
                    count += batch.num_rows
                while held and (count >= per_block or batch is None and count):
                    ids, x, length = (np.concatenate(p) for p in zip(*held))
                    packed = _pack(ids[:per_block], x[:per_block])
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([float(length[:per_block].max())]), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], ["block", "top", "ids", "vectors"])
                    number += 1
                    held = [(ids[per_block:], x[per_block:], length[per_block:])] if len(ids) > per_block else []
                    count = max(0, len(ids) - per_block)

        return run

    ordered = vectors.repartitionByRange(tasks, F.desc("length"), F.asc("id")).sortWithinPartitions(F.desc("length"), F.asc("id"))
    blocks = materialise(ordered.mapInArrow(blocks_of(block_rows), BLOCK), "blocks")
    asked = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.min("length").alias("length"))
    query_tasks = max(1, size // every // block_rows)
    query_blocks = asked.repartition(query_tasks, "id").mapInArrow(blocks_of(block_rows), BLOCK)
    # One block of the longest vectors, at most block_rows rows, gives the first thresholds.
    longest = blocks.orderBy(F.desc("top"), "block").limit(1).collect()
    pilot = spark.sparkContext.broadcast((bytes(longest[0].ids), bytes(longest[0].vectors)) if longest else (b"", b""))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = _unpack(*pilot.value, width)
        for batch in batches:
            for block, own, body in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                query_ids, queries = _unpack(own, body, width)
                least = np.full(len(queries), -np.inf)
                q, _, score = search_block(query_ids, queries, least, ids, x, turn, k, first)
                full = np.bincount(q, minlength=len(queries)) >= k
                worst = np.full(len(queries), np.inf)
                np.minimum.at(worst, q, score)
                least[full] = worst[full]
                length = np.sqrt((queries**2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length > 0, least / length, np.where(least > 0, np.inf, -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([float(need.min()) * (1 - 1e-9) - 1e-6]), pa.array([own], pa.binary()), pa.array([body], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["asked", "need", "query_ids", "queries", "least"])

    questions = materialise(query_blocks.mapInArrow(thresholds, "asked long, need double, query_ids binary, queries binary, least binary"), "questions")
    # Numbers of the block pairs that can matter; the blocks themselves follow by key.
    pairs = materialise(_block_pairs(blocks, questions), "pairs")
    left = pairs.join(blocks.select("block", "ids", "vectors"), "block")
    right = pairs.join(questions, "asked").select(*[F.col(c).alias(c) for c in ("block", "asked", "query_ids", "queries", "least")])

    def meet(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, x = _unpack(v.column("ids")[0].as_py(), v.column("vectors")[0].as_py(), width)
        query_ids, queries = _unpack(q.column("query_ids")[0].as_py(), q.column("queries")[0].as_py(), width)
        least = np.frombuffer(q.column("least")[0].as_py())
        at, found, score = search_block(query_ids, queries, least, ids, x, turn, k, first)
        return pa.table({"query_id": pa.array(query_ids[at]), "vec_id": pa.array(found), "score": pa.array(score)})

    found = left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_pairs(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """Pairs of a block and a block of queries that it may answer: ``block``, ``asked``.

    Blocks are sorted by length, so each block of queries needs a prefix of them; blocks get their place in that order and
    queries list the places up to the last they need.
    """
    place = blocks.select("block", "top", F.row_number().over(Window.orderBy(F.desc("top"), "block")).alias("place"))
    place = materialise(place, "places")
    total = place.count()
    # As many places as there are blocks with a top of at least the need, found in a sorted list of tops' ranks.
    marks = place.select(F.col("top").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("asked"))
    marks = marks.union(questions.select(F.col("need").alias("at"), F.lit(0).alias("n"), "asked"))
    upto = marks.withColumn("last", F.sum("n").over(Window.orderBy(F.desc("at"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))).where("asked IS NOT NULL").select("asked", "last")
    listed = upto.where("last > 0").withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("last"), F.lit(total).cast("bigint")))))
    return listed.withColumn("place", F.col("place").cast("int")).join(place.select("block", "place"), "place").select("block", "asked")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
