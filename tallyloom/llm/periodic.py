"""Runs of periodic words in a text, by an enhanced suffix array and the test for branching tandem repeats.

A run of smallest period q that ends before word e holds the square of q words twice that ends there. The two halves of that square share exactly q words, so their suffixes
are parted at an LCP value of q: the square is a branching tandem repeat. Texts of a batch are sorted together, no suffix beyond its text:

1. Ranks by the first 1, 2, 4, ... words (prefix doubling; only suffixes that are still tied are sorted again) give the suffix array, its inverse, LCP values and, kept
   by level, the longest common extension of any two places.
2. Each boundary between neighbours of the suffix array with LCP value d parts the interval around it in two. Each suffix i of the smaller side asks the inverse suffix array if i + d or
   i - d lies on the other side. No tree is made: an interval is two numbers, found by minima over blocks of doubling length.
3. Each square is rotated to the left while words d apart are equal. Squares that meet in one stretch are one run, of their smallest d.

A run of the least length has its interval hold at least ``least // d`` suffixes and ``times`` at least; smaller intervals are not asked. All steps are array
operations, and memory follows the words of a batch of texts or of one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import grams

#: Suffixes of smaller sides looked at together.
CHUNK = 1 << 20


def suffix_levels(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array, ranks by the first 2**k symbols for each k until all differ, and the end of the text of each place.

    ``code``: symbols as numbers from 0; ``first``: where each text begins, with the end. Suffixes are in order of their text, then their symbols; a suffix that ends is the smaller one.
    """
    n = len(code)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    end = first[1:][row]
    key = row * (int(code.max()) + 1 if n else 1) + code
    sa = np.argsort(key, kind="stable")

    def grouped(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the group of each sorted key begins, and which groups hold several."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        return slots[head], ~(new & np.append(new[1:], True))

    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    rank[sa], tied = grouped(key[sa], slots)
    levels, step = [rank], 1
    while tied.any():
        slots = slots[tied]
        at = sa[slots]
        after = at + step
        inside = after < end[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at = at[order]
        sa[slots] = at
        rank = rank.copy()
        rank[at], tied = grouped(key[order], slots)
        levels.append(rank)
        step *= 2
    return sa, levels, end


def common_ahead(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``, within one text each."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        open_ = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = open_[levels[k][x[open_]] == levels[k][y[open_]]]
        out[same] += 1 << k
    return out


def common_behind(levels: list[np.ndarray], begin: np.ndarray, at: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """How many words before ``at`` equal those ``apart`` later; ``begin``: where the text of each starts."""
    out = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = at - out - (1 << k)
        open_ = np.flatnonzero(x >= begin)
        same = open_[levels[k][x[open_]] == levels[k][x[open_] + apart[open_]]]
        out[same] += 1 << k
    return out


class Minima:
    """Minima of all blocks of 2**k neighbouring values, for the nearest smaller value on either side."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.rows = [values]
        while (2 << (len(self.rows) - 1)) <= min(longest, len(values)):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place of the stretch before ``at`` whose values are ``least`` or more; ``at`` itself if there is none."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            x = at - (1 << k)
            open_ = np.flatnonzero(x >= 0)
            wide = open_[self.rows[k][x[open_]] >= least[open_]]
            at[wide] -= 1 << k
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place of the stretch after ``at`` whose values are ``least`` or more; ``at`` itself if there is none."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            open_ = np.flatnonzero(at + 1 < len(self.rows[k]))
            wide = open_[self.rows[k][at[open_] + 1] >= least[open_]]
            at[wide] += 1 << k
        return at


def branching_squares(sa: np.ndarray, lcp: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and half lengths of branching tandem repeats that may end a run. ``lcp[p]``: of suffixes p - 1 and p of the array."""
    longest = int(np.diff(first).max()) if len(first) > 1 else 0
    at = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    minima = Minima(lcp, 2 * longest)
    depth = lcp[at]
    low = minima.left(at, depth) - 1
    # The whole interval, over boundaries of the same value on the right as well, tells if a run may be there.
    wide = minima.right(at, depth) - low + 1 >= np.maximum(times, least // depth)
    at, depth, low = at[wide], depth[wide], low[wide]
    high = minima.right(at, depth + 1)
    # Suffixes low .. at - 1 lie on the left, at .. high on the right: every two suffixes are parted at one boundary.
    left_small = at - low <= high - at + 1
    small, count = np.where(left_small, low, at), np.where(left_small, at - low, high - at + 1)
    other, stop = np.where(left_small, at, low), np.where(left_small, high, at - 1)
    isa = np.empty(len(sa), np.int64)
    isa[sa] = np.arange(len(sa))
    begin = np.repeat(first[:-1], np.diff(first))
    total = np.cumsum(count)
    places, halves = [none], [none]
    a = 0
    while a < len(count):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        part = np.repeat(np.arange(a, b), count[a:b])
        i = sa[np.arange(len(part)) - (total[part] - count[part] - done) + small[part]]
        d = depth[part]
        for j, head in ((i + d, i), (i - d, i - d)):
            known = np.flatnonzero((j >= begin[i]) & (j < end[i]))
            spot = isa[j[known]]
            hit = known[(spot >= other[part[known]]) & (spot <= stop[part[known]])]
            places.append(head[hit])
            halves.append(d[hit])
        a = b
    return np.concatenate(places), np.concatenate(halves)


def find_runs(code: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbol, length and smallest period of each run of ``max(least, times * period)`` symbols or more, by first symbol, then period."""
    none = np.zeros(0, np.int64)
    if not len(code):
        return none, none, none
    sa, levels, end = suffix_levels(code, first)
    lcp = np.zeros(len(sa), np.int64)
    tied = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[tied] = common_ahead(levels, end, sa[tied - 1], sa[tied])
    at, period = branching_squares(sa, lcp, first, end, least, times)
    begin = np.repeat(first[:-1], np.diff(first))[at]
    start = at - common_behind(levels, begin, at, period)
    length = at + 2 * period - start
    long = length >= np.maximum(least, times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, lost: np.ndarray) -> pa.Array:
    """The words of each text that are not ``lost``, joined by one space."""
    kept = np.flatnonzero(~lost)
    size = ends[kept] - starts[kept] + 1
    stop = np.cumsum(size)
    body = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    spaces = np.zeros(len(body), bool)
    spaces[stop - 1] = True
    body[spaces] = 32
    body[~spaces] = data[np.repeat(starts[kept] - (stop - size - np.arange(len(kept))), size - 1) + np.arange(len(body) - len(kept))]
    # Each text but an empty one ends in a space that goes.
    bounds = np.append(0, stop)[np.searchsorted(kept, first)]
    filled = np.diff(bounds) > 0
    stay = np.ones(len(body), bool)
    stay[bounds[1:][filled] - 1] = False
    at = np.append(0, np.cumsum(np.diff(bounds) - filled))
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body[stay])])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS, COLLAPSED, BEST = "runs", "collapsed", "best"


def _described(piece: pa.Table | pa.RecordBatch, text: str, least: int, times: int) -> tuple[list[list], list, pa.Array]:
    data, offsets = grams.utf8(piece.column(text))
    starts, ends, first = grams.word_bounds(data, offsets)
    code = np.asarray(grams.gather(data, starts, ends - starts).dictionary_encode().indices).astype(np.int64)
    start, length, period = find_runs(code, first, least, times)
    lost = np.zeros(len(code) + 1, np.int64)
    np.add.at(lost, start + period, 1)
    np.add.at(lost, start + length, -1)
    runs: list[list] = [[] for _ in range(len(offsets) - 1)]
    row = grams.rows_of(first, start)
    for r, s, n, p in zip(row.tolist(), (start - first[row]).tolist(), length.tolist(), period.tolist()):
        runs[r].append({"start": s, "length": n, "period": p})

    def ahead(x: dict, y: dict) -> bool:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return a > b or (a == b and (x["start"], x["period"]) < (y["start"], y["period"]))

    best = []
    for found in runs:
        top = None
        for run in found:
            if top is None or ahead(run, top):
                top = run
        best.append(top)
    return runs, best, collapsed_words(data, starts, ends, first, np.cumsum(lost[:-1]) > 0)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Rows of ``docs`` with ``runs`` (array of start, length and period, in words from 0, by start, then period), ``best`` (the run of the greatest length / period;
    ties: smallest start, then period; null without a run) and ``collapsed`` (the words outside every run after its first period, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of consecutive words with smallest period q, at least ``max(least, times * q)`` long, that no
    neighbour extends. Null, empty and wordless texts have no run and collapse to the empty text; rows are looked at one by one, so repeated rows are alike. Columns of ``docs`` named
    like a result are replaced by it, and no others are touched. ``times`` must be 2 or more.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    if times < 2 or least < 1:
        raise ValueError("times must be 2 or more and least 1 or more")
    added = [RUNS, BEST, COLLAPSED]
    # The text is read under a name of its own, so that it may be called like a result.
    spare = "__text"
    while spare in docs.columns:
        spare += "_"
    kept = docs.withColumn(spare, F.col(text).cast("string")).drop(*added)
    stay = [c for c in kept.columns if c != spare]
    schema = to_arrow_schema(kept.select(stay).schema)
    for name, kind in ((RUNS, pa.list_(RUN)), (BEST, RUN), (COLLAPSED, pa.string())):
        schema = schema.append(pa.field(name, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.slices(batch, spare):
                runs, best, rest = _described(piece, spare, least, times)
                columns = [piece.column(c) for c in stay] + [pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), rest.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, stay + added)

    return kept.mapInArrow(run, from_arrow_schema(schema))


def looped(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with a loop in the text of every id whose CRC-32 ends in 0: from word a on, each word is one of p words over and over, a and p drawn from the same CRC-32."""
    h = F.crc32(F.col(id_column).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(h / 10)
    n = F.size("words")
    marked = docs.withColumn("words", F.when(h % 10 == 0, words))
    a = F.when(n > 0, F.pmod(g, n)).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    source = marked.withColumn("a", a).withColumn("p", p)
    filled = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return source.withColumn(text, F.when(F.size("words") > 0, F.array_join(filled, " ")).otherwise(F.col(text))).drop("words", "a", "p")


def run_facts(docs: DataFrame) -> DataFrame:
    """For each of ``docs`` (doc_id, text): the number of runs in the text after ``looped``, its best run and digests of all runs and of what is left."""
    found = periodic_runs(looped(docs.select("doc_id", "text")))
    line = F.transform(RUNS, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col(BEST)
    return found.select(
        "doc_id", F.size(RUNS).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.col(COLLAPSED), 256).alias("collapsed_sha256"),
    )


#: Words eight apart from others equal at a distance of q show a run of period q, of any length that counts; stretches of such places are the runs.
SQL = r"""
WITH bits AS (SELECT b::UBIGINT AS b, list_reduce(list_prepend(b::UBIGINT, [s::UBIGINT for s in range(8)]), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),
steps AS (SELECT list(v ORDER BY b) AS v FROM bits),
crcs AS (SELECT doc_id AS c, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, s: xor(c >> 8, v[((xor(c, s) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps),
d AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents LEFT JOIN crcs ON c = doc_id),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::BIGINT]) END AS ws FROM p),
e AS (SELECT doc_id, ws, unnest(range(len(ws) - 7)) AS i FROM t),
k AS (SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i + 1 : i + 8], ' ') AS gram FROM e),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM q),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 8 + q AS l FROM isles GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretch WHERE l >= greatest(24, 3 * q) GROUP BY doc_id, s, l),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::HUGEINT * 1000000000000 // q DESC, s, q) AS place FROM runs) WHERE place = 1),
facts AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t SEMI JOIN runs USING (doc_id)),
rest AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM t LEFT JOIN facts USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
