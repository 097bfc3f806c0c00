"""Removal of byte strings that a smaller document holds too, by a logarithmic family of suffix arrays.

Within each shard of fragments (see ``fragments``) documents come in batches, in the order of ids. A batch
gets a suffix array: its suffixes of ``width`` bytes or more, sorted by their first ``width`` bytes. It is merge-scanned against
each level there is for matches of ``width`` bytes, then joins the levels: as long as the last level is no larger than the new
one, the two merge. So a suffix is merged a logarithmic number of times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyloom.llm.fragments import Unit, removed_spans


class SuffixLevels:
    """Levels of sorted suffixes, each with the smallest document that holds it."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def owners(self, keys: np.ndarray) -> np.ndarray:
        """The smallest document that a level has each sorted suffix from; the largest number if none has it."""
        found = np.full(len(keys), np.iinfo(np.int64).max)
        for level, docs in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            found[hit] = np.minimum(found[hit], docs[at[hit]])
        return found

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Take in sorted suffixes that no level has as a level, and merge levels of like size."""
        if not len(keys):
            return
        while self.levels and len(self.levels[-1][0]) <= len(keys):
            level, owners = self.levels.pop()
            at = np.searchsorted(keys, level)
            keys, docs = np.insert(keys, at, level), np.insert(docs, at, owners)
        self.levels.append((keys, docs))


def suffixes(fragments: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of at least ``width`` bytes, cut to ``width``, and the number of the fragment of each."""
    data = np.frombuffer(b"".join(fragments), np.uint8)
    sizes = np.asarray([len(f) for f in fragments])
    count = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(fragments)), count)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    view = np.lib.stride_tricks.sliding_window_view(data, width)[at] if len(at) else np.zeros((0, width), np.uint8)
    return np.ascontiguousarray(view).view(f"S{width}").ravel(), owner


def levels_engine(width: int, batch: int = 16384):
    """Windows of a shard's fragments that a smaller document holds. ``batch``: suffixes of a batch, about."""

    def judge(fragments: list[bytes], first: np.ndarray) -> list[np.ndarray]:
        index = SuffixLevels(width)
        sizes = np.cumsum([max(0, len(f) - width + 1) for f in fragments])
        masks: list[np.ndarray] = []
        begin = 0
        while begin < len(fragments):
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + batch, "right")))
            keys, owner = suffixes(fragments[begin:end], width)
            docs = first[begin:end][owner]
            order = np.lexsort((docs, keys))
            sorted_keys, sorted_docs = keys[order], docs[order]
            new = np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(keys) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            least = np.repeat(sorted_docs[start], np.diff(np.append(start, len(keys))))
            have = index.owners(sorted_keys[start])
            known = np.repeat(have, np.diff(np.append(start, len(keys))))
            hit = np.empty(len(keys), bool)
            hit[order] = np.minimum(known, least) < sorted_docs
            masks += np.split(hit, np.searchsorted(owner, np.arange(1, end - begin)))
            fresh = start[have == np.iinfo(np.int64).max]
            index.add(sorted_keys[fresh], sorted_docs[fresh])
            begin = end
        return masks

    return judge


def remove_repeated_bytes(docs: DataFrame, width: int = 50, gram: int = 24, text: str = "text", id_column: str = "doc_id", **more) -> DataFrame:
    """Rows of ``docs`` with the bytes left (``__kept``) and the removed spans; see ``fragments.removed_spans``.

    A byte goes if a string of ``width`` bytes around it also starts in a document with a smaller id. Null or empty texts
    lose nothing, rows with a null id take no part.
    """
    return removed_spans(docs, Unit(False, width, gram), levels_engine(width), text, id_column, **more)


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, b[i : i + 49] AS piece FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY piece) AS first FROM g) WHERE first < doc_id),
edge AS (SELECT *, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY r), 1) AS a, a AS z FROM span UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id),
rest AS (SELECT gap.doc_id, string_agg(hex(b[a : coalesce(z - 1, octet_length(b))]), '' ORDER BY a) AS kept FROM gap JOIN d USING (doc_id) WHERE a < coalesce(z, octet_length(b) + 1) GROUP BY gap.doc_id),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM span GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
