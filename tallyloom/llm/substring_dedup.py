"""Removal of passages of at least ``width`` words that a smaller document holds too, by suffix automata.

The reference of a document is every smaller document. No automaton of the whole corpus fits a machine, and sending each shard
of one past every document would cost documents times shards. So reference shards hold fragments that
share an anchor (see ``fragments``), and a document's fragments are streamed through the automaton of their own shard only.
Each shard's automaton grows in the order of ids, so that what it holds when a document is streamed is the smaller documents.
A reference given by the caller, such as a benchmark, can be broadcast as automata of bounded shards: ``against_reference``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.fragments import Unit, removed_spans


class SuffixAutomaton:
    """Suffix automaton over any hashable symbols; several sequences may be added."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, symbols) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            known = nxt[last].get(c)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                    continue
                last = self._clone(last, known, c)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matching(self, symbols) -> list[int]:
        """Length of the longest known sequence that ends at each symbol."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in symbols:
            to = nxt[state].get(c)
            while to is None and state > 0:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state = to
                size += 1
            out.append(size)
        return out


def automaton_engine(width: int):
    """Windows of a shard's fragments that a smaller document holds, by matching statistics."""

    def judge(fragments: list[bytes], first: np.ndarray) -> list[np.ndarray]:
        automaton = SuffixAutomaton()
        masks: list[np.ndarray] = []
        begin = 0
        while begin < len(fragments):
            end = int(np.searchsorted(first, first[begin], "right"))
            fresh = []
            for fragment in fragments[begin:end]:
                words = fragment.split(b" ")
                known = [size >= width for size in automaton.matching(words)[width - 1 :]]
                masks.append(np.asarray(known, bool))
                if not any(known):
                    fresh.append(words)
                elif not all(known):
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], known, [1]])))
                    fresh += [words[s : e + width - 1] for s, e in edge.reshape(-1, 2)]
            for words in fresh:
                automaton.add(words)
            begin = end
        return masks

    return judge


def remove_repeats(docs: DataFrame, width: int = 13, gram: int = 5, text: str = "text", id_column: str = "doc_id", **more) -> DataFrame:
    """Rows of ``docs`` with the words left (``__kept``) and the removed spans; see ``fragments.removed_spans``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``width`` words around it also starts in a document
    with a smaller id. Null or empty texts lose nothing, rows with a null id take no part.
    """
    return removed_spans(docs, Unit(True, width, gram), automaton_engine(width), text, id_column, **more)


def against_reference(docs: DataFrame, reference: DataFrame, width: int = 13, text: str = "text", reference_text: str = "text", max_reference_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``docs`` with ``removed_spans`` (word ranges also found in ``reference``), by a broadcast automaton.

    ``reference`` is a small stated set, such as benchmark items; one of more than ``max_reference_bytes``
    raises an error: use ``remove_repeats`` over the union instead.
    """
    size = reference.agg(F.coalesce(F.sum(F.octet_length(reference_text)), F.lit(0)).alias("n")).first()["n"]
    if size > max_reference_bytes:
        raise ValueError(f"the reference has {size} bytes; at most {max_reference_bytes} are broadcast")
    automaton = SuffixAutomaton()
    for row in reference.select(reference_text).dropna().toLocalIterator():
        automaton.add(row[0].encode().split())
    shared = docs.sparkSession.sparkContext.broadcast((automaton.next, automaton.link, automaton.length))

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        known = SuffixAutomaton()
        known.next, known.link, known.length = shared.value
        out = []
        for value in texts:
            words = value.encode().split() if value else []
            found = np.zeros(len(words) + 1, np.int64)
            for i, length in enumerate(known.matching(words)):
                if length >= width:
                    found[i - width + 1] += 1
                    found[i + 1] -= 1
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(found[:-1]) > 0).view(np.int8), [0]])))
            out.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        return pd.Series(out)

    return docs.withColumn("removed_spans", spans(F.col(text)))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(13)) AS k)),
lost AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed, CASE WHEN places IS NULL THEN array_to_string(ws, ' ') END AS whole FROM d LEFT JOIN lost USING (doc_id)),
rest AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT d.doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d JOIN lost USING (doc_id)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(whole, kept, '')) AS kept_sha256 FROM k LEFT JOIN rest USING (doc_id)
"""
