"""Repeats of fixed length across documents, by fragments that share an anchor.

A window is ``width`` consecutive symbols (words or bytes). Its anchor is the smallest hash among the
``gram``-symbol runs inside it, so equal windows have equal anchors, and an anchor that
occurs in one document only rules all its windows out. The steps:

1. Documents are dealt to parts by a hash, packed and compressed. Each part sends its distinct anchors, as packed hashes, to buckets
   that find those of two or more documents and tell every part which of its own are shared.
2. Each part cuts its texts into fragments: runs of windows with one shared anchor. It tells the shard of the anchor that it
   has the fragment, by a hash, and its smallest document with it. Where more than ``hot`` documents share an anchor, each window is a
   fragment of its own, dealt by its own hash, so a passage that a third of all documents hold is spread over all shards.
3. Where an anchor has several distinct fragments, its shard asks for the text of each once, from the part with the smallest document. Copies
   cost no text, and an anchor with one distinct fragment has nothing to compare: its later documents hold copies.
4. Each shard compares the distinct fragments by an engine (a suffix automaton, suffix arrays) on their true symbols, and tells the parts
   which fragments all their documents lose, and which windows of others the smallest one loses.

Text is shuffled once: all four uses read the same exchange. Anchors take six bytes each, and no bucket or shard hears of
an anchor or fragment more often than there are parts. All sizes follow from the bytes of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import grams

PART, KEEP = "__part", "__spans"
SHORT = np.uint64((1 << 48) - 1)
SINGLE = np.uint64(1 << 63)


@dataclass(frozen=True)
class Unit:
    """What a symbol is and how long a repeat must be. ``gram``: symbols of an anchor."""

    words: bool
    width: int
    gram: int


@dataclass
class Text:
    """Some documents as symbols: ``prefix`` hash sums, ``first`` symbol of each row, ``data`` with symbol bounds."""

    prefix: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    raw_starts: np.ndarray
    raw_ends: np.ndarray

    @classmethod
    def of(cls, column, unit: Unit) -> Text:
        data, offsets = grams.utf8(column)
        if not unit.words:
            at = np.arange(len(data) + 1)
            return cls(grams.prefix_hash(data.astype(np.uint64) + np.uint64(1)), offsets, data, at[:-1], at[1:], data, at[:-1], offsets[1:])
        starts, ends, first = grams.word_bounds(data, offsets)
        hashes = grams.content_hash(data, starts, ends)
        # One space after each word, wherever the text has any white space.
        space = grams.SPACE[data]
        keep = ~space
        after = ends[ends < len(data)]
        keep[after[space[after]]] = True
        place = np.cumsum(keep) - 1
        plain = np.where(space, np.uint8(32), data)[keep]
        begin = place[starts] if len(starts) else starts
        return cls(grams.prefix_hash(hashes), first, plain, begin, begin + ends - starts, data, starts, offsets[1:])

    def windows(self, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor inside one row: first window, number of windows, anchor."""
        n = len(self.prefix) - 1
        none = np.zeros(0, np.int64)
        if n < unit.width:
            return none, none, none.astype(np.uint64)
        least = grams.sliding_min(grams.rolling(self.prefix, unit.gram), unit.width - unit.gram + 1)
        valid = np.ones(len(least), bool)
        for i in range(1, unit.width):
            bad = self.first[1:-1] - i
            valid[bad[(bad >= 0) & (bad < len(valid))]] = False
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(change & valid)
        stop = change | ~valid
        bounds = np.append(np.flatnonzero(stop), len(least))
        return begin, bounds[np.searchsorted(bounds, begin, "right")] - begin, grams.mix(least[begin])

    def fragments(self, begin: np.ndarray, count: np.ndarray, unit: Unit) -> pa.Array:
        end = self.ends[begin + count + unit.width - 2]
        return grams.gather(self.data, self.starts[begin], end - self.starts[begin])

    def hashes(self, begin: np.ndarray, count: np.ndarray, unit: Unit) -> np.ndarray:
        """Hash of the true symbols of each run of windows."""
        return grams.content_hash(self.data, self.starts[begin], self.ends[begin + count + unit.width - 2])

    def spots(self, begin: np.ndarray, unit: Unit) -> np.ndarray:
        """A cheap hash of single windows, which deals them and finds candidates; the highest bit tells it from an anchor."""
        return grams.span_hash(self.prefix, begin, begin + unit.width) | SINGLE


def each_window(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All windows of runs, one by one."""
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def packed(groups: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each group number its values, in order of the groups."""
    if not len(groups):
        return
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    cut = np.flatnonzero(np.diff(groups)) + 1
    parts = [np.split(v[order], cut) for v in values]
    for i, g in enumerate(groups[np.append(0, cut)]):
        yield int(g), [p[i] for p in parts]


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes; a zstandard frame each, behind its sizes."""
    codec = pa.Codec("zstd")
    out = []
    for c in columns:
        body = codec.compress(np.ascontiguousarray(c).tobytes(), asbytes=True) if len(c) else b""
        out.append(np.array([c.nbytes, len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd"), 0, []
    for kind in kinds:
        size, length = np.frombuffer(blob, np.int64, 2, at)
        at += 16
        out.append(np.frombuffer(codec.decompress(blob[at : at + length], int(size), asbytes=True), kind) if size else np.zeros(0, kind))
        at += length
    return out


def unsqueezed(blobs: list[bytes], *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """All columns of several blobs, and the number of the blob of each row."""
    parts = [unsqueeze(b, *kinds) for b in blobs]
    sizes = [len(p[0]) for p in parts]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)], np.repeat(np.arange(len(parts)), sizes)


def short(hashes: np.ndarray) -> np.ndarray:
    """The low six bytes of hashes, a byte table."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6]


def wide(table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(table) // 6, 8), np.uint8)
    out[:, :6] = table.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _pack(batches):
    """Rows of each part as one compressed stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.asarray(batch.column(PART))
        order = np.argsort(part, kind="stable")
        ordered = pa.Table.from_batches([batch]).take(pa.array(order))
        cut = np.flatnonzero(np.diff(part[order])) + 1
        bounds = [0, *cut.tolist(), len(part)]
        for a, b in zip(bounds, bounds[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ordered.schema, options=options) as writer:
                writer.write_table(ordered.slice(a, b - a).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([int(part[order[a]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [PART, "docs"])


def _unpack(blobs) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs])


def anchors_of(parts: np.ndarray, docs: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of each part with the number of its documents that hold them (255 at most)."""
    order = np.lexsort((docs, anchors, parts))
    p, d, a = parts[order], docs[order], anchors[order]
    same = np.zeros(len(p), bool)
    same[1:] = (p[1:] == p[:-1]) & (a[1:] == a[:-1])
    fresh = ~same
    fresh[1:] |= d[1:] != d[:-1]
    start = np.flatnonzero(~same)
    seen = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else start
    return p[start], a[start], np.minimum(seen, 255).astype(np.uint8)


@dataclass(frozen=True)
class Plan:
    """What every step needs to know."""

    unit: Unit
    text: str
    id_column: str
    buckets: int
    shards: int
    hot: int
    joined: bool
    schema: pa.Schema

    def send_anchors(self, batches):
        def flush(blobs):
            for piece in grams.slices(_unpack(blobs), self.text):
                body = Text.of(piece.column(self.text), self.unit)
                begin, _, anchor = body.windows(self.unit)
                row = grams.rows_of(body.first, begin)
                use = ~np.asarray(piece.column(self.id_column).is_null())[row]
                row, anchor = row[use], anchor[use]
                part, anchor, seen = anchors_of(np.asarray(piece.column(PART))[row].astype(np.int64), row, anchor)
                bucket = (anchor % np.uint64(self.buckets)).astype(np.int64)
                rows = [(g // self.buckets, g % self.buckets, squeeze(short(a).ravel(), n)) for g, (a, n) in packed(part * self.buckets + bucket, anchor, seen)]
                yield from _rows(rows, [PART, "bucket", "anchors"], [pa.int32(), pa.int32(), pa.binary()]).to_batches()

        blobs, size = [], 0
        for batch in batches:
            for blob in batch.column("docs"):
                blobs.append(blob)
                size += len(blob.as_buffer())
                if size > 1 << 20:
                    yield from flush(blobs)
                    blobs, size = [], 0
        if blobs:
            yield from flush(blobs)

    def shared_anchors(self, table: pa.Table) -> pa.Table:
        pairs = [unsqueeze(b, np.uint8, np.uint8) for b in table.column("anchors").to_pylist()]
        anchors = np.concatenate([wide(a) for a, _ in pairs])
        seen = np.concatenate([n for _, n in pairs]).astype(np.int64)
        part = np.repeat(np.asarray(table.column(PART)), [len(n) for _, n in pairs])
        order = np.argsort(anchors, kind="stable")
        anchors, part = anchors[order], part[order]
        start = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        total = np.repeat(np.add.reduceat(seen[order], start), np.diff(np.append(start, len(anchors))))
        shared = total > 1
        rows = [(g, squeeze(short(a).ravel(), h)) for g, (a, h) in packed(part[shared], anchors[shared], (total[shared] > self.hot).astype(np.uint8))]
        return _rows(rows, [PART, "shared"], [pa.int32(), pa.binary()])

    def _pieces(self, docs: pa.Table):
        return grams.slices(_unpack(docs.column("docs")), self.text)

    def _ids(self, piece: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = piece.column(self.id_column).combine_chunks()
        return ~np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))

    def send_fragments(self, docs: pa.Table, shared: pa.Table) -> pa.Table:
        names, kinds = ["shard", PART, "known"], [pa.int32(), pa.int32(), pa.binary()]
        pairs = [unsqueeze(b, np.uint8, np.uint8) for b in shared.column("shared").to_pylist()]
        if not pairs or not docs.num_rows:
            return _rows([], names, kinds)
        known = np.concatenate([wide(a) for a, _ in pairs])
        is_hot = np.concatenate([h for _, h in pairs]).astype(bool)
        order = np.argsort(known)
        known, is_hot = known[order], is_hot[order]
        found = []
        for piece in self._pieces(docs):
            body = Text.of(piece.column(self.text), self.unit)
            begin, count, anchor = body.windows(self.unit)
            anchor = anchor & SHORT
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            use = known[at] == anchor
            heat = is_hot[at] & use
            use &= ~heat
            # A window of a hot anchor goes by its own hash.
            single = each_window(begin[heat], count[heat])
            alone = body.hashes(single, np.ones(len(single), np.int64), self.unit)
            key = np.concatenate([body.hashes(begin[use], count[use], self.unit), alone])
            spot = np.concatenate([anchor[use], body.spots(single, self.unit)])
            named, value = self._ids(piece)
            row = grams.rows_of(body.first, np.concatenate([begin[use], single]))
            ok = named[row]
            found.append((key[ok], spot[ok], value[row][ok]))
        key, spot, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, spot, key))
        key, spot, doc = key[order], spot[order], doc[order]
        one = np.append(True, (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])) if len(key) else np.zeros(0, bool)
        key, spot, doc = key[one], spot[one], doc[one]
        part = docs.column(PART)[0].as_py()
        rows = [(g, part, squeeze(s, k, d)) for g, (s, k, d) in packed((spot % np.uint64(self.shards)).astype(np.int64), spot, key, doc)]
        return _rows(rows, names, kinds)

    @staticmethod
    def _heard(table: pa.Table):
        """What a shard was told: spot, key, smallest document and part of each fragment, in order; then where each distinct one begins."""
        (spot, key, low), blob = unsqueezed(table.column("known").to_pylist(), np.uint64, np.uint64, np.int64)
        part = np.asarray(table.column(PART))[blob]
        order = np.lexsort((part, low, key, spot))
        spot, key, low, part = spot[order], key[order], low[order], part[order]
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (spot[1:] != spot[:-1]))) if len(key) else np.zeros(0, np.int64)
        return spot, key, low, part, start

    @staticmethod
    def _several(spot: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which distinct fragments share their anchor with others; single windows of different hash differ."""
        s = spot[start]
        same = (s[1:] == s[:-1]) & (s[1:] < SINGLE)
        out = np.zeros(len(s), bool)
        out[1:] |= same
        out[:-1] |= same
        return out

    def ask(self, table: pa.Table) -> pa.Table:
        """The part with the smallest document is asked for a fragment's text."""
        spot, key, low, part, start = self._heard(table)
        start = start[self._several(spot, start)]
        shard = table.column("shard")[0].as_py()
        rows = [(g, shard, squeeze(k, d)) for g, (k, d) in packed(part[start], key[start], low[start])]
        return _rows(rows, [PART, "shard", "asked"], [pa.int32(), pa.int32(), pa.binary()])

    def answer(self, docs: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["shard", "keys", "ends", "fragments"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        if not asked.num_rows or not docs.num_rows:
            return _rows([], names, kinds)
        (key, low), blob = unsqueezed(asked.column("asked").to_pylist(), np.uint64, np.int64)
        shard = np.asarray(asked.column("shard"))[blob]
        order = np.argsort(key, kind="stable")
        key, shard = key[order], shard[order]
        missing = np.ones(len(key), bool)
        owners = pa.array(np.unique(low))
        found = []
        for piece in self._pieces(docs):
            piece = piece.filter(pc.is_in(piece.column(self.id_column), value_set=owners))
            body = Text.of(piece.column(self.text), self.unit)
            begin, count, _ = body.windows(self.unit)
            have = body.hashes(begin, count, self.unit)
            use = np.flatnonzero(isin(have, key))
            first, place = np.unique(have[use], return_index=True)
            if not len(first):
                continue
            # One key may be asked for by several shards.
            at = np.minimum(np.searchsorted(first, key), len(first) - 1)
            hit = np.flatnonzero((first[at] == key) & missing)
            missing[hit] = False
            take = use[place[at[hit]]]
            found.append((hit, *grams.utf8(body.fragments(begin[take], count[take], self.unit))))
        rows: dict[int, list] = {}
        for hit, data, ends in found:
            size = np.diff(ends)
            for g, (i, a, n) in packed(shard[hit], hit, ends[:-1], size):
                body = data[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                rows.setdefault(g, []).append((key[i], n, body))
        out = []
        for g, parts in rows.items():
            keys, sizes, bodies = (np.concatenate(x) for x in zip(*parts))
            out.append((g, squeeze(keys), squeeze(np.cumsum(sizes)), squeeze(bodies)))
        return _rows(out, names, kinds)

    def judge(self, engine: Callable) -> Callable:
        def run(told: pa.Table, texts: pa.Table) -> pa.Table:
            names, kinds = [PART, "lost", "alone", "shared", "some", "masks"], [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.binary())]
            if not told.num_rows:
                return _rows([], names, kinds)
            spot, key, low, part, start = self._heard(told)
            # A window of a hot anchor is dealt by its own hash.
            alone = spot >= SINGLE
            text_of = {}
            for keys, ends, body in zip(*(texts.column(c).to_pylist() for c in ("keys", "ends", "fragments"))):
                (keys,), (ends,), (body,) = unsqueeze(keys, np.uint64), unsqueeze(ends, np.int64), unsqueeze(body, np.uint8)
                body = body.tobytes()
                at = 0
                for k, end in zip(keys.tolist(), ends.tolist()):
                    text_of[k] = body[at:end]
                    at = end
            first = low[start]
            several = np.flatnonzero(self._several(spot, start))
            distinct = [text_of[k] for k in key[start[several]].tolist()]
            order = sorted(range(len(distinct)), key=lambda i: (first[several[i]], distinct[i]))
            masks = engine([distinct[i] for i in order], first[several[order]])
            order = several[order].tolist()
            rows: dict[int, tuple] = {}
            sizes = np.diff(np.append(start, len(key)))
            later = low > np.repeat(first, sizes)
            for g, (k, s, out, h) in packed(part, key, spot, later, alone):
                if out.any() or h.any():
                    rows[g] = (k[out & ~h], np.concatenate([k[out & h], s[out & h]]), np.concatenate([k[~out & h], s[~out & h]]), [], [])
            none = np.zeros(0, np.uint64)
            for i, mask in zip(order, masks):
                if mask.any():
                    # The parts that hold the smallest document; rows of one id may lie in several.
                    for j in range(start[i], start[i] + sizes[i]):
                        if low[j] == first[i]:
                            some, bits = rows.setdefault(int(part[j]), (none, none, none, [], []))[3:]
                            some.append(int(key[j]))
                            bits.append(np.packbits(mask).tobytes())
            return _rows([(g, *map(squeeze, v[:3]), squeeze(np.asarray(v[3], np.uint64)), v[4]) for g, v in rows.items()], names, kinds)

        return run

    def mark(self, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        """Adds to each row what is left, the spans it loses, and the number of symbols it has and loses."""
        if not docs.num_rows:
            return self.schema.empty_table()
        lost, some = (unsqueezed(verdicts.column(c).to_pylist(), np.uint64)[0][0] for c in ("lost", "some"))
        # Single windows: their hashes, then their spots.
        (alone, alone_spots), (together, together_spots) = (
            [np.concatenate(x) for x in zip(np.zeros((2, 0), np.uint64), *(np.split(unsqueeze(b, np.uint64)[0], 2) for b in verdicts.column(c).to_pylist()))] for c in ("alone", "shared")
        )
        spots = np.unique(np.concatenate([alone_spots, together_spots]))
        bits = [b for masks in verdicts.column("masks").to_pylist() for b in masks]
        lost, alone, together = np.unique(lost), np.unique(alone), np.unique(together)
        mask_of: dict[int, list[bytes]] = {}
        for k, b in zip(some.tolist(), bits):
            mask_of.setdefault(k, []).append(b)
        some = np.unique(some)
        pieces = []
        for piece in self._pieces(docs):
            body = Text.of(piece.column(self.text), self.unit)
            begin, count, _ = body.windows(self.unit)
            named, value = self._ids(piece)
            use = named[grams.rows_of(body.first, begin)]
            pieces.append((piece, body, value, begin[use], count[use], body.hashes(begin[use], count[use], self.unit)))

        def later(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
            """Marks keys that a smaller document of this part has as well."""
            key, doc = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, key))
            start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
            least = np.repeat(doc[order][start], np.diff(np.append(start, len(key))))
            out = np.empty(len(key), bool)
            out[order] = doc[order] > least
            return np.split(out, np.cumsum([len(k) for k, _ in parts])[:-1])

        doc_of = lambda body, value, at: value[grams.rows_of(body.first, at)]
        again = later([(key, doc_of(body, value, begin)) for _, body, value, begin, _, key in pieces])
        singles = []
        if len(alone) or len(together):
            for _, body, value, begin, count, _ in pieces:
                at = each_window(begin, count)
                at = at[isin(body.spots(at, self.unit), spots)]
                key = body.hashes(at, np.ones(len(at), np.int64), self.unit)
                use = isin(key, together)
                singles.append((at[isin(key, alone)], at[use], key[use], doc_of(body, value, at[use])))
            single_again = later([x[2:] for x in singles])
        out = []
        width = self.unit.width
        for n, (piece, body, value, begin, count, key) in enumerate(pieces):
            gone = np.zeros(len(body.prefix), np.int32)

            def cover(begin, count):
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + count + width - 1, -1)

            out_of = again[n] | isin(key, lost)
            cover(begin[out_of], count[out_of])
            for i in np.flatnonzero(~out_of & isin(key, np.unique(some))) if len(some) else []:
                for b in mask_of[int(key[i])]:
                    place = begin[i] + np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=int(count[i])))
                    cover(place, np.ones(len(place), np.int64))
            if singles:
                place = np.concatenate([singles[n][0], singles[n][1][single_again[n]]])
                cover(place, np.ones(len(place), np.int64))
            out.append(self._finish(piece, body, np.cumsum(gone[:-1]) > 0))
        return pa.concat_tables(out).cast(self.schema)

    def _finish(self, piece: pa.Table, body: Text, lost: np.ndarray) -> pa.Table:
        total = np.diff(body.first)
        sums = np.append(0, np.cumsum(lost))
        removed = sums[body.first[1:]] - sums[body.first[:-1]]
        kept, spans = [], []
        for row in range(len(total)):
            a, b = int(body.first[row]), int(body.first[row + 1])
            if not removed[row] and self.joined:
                kept.append(body.data[body.starts[a] : body.ends[b - 1]].tobytes() if b > a else b"")
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lost[a:b].view(np.int8), [0]])))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            stay = np.concatenate([[0], edge, [b - a]]).reshape(-1, 2) + a
            if self.joined:
                parts = [body.data[body.starts[s] : body.ends[e - 1]].tobytes() for s, e in stay if e > s]
            else:
                parts = [body.raw[body.raw_starts[s] : body.raw_starts[e] if e < b else body.raw_ends[row]].tobytes() for s, e in stay if e > s]
            kept.append((b" " if self.unit.words and self.joined else b"").join(parts))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        table = piece.drop_columns([PART])
        for name, values, kind in (("__kept", kept, pa.binary()), (KEEP, spans, span), ("__total", total, pa.int64()), ("__removed", removed, pa.int64())):
            table = table.append_column(name, pa.array(values, kind))
        return table


def isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted ``known``; a table of their upper bits spares most look-ups."""
    out = np.zeros(len(values), bool)
    if not len(known) or not len(values):
        return out
    bits = np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[known >> bits] = True
    at = np.flatnonzero(table[values >> bits])
    some = values[at]
    out[at] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
    return out


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def removed_spans(docs: DataFrame, unit: Unit, engine: Callable, text: str = "text", id_column: str = "doc_id", part_bytes: int = 1 << 21, hot: int = 1000, joined: bool = True) -> DataFrame:
    """Rows of ``docs`` with ``__kept`` (the bytes that stay; words joined by one space), ``__spans`` (removed
    runs, counted in symbols), ``__total`` and ``__removed`` symbols.

    ``engine(fragments, first)`` gets a shard's distinct fragments in ascending order of the smallest document
    that holds each, and tells for each of its windows if a smaller document holds it too. Rows with a null id neither lose nor cause
    a loss; a null text has no symbols; rows with one id count as one document. ``part_bytes``: text dealt to one part.
    With ``joined`` words are joined by one space, else the white space after each kept word stays. Columns of ``docs`` named like a result are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, docs = docs.sparkSession, docs.drop("__kept", KEEP, "__total", "__removed", PART)
    size = text_bytes(docs, text)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (32 << 20))
    parts = max(1, size // part_bytes)
    dealt = docs.withColumn(PART, F.pmod(F.xxhash64(F.col(id_column), F.col(text)), F.lit(parts)).cast("int")).withColumn(id_column, F.col(id_column).cast("long"))
    span = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
    more = [("__kept", T.BinaryType()), (KEEP, span), ("__total", T.LongType()), ("__removed", T.LongType())]
    result = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema.fields if f.name != PART] + [T.StructField(*m) for m in more])
    plan = Plan(unit, text, id_column, tasks, tasks, hot, joined, to_arrow_schema(result))
    dealt = dealt.mapInArrow(_pack, f"{PART} int, docs binary").repartition(tasks, PART)
    sent = dealt.mapInArrow(plan.send_anchors, f"{PART} int, bucket int, anchors binary")
    shared = sent.groupBy("bucket").applyInArrow(lambda t: plan.shared_anchors(t), f"{PART} int, shared binary")
    told = dealt.groupBy(PART).cogroup(shared.groupBy(PART)).applyInArrow(lambda d, t: plan.send_fragments(d, t), f"shard int, {PART} int, known binary")
    asked = told.groupBy("shard").applyInArrow(lambda t: plan.ask(t), f"{PART} int, shard int, asked binary")
    texts = dealt.groupBy(PART).cogroup(asked.groupBy(PART)).applyInArrow(lambda d, t: plan.answer(d, t), "shard int, keys binary, ends binary, fragments binary")
    verdicts = told.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(plan.judge(engine), f"{PART} int, lost binary, alone binary, shared binary, some binary, masks array<binary>")
    return dealt.groupBy(PART).cogroup(verdicts.groupBy(PART)).applyInArrow(lambda d, t: plan.mark(d, t), result)
