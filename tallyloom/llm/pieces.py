"""SentencePiece encoding and decoding by a forward pass that words with one prefix share.

Text is marked (spaces become U+2581, one goes before the text) and cut into words where no piece can reach across: before each run of
marks and around characters that only stand alone. The distinct words of a batch are sorted, which is a depth-first walk through their trie: a word
takes over the forward states of the prefix that it shares with the word before, and only the rest is computed.

* Unigram models: the state of a prefix is the best score and the piece it ends with (Viterbi).
* BPE models have no sum of scores to maximise: their result is the one that merging by rank gives. It is the only segmentation whose neighbours
  stand side by side when their two strings are merged alone, and so is each of its prefixes. So the state of a prefix is the piece it ends with, and the
  one survivor at each character is found by testing neighbours. Words with pieces of equal score are merged directly.

Nothing is shuffled: a batch has its own words, and each Python worker remembers a bounded number of words. The model's file is read on the driver and broadcast.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import grams

MARK = "▁"
#: Fixed value: what an unknown character costs in a unigram model below the worst piece.
UNKNOWN_PENALTY = 10.0
MAX_MODEL_BYTES = 32 << 20


class Pieces:
    """A SentencePiece model: its pieces and how a marked word is cut into them."""

    def __init__(self, proto: bytes, remembered: int = 300_000) -> None:
        from sentencepiece import sentencepiece_model_pb2

        if len(proto) > MAX_MODEL_BYTES:
            raise ValueError(f"the model has {len(proto)} bytes; at most {MAX_MODEL_BYTES} are broadcast")
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        kind = sentencepiece_model_pb2.TrainerSpec.ModelType
        if model.trainer_spec.model_type not in (kind.UNIGRAM, kind.BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.proto = proto
        self.bpe = model.trainer_spec.model_type == kind.BPE
        self.spec = model.normalizer_spec
        types = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type == types.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined pieces and marks behind words are not supported")
        self.surface = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.kinds = types
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == types.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == types.NORMAL}
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == types.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == types.UNKNOWN)
        self.worst = min(self.score.values()) - UNKNOWN_PENALTY
        count = Counter(s for p, s in self.score.items() if len(p) > 1)
        tied = [p for p, s in self.score.items() if len(p) > 1 and count[s] > 1]
        #: Words that hold one of these are merged directly.
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied and self.bpe else None
        #: Lengths of pieces by their last two characters, longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for piece in sorted(self.id_of, key=len, reverse=True):
            if len(piece) > 1 and (not self.bpe or self.merged(piece) == [piece]):
                have = self.lengths.get(piece[-2:], ())
                if len(piece) not in have:
                    self.lengths[piece[-2:]] = (*have, len(piece))
        #: Characters that stand in no piece of two or more.
        joined = set("".join(p for p in self.id_of if len(p) > 1))
        self.breaks = np.array([chr(i) not in joined for i in range(128)] + [False] * 128)
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.remembered = remembered
        self.memory: dict[bytes, bytes] = {}
        self.side_by_side: dict[tuple[str, str], bool] = {}

    # -- merging by rank -------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Characters joined pair by pair, the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        known = self.side_by_side.get((left, right))
        if known is None:
            if len(self.side_by_side) > 300_000:
                self.side_by_side.clear()
            known = self.side_by_side[left, right] = self.merged(left + right) == [left, right]
        return known

    # -- the walk --------------------------------------------------------------------------------------------------

    def walk(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of some sorted words; states of a shared prefix are used again."""
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        for word in words:
            if self.tied and self.tied.search(word):
                yield self.merged(word)
                continue
            keep = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], best[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                if self.bpe:
                    self._next_piece(word, end, last)
                else:
                    self._next_score(word, end, last, best)
            before = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            out.reverse()
            yield out

    def _next_piece(self, word: str, end: int, last: list[str]) -> None:
        for size in self.lengths.get(word[end - 2 : end], ()) if end > 1 else ():
            if size > end:
                continue
            piece = word[end - size : end]
            if piece in self.score and (size == end or self._fits(last[end - size], piece)):
                last.append(piece)
                return
        # One of the prefix's pieces fits always, so the character itself is what is left.
        last.append(word[end - 1])

    def _next_score(self, word: str, end: int, last: list[str], best: list[float]) -> None:
        choice = word[end - 1]
        top = best[end - 1] + self.score.get(choice, self.worst)
        for size in reversed(self.lengths.get(word[end - 2 : end], ())) if end > 1 else ():
            if size <= end:
                piece = word[end - size : end]
                s = self.score.get(piece)
                # Of equal scores the longest piece wins.
                if s is not None and best[end - size] + s >= top:
                    top, choice = best[end - size] + s, piece
        last.append(choice)
        best.append(top)

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes_id:
                out += [self.bytes_id[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    # -- batches ---------------------------------------------------------------------------------------------------

    def _normal(self, texts: pa.Array) -> pa.Array:
        """Texts with marks for spaces and before the text."""
        texts = texts.fill_null("")
        if self.spec.precompiled_charsmap or self.spec.remove_extra_whitespaces:
            done = pa.array([self._processor.normalize(t) for t in texts.to_pylist()], pa.string())
            return pc.replace_substring(done, " ", MARK)
        marked = pc.replace_substring(texts, " ", MARK)
        if self.spec.add_dummy_prefix:
            marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, marked, ""))
        return marked

    @cached_property
    def _processor(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.proto)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Marked words of all texts, end to end, and the number of the first word of each text, with the end."""
        data, offsets = grams.utf8(self._normal(texts))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.cuts_at_marks and len(data) > 2:
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            cut[mark[np.append(True, np.diff(mark) != 3)]] = True if len(mark) else False
            alone = np.flatnonzero(self.breaks[data])
            cut[alone] = True
            cut[alone + 1] = True
        at = np.flatnonzero(cut)
        at = at if len(data) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.searchsorted(at, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's begin, with the end."""
        words, first = self.words(texts)
        coded = words.dictionary_encode()
        code = np.asarray(coded.indices)
        distinct = coded.dictionary.to_pylist()
        found: list[bytes | None] = [self.memory.get(w) for w in distinct]
        fresh = sorted((w.decode(), i) for i, w in enumerate(distinct) if found[i] is None)
        for (word, i), pieces in zip(fresh, self.walk([w for w, _ in fresh])):
            found[i] = array("i", self.ids(pieces)).tobytes()
            if len(self.memory) < self.remembered:
                self.memory[distinct[i]] = found[i]
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.int32)
        begin = np.cumsum(sizes) - sizes
        count = sizes[code] if len(code) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(count))
        ids = flat[np.repeat(begin[code] - total[:-1], count) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.int32)
        bounds = total[first]
        if not self.bytes_id and len(ids):
            # Neighbouring unknown characters are one piece.
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            keep[bounds[:-1][bounds[:-1] < len(ids)]] = True
            bounds = np.append(0, np.cumsum(keep))[bounds]
            ids = ids[keep]
        return ids, bounds

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        body = []
        for piece, kind in zip(self.surface, self.types):
            if kind == self.kinds.BYTE:
                body.append(bytes([int(piece[3:5], 16)]))
            elif kind == self.kinds.UNKNOWN:
                body.append(" ⁇ ".encode())
            else:
                body.append(b"" if kind == self.kinds.CONTROL else piece.replace(MARK, " ").encode())
        sizes = np.array([len(b) for b in body], np.int64)
        return np.frombuffer(b"".join(body), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD."""
        data, begin, sizes = self._bytes
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
            raise ValueError("an id is not in the model")
        count = sizes[ids]
        total = np.append(0, np.cumsum(count))
        body = data[np.repeat(begin[ids] - total[:-1], count) + np.arange(total[-1])].tobytes()
        at = total[bounds]
        out = [body[a:b].decode(errors="replace") for a, b in zip(at, at[1:])]
        if self.spec.add_dummy_prefix:
            out = [t[1:] if t.startswith(" ") else t for t in out]
        return out


_loaded: dict[bytes, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    """The model, made once in each Python worker, so that it remembers words across tasks."""
    key = proto[-64:] + len(proto).to_bytes(8, "little") + proto[:64]
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def encode_decode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` of the text and the text ``decoded`` from them. Null texts count as empty: no ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType())).add(decoded, StringType())
    names = to_arrow_schema(schema)
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(proto.value)
        for batch in batches:
            for part in grams.slices(batch, text, 2 << 20):
                found, bounds = pieces.encode(part.column(text).cast(pa.string()))
                back = pa.array(pieces.decode(found, bounds), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_column(found, bounds), back], names=[f.name for f in names])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ``ids``; null ids give an empty text, an unknown id is an error."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType(list(docs.schema.fields)).add(text, StringType())
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(proto.value)
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            bounds = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists))))
            back = pieces.decode(np.asarray(pc.list_flatten(lists)).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, text])

    return docs.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each document, their number, and whether decoding gives the text back (a null text gives an empty one).

    Each row is taken by itself. A text that holds U+2581 comes back with spaces in its place.
    """
    out = encode_decode(docs.select(id_column, text), model, text)
    same = F.col("decoded") == F.coalesce(F.col(text), F.lit(""))
    return out.select(id_column, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
