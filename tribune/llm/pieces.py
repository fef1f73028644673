"""SentencePiece encoding and decoding.

The pieces of a model make an Aho-Corasick automaton. One pass of it over a text drives the
Viterbi search: at each position the automaton's output links name every piece that ends there, longest
first, and each relaxes the best score of that position. This is the segmentation with the highest
sum of piece scores (SentencePiece's unigram rule), for any model file; of equal sums the one
with the longer last piece wins. A character that no piece covers costs more than
any piece and becomes its UTF-8 bytes' pieces, or the unknown piece where a model has none.

No piece may hold a space sign after another character in the models used here, so a text's best segmentation is that of
its words one after another; words are searched once and remembered in a bounded table
(a line break that no piece holds stands alone, too).
For a model with such pieces the whole text is searched as one.

A model with BPE scores (minus the rank of the merge) is searched by the same rule: the result is a
lossless encoding over its pieces, but not the order of merges that BPE itself would take.

Defined cases: null text has null ids, empty text no ids; U+2581 counts as a space, as in SentencePiece, so a text that holds it comes back with spaces there and its
round_trip is false (and so with a model that collapses runs of spaces);
any other text, of any length, comes back unchanged from decode(encode(text)); rows are independent, so
repeated rows get equal ids; extra columns are kept unless they bear the names of results.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices, text_chunks, with_fields

SPACE = "▁"
#: Pieces per worker that are remembered with their ids before the table starts afresh.
HELD = 300_000
#: What an uncovered character costs beyond the lowest score, a fixed value of SentencePiece.
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file, fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}[kind] if kind != 2 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """Pieces of a model file, in order of their ids."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    dummy_prefix: bool = True
    one_space: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                model.pieces.append(piece)
                model.scores.append(score)
                model.kinds.append(kind)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models that map characters before segmentation are not supported")
                model.dummy_prefix, model.one_space = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return model


class Codec:
    """Encodes and decodes with one model; made once per task from the model file's bytes."""

    def __init__(self, data: bytes):
        self.model = m = Model.parse(data)
        self.automaton = ahocorasick.Automaton()
        searched = [k for k, kind in enumerate(m.kinds) if kind in (NORMAL, USER)]
        lowest = min((m.scores[k] for k in searched if m.kinds[k] == NORMAL), default=0.0)
        highest = max((m.scores[k] for k in searched if m.kinds[k] == NORMAL), default=0.0)
        for k in searched:
            size = len(m.pieces[k])
            value = m.scores[k] if m.kinds[k] == NORMAL else size * highest - 0.1
            self.automaton.add_word(m.pieces[k], (size, value, k))
        if searched:
            self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        self.byte_ids = {int(m.pieces[k][1:-1], 16): k for k, kind in enumerate(m.kinds) if kind == BYTE}
        self.by_word = all(SPACE not in m.pieces[k].lstrip(SPACE) for k in searched)
        self.by_line = self.by_word and not any("\n" in m.pieces[k] for k in searched)
        # ids of remembered words, one after another
        self.rows: dict[str, int] = _Rows(self)
        self.clear()
        # bytes of all pieces, one after another
        raw = [b"" if kind == CONTROL else bytes([int(p[1:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, kind in zip(m.pieces, m.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes

    def clear(self) -> None:
        self.rows.clear()
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def normalise(self, text: str) -> str:
        """The text that is segmented, with spaces as spaces; decode() gives this back without the prefix."""
        text = text.replace(SPACE, " ")
        return " ".join(filter(None, text.split(" "))) if self.model.one_space else text

    def words(self, text: str) -> list[str]:
        """Parts of a normalised text that are segmented apart from each other; joined, they are the text."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        if not self.by_word:
            return [text]
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.by_line else [text]):
            if k:
                out.append("\n")
            parts = line.split(SPACE)
            if parts[0]:
                out.append(parts[0])
            run = ""
            for p in parts[1:]:
                run += SPACE
                if p:
                    out.append(run + p)
                    run = ""
            if run:
                out.append(run)
        return out

    def segment(self, part: str) -> list[int]:
        """Ids of the best segmentation of one part."""
        n, cost = len(part), self.unknown_score
        best, size_of, piece_of = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        reached = 0
        for end, (size, score, piece) in self.automaton.iter(part) if len(self.automaton) else ():
            end += 1
            while reached < end:  # at first as an uncovered character
                best[reached + 1] = best[reached] + cost
                reached += 1
            total = best[end - size] + score
            if total > best[end]:
                best[end], size_of[end], piece_of[end] = total, size, piece
        ids: list[int] = []
        at = len(part)
        while at:
            piece = piece_of[at]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(part[at - 1].encode("utf-8", "replace"))]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at -= size_of[at]
        return ids[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if len(self.rows) > HELD:
            self.clear()
        parts: list[str] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = self.words(self.normalise(text))
            counts[k] = len(own)
            parts += own
        rows = np.fromiter(map(self.rows.__getitem__, parts), dtype=np.int64, count=len(parts))
        # the arrays are read in place; they can grow again once these views of them are gone
        starts, sizes = np.frombuffer(self.starts, dtype=np.int64)[rows], np.frombuffer(self.sizes, dtype=np.int64)[rows]
        ids = np.frombuffer(self.flat, dtype=np.int32)[_ranges(starts, sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        last = np.cumsum(counts)
        return ids, ends[last] - ends[last - counts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids that follow one another, sizes of them each. Bytes that are not UTF-8 become U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.raw_sizes)):
            raise ValueError("an id is not in the model")
        long = self.raw_sizes[ids]
        data = self.raw[_ranges(self.raw_starts[ids], long)].tobytes()
        ends = np.concatenate(([0], np.cumsum(long)))[np.concatenate(([0], np.cumsum(sizes)))]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [t.removeprefix(" ") for t in texts] if self.model.dummy_prefix else texts


class _Rows(dict):
    """part -> its number among those remembered; a new one is segmented."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, part: str) -> int:
        ids = self.codec.segment(part)
        c = self.codec
        self[part] = row = len(c.starts)
        c.starts.append(len(c.flat))
        c.sizes.append(len(ids))
        c.flat.extend(ids)
        return row


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, sizes of them."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def read_model(path: str) -> bytes:
    """The model file's bytes, read once by the driver; under 1 MB, they travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, column: str = "text", check: bool = False) -> DataFrame:
    """df with `ids` and `n_tokens`, and with check also `round_trip`: whether decoding gives the text again."""
    more = [("ids", "array<int>"), ("n_tokens", "int"), *([("round_trip", "boolean")] if check else [])]
    df = df.drop(*(n for n, _ in more))
    schema = with_fields(df, *more)
    at = df.columns.index(column)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            done = 0
            for texts in text_chunks(in_slices(batch.column(at))):
                rows = batch.slice(done, len(texts))
                done += len(texts)
                null = rows.column(at).is_null()
                ids, sizes = codec.encode(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(null.to_numpy(zero_copy_only=False), False))
                out = [*rows.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(sizes.astype(np.int32), mask=null.to_numpy(zero_copy_only=False))]
                if check:
                    back = codec.decode(ids, sizes)
                    out.append(pa.array([a == b for a, b in zip(back, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, column: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the texts of its ids; null ids have null text."""
    df = df.drop(into)
    schema = with_fields(df, (into, "string"))
    at = df.columns.index(column)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], dtype=np.int64)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=null)], names=names)

    return df.mapInArrow(run, schema)
