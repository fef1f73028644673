"""BPE encoding by content-defined chunks: what documents share is encoded once, and the joins of chunks are encoded anew.

1. Cutting. A normalised text is cut where a rolling hash of its last 16 characters says so, so equal passages are cut alike
   wherever they stand. A chunk that occurs in several different texts is shared; the text with the smallest digest is its home.
2. Encoding. Each different text is encoded once. Of a shared chunk its home encodes the part between its first and its last
   space and lends it to the others; text that nobody shares is encoded where it is. What texts borrow travels to them as
   token ids; texts that borrow nothing are finished at once.
3. Joins. No token crosses a space, so encodings agree from a space on. Between two chunks the end of the one and the beginning of
   the other (and any chunk without a space between them) are put together and encoded anew from the last space to the next,
   which is where exact agreement with the encoding of the whole text begins again.

The tokenizer is that of the given file of the tokenizers library (byte-level BPE of lower-case words with a word-end suffix; others are
refused). Merges, words and normalisation are done here; characters that are younger than some of the Unicode tables involved are left
to the library's own normaliser and splitter. Special tokens in a text become their ids, as the library does by default.

Defined cases: null texts are empty and have no tokens; doc_ids may repeat or be null; extra columns are ignored; an empty
table gives no rows; a text of any length is worked on in one task, linear in its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .common import in_slices, text_chunks

#: Characters of a chunk: at least, on average (a power of two) and at most.
LEAST, USUAL, MOST = 256, 1024, 8192
#: Pieces of text (between spaces) whose ids a worker remembers before it starts afresh.
PIECES_HELD = 300_000
#: Symbols up to which words are merged side by side, and up to which one word is merged by looking at all its pairs.
NARROW, SHORT = 32, 128
#: Characters of texts whose new words are merged side by side.
AHEAD = 1_000_000

#: White space, fixed values of the Unicode standard.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_SPACE = _SPACE.replace(r"\x20", "")
_SPACES = re.compile(f"[{_SPACE}]{{2,}}|[{_OTHER_SPACE}]")
#: Characters on which all Unicode tables involved agree (tested); texts with others are left to the library.
_ODD = re.compile(r"[^\x00-\u0557\u1e00-\u1eff\u2000-\u2064\u2190-\u22ff\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]")
#: What the tokenizer's file must say, fixed values of the format.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}

#: The rank of pairs that are not merged.
_NONE = np.int64(2**62)

Batches = Iterator[pa.RecordBatch]


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Codec(dict):
    """A tokenizer. As a dict it holds the ids of pieces of normalised text without spaces, written in decimals with spaces between them."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        told = json.loads(model)
        bpe, splitter = told["model"], told["pre_tokenizer"]
        plain = {k: bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")} == dict.fromkeys(("dropout", "unk_token", "continuing_subword_prefix"))
        steps = splitter.get("pretokenizers", [{}])
        if bpe["type"] != "BPE" or not plain or bpe["ignore_merges"] or bpe["byte_fallback"] or told["normalizer"] != _NORMALIZER or [s.get("type") for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or told["decoder"] or told["post_processor"]:
            raise ValueError("only byte-level BPE of lower-case words is supported")
        vocab, suffix = bpe["vocab"], bpe["end_of_word_suffix"] or ""
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.library = Tokenizer.from_str(model)
        self.first = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + suffix] for c in byte_letters()]
        # rank and result of a pair's merge in one number, by both ids in one
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a.removesuffix(suffix) + b] for rank, (a, b) in enumerate(bpe["merges"])}
        self.keys = np.array(sorted(self.merges), dtype=np.int64)
        self.found = np.array([self.merges[k] for k in self.keys.tolist()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {str(i): t for t, i in [*vocab.items(), *self.special.items()]}

    def normalised(self, text: str) -> str:
        if _ODD.search(text):
            return self.library.normalizer.normalize_str(text)
        text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
        # letters one by one: the library knows no final sigma
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def sections(self, text: str | None) -> list[str | int]:
        """Normalised text between special tokens, and the ids of these."""
        if not text:
            return []
        if not self.specials or "<" not in text and not self.specials.search(text):
            return [self.normalised(text)]
        return [self.special[s] if k % 2 else self.normalised(s) for k, s in enumerate(self.specials.split(text)) if s]

    def __missing__(self, piece: str) -> str:
        out = " ".join(" ".join(map(str, self.word(w.encode()))) for w in self.words_of(piece))
        if len(piece) <= 64 and len(self) < PIECES_HELD:
            self[piece] = out
        return out

    def words_of(self, piece: str) -> list[str]:
        if _ODD.search(piece):
            return [piece[b:e] for _, (b, e) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return self.words.findall(piece)

    def learn(self, texts: list[str]) -> None:
        """Find the ids of the pieces of normalised texts that are not known yet, all at once. Those of earlier texts may be forgotten, never those of these."""
        pieces = {p for text in texts for p in text.split(" ")}
        if len(self) + len(pieces) > PIECES_HELD:
            for p in [p for p in self if p not in pieces]:
                del self[p]
        new = [p for p in pieces if p not in self and len(p) <= 64]
        split = [self.words_of(p) for p in new]
        words = {w for own in split for w in own}
        short = [w for w in words if len(w.encode()) <= NARROW]
        ids = dict(zip(short, self.side_by_side([w.encode() for w in short]), strict=True))
        for w in words - ids.keys():
            ids[w] = " ".join(map(str, self.word(w.encode())))
        self.update((p, " ".join(map(ids.__getitem__, own))) for p, own in zip(new, split, strict=True))

    def side_by_side(self, words: list[bytes]) -> list[str]:
        """Ids, in decimals, of words of up to NARROW bytes: in each round every word merges its pair of least rank, the first of several."""
        out = [""] * len(words)
        of_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            of_size.setdefault(-(-len(w) // 4), []).append(k)
        for width, own in of_size.items():
            for k, ids in zip(own, self._merged([words[k] for k in own], 4 * width), strict=True):
                out[k] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and result of the merges of pairs; _NONE where there is none."""
        pairs = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.found[at], _NONE)

    def _merged(self, words: list[bytes], width: int) -> list[str]:
        n, sizes = len(words), np.array([len(w) for w in words])
        rows = np.arange(n)
        held = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, width + 2), -1, dtype=np.int64)  # a column before and one after
        ids[:, 1:-1] = np.array(self.first, dtype=np.int64)[held]
        ids[rows, sizes] = np.array(self.last, dtype=np.int64)[held[rows, sizes - 1]]
        column = np.arange(width + 2)
        ids[column > sizes[:, None]] = -1
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        todo = rows
        own, own_ranks = ids, ranks
        while True:
            place = own_ranks.argmin(axis=1)
            best = own_ranks[np.arange(len(todo)), place]
            some = best < _NONE
            if not some.any():
                break
            todo, place, best = todo[some], place[some], best[some]
            at = np.arange(len(todo))
            # what stands behind the pair moves up by one, and two pairs are new
            behind = np.minimum(column + (column > place[:, None]), width + 1)
            own = np.take_along_axis(own[some], behind, axis=1)
            own[:, -1] = -1
            own[at, place] = best & 0xFFFFFFFF
            own_ranks = np.take_along_axis(own_ranks[some], np.minimum(behind[:, :-1], width), axis=1)
            own_ranks[:, -1] = _NONE
            own_ranks[at, place - 1] = self._ranks(own[at, place - 1], own[at, place])
            own_ranks[at, place] = self._ranks(own[at, place], own[at, place + 1])
            ids[todo] = own
        return [" ".join(map(str, row[1 : 1 + k])) for row, k in zip(ids.tolist(), (ids >= 0).sum(axis=1).tolist(), strict=True)]

    def word(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank is merged, the first of several, until no pair can be."""
        ids = [*(self.first[b] for b in word[:-1]), self.last[word[-1]]]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        of, none = self.merges.get, 1 << 63
        ranks = [of(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = of(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = of(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        of, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i) for i in range(n - 1) if (m := of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or of(ids[i] << 32 | ids[j]) != m:
                continue
            ids[i], ids[j], after[i] = m & 0xFFFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := of(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (found, a))
        return [i for i in ids if i >= 0]

    def ids(self, text: str) -> str:
        """Ids of normalised text, in decimals."""
        return " ".join(filter(None, map(self.__getitem__, text.split(" "))))

    def decode(self, ids: str) -> str:
        """What the library gives for ids without a decoder: their tokens with spaces between them."""
        return " ".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else ""


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The tokenizer of a file's text, built once in a worker."""
    name = hashlib.sha256(model.encode()).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(model)
    return _codecs[name]


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def cuts(texts: list[str]) -> list[list[int]]:
    """Ends of the chunks of each text, by content."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    h = (letters * np.uint32(0x9E3779B1)) ^ (letters >> np.uint32(3))
    for step in (1, 2, 4, 8):  # sums over twice as many letters, each shifted by its distance
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    places = (np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - USUAL.bit_length() + 1) == 0) + 1).tolist()
    out, begin = [], 0
    for text in texts:
        end, last, own = begin + len(text), begin, []
        while end - last > LEAST:
            k = bisect_left(places, last + LEAST)
            last = min(places[k] if k < len(places) else end, last + MOST, end)
            if last < end:
                own.append(last - begin)
        out.append([*own, len(text)] if text else [])
        begin = end
    return out


def _digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def chunks_of(texts: list[list[str | int]]) -> list[list[tuple[int, int, str | int]]]:
    """For each text of sections: (section, place in the text, chunk), a special token's id being a chunk of its own."""
    plain = [s for sections in texts for s in sections if isinstance(s, str)]
    ends = iter(cuts(plain))
    out = []
    for sections in texts:
        own: list[tuple[int, int, str | int]] = []
        for k, section in enumerate(sections):
            if isinstance(section, int):
                own.append((k, len(own), section))
            else:
                begin = 0
                for end in next(ends):
                    own.append((k, len(own), section[begin:end]))
                    begin = end
        out.append(own)
    return out


def split(chunk: str, ids: Callable[[str], str]) -> tuple[str, str | None, str]:
    """What stands before the first space, the ids of what stands from there to the last, and what stands after it; without a space all
    is before it, and there are no ids."""
    first, last = chunk.find(" "), chunk.rfind(" ")
    return (chunk, None, "") if first < 0 else (chunk[:first], ids(chunk[first + 1 : last + 1]), chunk[last + 1 :])


def joined(parts: list[tuple[int, str, str | None, str]], of: Codec) -> str:
    """Ids of a text from its parts (section, before, ids, after): each join is encoded anew, from space to space."""
    out: list[str] = []
    open_, at = "", 0
    for section, before, ids, after in parts:
        if section != at:
            out.append(of[open_])
            open_, at = "", section
        open_ += before
        if ids is not None:
            out += (of[open_], ids)
            open_ = after
    out.append(of[open_])
    return " ".join(filter(None, out))


def _mark(shared) -> Callable[[Batches], Batches]:
    """(doc_id, key, digests of the chunks) of each row."""

    def run(batches: Batches) -> Batches:
        of = codec(shared.value)
        for batch in batches:
            digests: list[list[bytes]] = []
            for texts in text_chunks(in_slices(batch.column("text"))):
                for own in chunks_of([of.sections(t) for t in texts]):
                    digests.append([_digest(c) for _, _, c in own if isinstance(c, str)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "key", "digests"])

    return run


def _squeeze(batches: Batches) -> Batches:
    """Texts compressed, for the shuffle."""
    for batch in batches:
        packed = [zstandard.compress((t or "").encode(), 3) for t in in_slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], names=["key", "packed"])


#: A row is a finished text (key and results), a lent chunk (digest, before, ids, after) or a text that waits for what it borrows (key, parts).
_PART = "struct<place: int, section: int, digest: binary, before: string, ids: binary, after: string>"
_PART_TYPE = pa.struct([("place", pa.int32()), ("section", pa.int32()), ("digest", pa.binary()), ("before", pa.string()), ("ids", pa.binary()), ("after", pa.string())])
_LENT = "digest binary, before string, lent_ids binary, after string"


def _pack(ids: str | None) -> bytes | None:
    return None if ids is None else zstandard.compress(ids.encode(), 3)


def _unpack(ids: bytes | None) -> str | None:
    return None if ids is None else zstandard.decompress(ids).decode()


class Results:
    """What is returned of a text: its ids and what they decode to, or digests of both."""

    def __init__(self, digests: bool):
        self.digests = digests
        self.kinds = [("n_tokens", "long", pa.int64())] + (
            [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] if digests else [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
        )
        self.names = [n for n, _, _ in self.kinds]
        self.schema = ", ".join(f"{n} {kind}" for n, kind, _ in self.kinds)

    def of(self, ids: str, codec: Codec) -> tuple:
        n = ids.count(" ") + 1 if ids else 0
        decoded = codec.decode(ids)
        if self.digests:
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        return n, list(map(int, ids.split(" "))) if ids else [], decoded


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _flushed(rows: Iterator[tuple[int, tuple]], kinds: list[tuple[str, pa.DataType]], most: int = 4_000_000) -> Batches:
    """Batches of rows that come with their sizes."""
    held, n = [], 0
    for size, row in rows:
        held.append(row)
        n += size + 100
        if n >= most:
            yield _batch(held, kinds)
            held, n = [], 0
    if held:
        yield _batch(held, kinds)


def _encode(shared, results: Results) -> Callable[[Batches], Batches]:
    """Texts (key, packed, lends, borrows) to finished rows, lent chunks and texts that wait."""
    blank = (None,) * len(results.kinds)
    kinds = [("key", pa.binary()), *((n, t) for n, _, t in results.kinds), ("digest", pa.binary()), ("before", pa.string()), ("lent_ids", pa.binary()), ("after", pa.string()), ("parts", pa.list_(_PART_TYPE))]

    def rows_of(key: bytes, sections: list[str | int], lends: set[bytes], borrows: set[bytes], of: Codec) -> Iterator[tuple[int, tuple]]:
        parts: list[tuple[int, bytes | None, str, str | None, str]] = []
        lent: dict[bytes, tuple[str, str | None, str]] = {}
        run: list[str] = []  # chunks of one's own that follow each other are one part
        at = 0

        def end() -> None:
            if run:
                parts.append((at, None, *split("".join(run), of.ids)))
                run.clear()

        for section, _, chunk in chunks_of([sections])[0] if lends or borrows else [(k, 0, s) for k, s in enumerate(sections)]:
            if section != at:
                end()
                at = section
            if isinstance(chunk, int):
                parts.append((section, None, "", str(chunk), ""))
                continue
            digest = _digest(chunk) if lends or borrows else b""
            if digest in borrows:
                end()
                parts.append((section, digest, "", None, ""))
            elif digest in lends:
                end()
                if digest not in lent:
                    lent[digest] = split(chunk, of.ids)
                parts.append((section, None, *lent[digest]))
            else:
                run.append(chunk)
        end()
        for digest, (before, ids, after) in lent.items():
            yield len(ids or ""), (None, *blank, digest, before, _pack(ids), after, None)
        if borrows:
            # what borrowed chunks do not part is joined here
            waiting = [{"place": k, "section": s, "digest": d, "before": b, "ids": _pack(i), "after": a} for k, (s, d, b, i, a) in enumerate(parts)]
            yield sum(len(i or "") for _, _, _, i, _ in parts), (key, *blank, None, None, None, None, waiting)
        else:
            ids = joined([(s, b, i, a) for s, _, b, i, a in parts], of)
            yield (0 if results.digests else 2 * len(ids)), (key, *results.of(ids, of), None, None, None, None, None)

    def rows(batches: Batches) -> Iterator[tuple[int, tuple]]:
        of = codec(shared.value)
        held: list[tuple] = []
        n = 0

        def end() -> Iterator[tuple[int, tuple]]:
            of.learn([s for _, sections, _, _ in held for s in sections if isinstance(s, str)])
            for own in held:
                yield from rows_of(*own, of)

        for batch in batches:
            keys, lends, borrows = (batch.column(c) for c in ("key", "lends", "borrows"))
            for k, packed in enumerate(batch.column("packed")):
                text = zstandard.decompress(packed.as_py()).decode()
                held.append((keys[k].as_py(), of.sections(text), set(lends[k].as_py() or ()), set(borrows[k].as_py() or ())))
                n += len(text)
                if n >= AHEAD:
                    yield from end()
                    held, n = [], 0
        yield from end()

    return lambda batches: _flushed(rows(batches), kinds)


def _assemble(shared, results: Results) -> Callable[[Batches], Batches]:
    """Waiting texts (key, parts, borrowed) to finished rows."""
    kinds = [("key", pa.binary()), *((n, t) for n, _, t in results.kinds)]

    def rows(batches: Batches) -> Iterator[tuple[int, tuple]]:
        of = codec(shared.value)
        for batch in batches:
            for key, parts, borrowed in zip(batch.column("key"), batch.column("parts"), batch.column("borrowed"), strict=True):
                got = {b["digest"]: (b["before"], _unpack(b["ids"]), b["after"]) for b in borrowed.as_py()}
                each = ((p["section"], *(got[p["digest"]] if p["digest"] else (p["before"], _unpack(p["ids"]), p["after"]))) for p in parts.as_py())
                ids = joined(list(each), of)
                yield (0 if results.digests else 2 * len(ids)), (key.as_py(), *results.of(ids, of))

    return lambda batches: _flushed(rows(batches), kinds)


def _key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def encode(documents: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_tokens, and ids (array<int>) and decoded (string), or with digests ids_sha256 (of decimals
    with a space between) and decoded_sha256. model is the text of a tokenizer's file."""
    results = Results(digests)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one file of a few MB
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", _key())
    ident = dict(texts.dtypes)["doc_id"]
    marks = cut(texts.mapInArrow(_mark(shared), f"doc_id {ident}, key binary, digests array<binary>"), "marks")

    uses = marks.select("key", F.explode("digests").alias("digest"))
    homes = cut(uses.groupBy("digest").agg(F.min("key").alias("home"), F.max("key").alias("other")).where("home <> other").select("digest", "home"), "homes")
    lends = homes.groupBy(F.col("home").alias("key")).agg(F.collect_list("digest").alias("lends"))
    borrows = uses.join(homes, "digest").where("key <> home").groupBy("key").agg(F.collect_set("digest").alias("borrows"))
    deals = cut(lends.join(borrows, "key", "full"), "deals")

    once = texts.select("key", "text").mapInArrow(_squeeze, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    kinds = f"key binary, {results.schema}, {_LENT}, parts array<{_PART}>"
    coded = cut(once.join(deals, "key", "left").mapInArrow(_encode(shared, results), kinds), "coded")
    done = coded.where("key is not null and parts is null").select("key", *results.names)
    lent = coded.where("digest is not null").select("digest", "before", F.col("lent_ids").alias("ids"), "after")
    waiting = coded.where("parts is not null").select("key", "parts")
    asked = waiting.select("key", F.explode("parts.digest").alias("digest")).where("digest is not null").distinct()
    borrowed = asked.join(lent, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "before", "ids", "after")).alias("borrowed"))
    late = waiting.join(borrowed, "key").mapInArrow(_assemble(shared, results), f"key binary, {results.schema}")
    finished = cut(done.unionByName(late), "finished")
    drop_scratch(homes, deals, coded)
    return marks.select("doc_id", "key").join(finished, "key").drop("key")


def decode(frame: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """frame with the text that its ids (array<int>) decode to; null for null, and an id that the tokenizer lacks ends the job."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001
        of = codec(shared.value)
        return column.map(lambda own: None if own is None else of.decode(" ".join(map(str, own))))

    return frame.withColumn(into, run(F.col(ids)))
