"""Phrase collocation mining by SON partitioning: phrases of two to four words that are frequent in their language.

1. Shards. Each text belongs to one of a few shards by its hash. A shard is not a task: it is mined by as many tasks as it takes, so there
   are few of them whatever the size, and a phrase that is frequent at all is frequent for its share in at least one.
2. Local mining. Tasks count the hashes of all n-grams of their texts and send them, sorted and packed, to the shard's ranges of hashes,
   where counts are added up. A hash stays if its count reaches the shard's support: the global one times the
   shard's part of the language's words, rounded up. If a phrase were below that everywhere, its total would be below the global support.
3. Union. What is locally frequent anywhere has at most its counts where it is frequent, and one below the support of each other shard; if that is
   below the global support, it goes. So what is left grows with the frequent phrases, not with those that one shard has a few times. The rest
   becomes a bit of a map of bounded size. A bit that stands for several hashes lets more through, never less.
4. Exact count. A second pass over the texts counts the phrases that the map lets through, as text, and keeps those that
   reach the support. From here on everything is joins and aggregates over frequent phrases.

Defined cases: null texts are empty; a null lang is `und`; repeated rows count each; other columns are ignored; an empty table, or
one without a frequent phrase, gives no rows. A text is cut at separators while it is read, so its length does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .common import in_slices, mix, whole_groups

#: Occurrences that make a phrase a candidate, words of the longest, and phrases returned of each language.
SUPPORT, LONGEST, TOP = 30, 4, 2000
#: A phrase goes when a longer one around it has so many percent of its occurrences.
COVERED = 80
#: Shards: few, so that local support stays above one (with eight, four of 30).
SHARDS = 8
#: Bytes of text that a task works on at a time, and of text whose hashes meet in one range of a shard.
SEGMENT, RANGE = 4_000_000, 4_000_000
#: Bits of the hashes that are mined, and at most of the map of candidates (16 MB).
KEY_BITS, MAP_BITS = 48, 27
#: Counts of a shard are packed up to so many.
MOST = 2**32 - 1
#: Bytes of a slice of the map.
SLICE = 2**16
#: Up to so many shares (a row for each shard and language) are broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 100_000
#: Groups in which the first phrases of a language are chosen before all of it.
SALTS = 128

#: Separators of pieces, and of words within them.
STOPS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_STOP = re.compile(rb"[.,;:!?\x0a-\x0d]")

Batches = Iterator[pa.RecordBatch]
_rng = np.random.default_rng(20240611)
_TABLES = _rng.integers(0, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[ord(c) for c in BLANKS]] = 1
_KIND[[ord(c) for c in STOPS]] = 2
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor^i and its inverse mod 2^64, for i below n."""
    held = _powers.get(factor)
    if held is None or len(held[0]) < n:
        both = []
        for f in (factor, pow(factor, -1, 2**64)):
            p = np.full(n, f, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        held = _powers[factor] = (both[0], both[1])
    return held


class Words:
    """The words of lower-cased bytes: where they start and end, and the piece of each."""

    def __init__(self, data: bytes):
        self.data = data
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[self.bytes]
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.pieces = np.cumsum(kind == 2, dtype=np.int32)[self.starts]

    def hashes(self, which: int) -> np.ndarray:
        """64-bit hashes of the words, by one of two functions."""
        power, inverse = _powers_of(_FACTORS[which], len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[which][self.bytes] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def grams(self, which: int, lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size: the first words of its phrases, and hashes of these and the language."""
        words = self.hashes(which)
        keys = mix(words + np.uint64(xxhash.xxh3_64_intdigest(lang)))
        yield 1, np.arange(len(keys)), keys
        for size in range(2, longest + 1):
            keys = mix(keys[:-1] * np.uint64(_FACTORS[1 - which]) + words[size - 1 :]) if len(keys) else keys
            (at,) = np.nonzero(self.pieces[size - 1 :] == self.pieces[: len(self.pieces) - size + 1]) if len(keys) else (np.zeros(0, dtype=np.int64),)
            yield size, at, keys[at]

    def phrases(self, first: np.ndarray, size: np.ndarray) -> list[str]:
        """Phrases as text, a space between words."""
        begin, end = self.starts[first], self.ends[first + size - 1]
        tight = end - begin
        letters = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        single = tight == letters[first + size] - letters[first] + size - 1
        out = []
        for i, n, b, e, one in zip(first.tolist(), size.tolist(), begin.tolist(), end.tolist(), single.tolist(), strict=True):
            if one:
                out.append(self.data[b:e].replace(b"\t", b" ").decode())
            else:
                out.append(b" ".join(self.data[self.starts[k] : self.ends[k]] for k in range(i, i + n)).decode())
        return out


def _parts(text: str | None) -> Iterator[bytes]:
    """A text in lower case (A-Z only), cut at separators of pieces into parts of a bounded size (a piece is never cut)."""
    data = (text or "").encode().lower()  # bytes know no other letters
    begin = 0
    while len(data) - begin > SEGMENT:
        found = _STOP.search(data, begin + SEGMENT)
        if not found:
            break
        yield data[begin : found.start()]
        begin = found.end()
    yield data[begin:]


def _segments(batches: Batches, keys: list[str]) -> Iterator[tuple[tuple, Words]]:
    """The words of texts with equal values of keys, so much text at a time."""
    held: dict[tuple, list[bytes]] = {}
    n = 0
    for batch in batches:
        for own in zip(in_slices(batch.column("text")), *(batch.column(k).to_pylist() for k in keys), strict=True):
            for part in _parts(own[0]):
                held.setdefault(own[1:], []).append(part)
                n += len(part) + 1
                if n >= SEGMENT:
                    yield from ((key, Words(b"\n".join(texts))) for key, texts in held.items())
                    held, n = {}, 0
    yield from ((key, Words(b"\n".join(texts))) for key, texts in held.items())


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of KEY_BITS bits and their counts: steps between keys by bytes, the first bytes of all together."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    return zstandard.compress(steps.T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw, width = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8), KEY_BITS // 8
    n = len(raw) // (width + 4)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = raw[: n * width].reshape(width, n).T
    counts = np.ascontiguousarray(raw[n * width :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), counts.astype(np.int64)


def _count(bits: int, longest: int) -> Callable[[Batches], Batches]:
    """Counts of all n-grams' hashes, packed for each of 2^bits ranges."""

    def run(batches: Batches) -> Batches:
        for (shard, lang, local), words in _segments(batches, ["shard", "lang", "local"]):
            every = np.concatenate([k for _, _, k in words.grams(0, lang, longest)]) >> np.uint64(64 - KEY_BITS)
            keys, counts = np.unique(every, return_counts=True)
            ends = np.searchsorted(keys, (np.arange(1, 2**bits + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits)) - np.uint64(1), side="right")
            rows, begin = [], 0
            for k, end in enumerate(ends.tolist()):
                if end > begin:
                    rows.append((shard, lang, local, k, pack(keys[begin:end], counts[begin:end])))
                begin = end
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "lang", "local", "part", "packed"])

    return run


def _summed(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all blobs in order, each once, with the sum of its counts."""
    keys, counts = (np.concatenate(x) for x in zip(*map(unpack, packed.to_pylist()), strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _mine(batches: Batches) -> Batches:
    """The hashes whose counts reach the support of their shard, packed, with how far they are over the most that a hash below it has."""
    for table, offsets in whole_groups(batches, ["shard", "lang", "part"], rows=256):
        local, lang, part, packed = table.column("local").to_numpy(), table.column("lang"), table.column("part"), table.column("packed")
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            keys, counts = _summed(packed.slice(lo, hi - lo))
            often = counts >= local[lo]
            if often.any():
                over = np.minimum(counts[often] - local[lo] + 1, MOST)
                yield pa.RecordBatch.from_arrays([pa.array([lang[lo].as_py()]), pa.array([part[lo].as_py()], pa.int32()), pa.array([pack(keys[often], over)], pa.binary())], names=["lang", "part", "packed"])


def _bounded(support: int) -> Callable[[Batches], Batches]:
    """Of what is frequent in some shards, the hashes that may reach the support of all: rest is the most that one has that is frequent in none."""

    def run(batches: Batches) -> Batches:
        for table, offsets in whole_groups(batches, ["lang", "part"], rows=256):
            rest, packed = table.column("rest").to_numpy(), table.column("packed")
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                keys, over = _summed(packed.slice(lo, hi - lo))
                keys = keys[over + rest[lo] >= min(support, MOST)]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())], names=["keys", "n"])

    return run


def _slices(bits: int) -> Callable[[Batches], Batches]:
    """Slices of a map with a bit for each hash (its first bits) that a task has."""

    def run(batches: Batches) -> Batches:
        own = np.zeros(2**bits // 8, dtype=np.uint8)
        for batch in batches:
            for blob in batch.column("keys").to_pylist():
                at = np.frombuffer(blob, dtype=np.uint64) >> np.uint64(KEY_BITS - bits)
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        for k in range(0, len(own), SLICE):
            if own[k : k + SLICE].any():
                yield _slice(k // SLICE, own[k : k + SLICE])

    return run


def _slice(k: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])


def _merged(batches: Batches) -> Batches:
    held: tuple[int, np.ndarray] | None = None
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(blob, dtype=np.uint8)
            if held and held[0] == k:
                held = (k, held[1] | bits)
            else:
                if held:
                    yield _slice(*held)
                held = (k, bits)
    if held:
        yield _slice(*held)


def candidate_map(frequent: DataFrame, bits: int) -> bytes:
    """The map of all locally frequent hashes; 2^bits bits, so its size is bounded."""
    merged = frequent.select("keys").mapInArrow(_slices(bits), "slice int, bits binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice int, bits binary")
    out = bytearray(2**bits // 8)
    for r in merged.collect():  # 256 slices at most
        out[r.slice * SLICE : r.slice * SLICE + len(r.bits)] = r.bits
    return bytes(out)


def _exact(shared, bits: int, longest: int) -> Callable[[Batches], Batches]:
    """Counts, as text, of the phrases that the map lets through."""

    def run(batches: Batches) -> Batches:
        held = np.frombuffer(shared.value, dtype=np.uint8)
        for (lang,), words in _segments(batches, ["lang"]):
            found: list[list[np.ndarray]] = []
            for (size, at, key), (_, _, other) in zip(words.grams(0, lang, longest), words.grams(1, lang, longest), strict=True):
                spot = key >> np.uint64(64 - bits)
                through = np.flatnonzero((held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                found.append([at[through], np.full(len(through), size), key[through], other[through]])
            at, size, key, other = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(at):
                continue
            # phrases are one if both of their 64-bit hashes are
            order = np.lexsort((other, key))
            key, other = key[order], other[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1]))))
            counts = np.diff(np.append(first, len(key)))
            own = order[first]
            n = len(first)
            columns = [pa.array([lang] * n), pa.array(size[own], pa.int32()), pa.array(words.phrases(at[own], size[own])), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "f"])

    return run


def _each(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def shares(texts: DataFrame, support: int) -> DataFrame:
    """Words and bytes of each shard and language, n of the language, and the support that its share asks of the shard."""
    words = F.regexp_count("text", F.lit(r"[^.,;:!?\x09-\x0D\x20]+")).cast("long")
    own = texts.groupBy("shard", "lang").agg(F.sum(words).alias("own"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    n = own.groupBy("lang").agg(F.sum("own").alias("n"))
    part = f"cast({support} as decimal(18,0)) * own"
    return own.join(n, "lang").withColumn("local", F.expr(f"greatest(1, ({part} + n - 1) div greatest(n, 1))").cast("long"))


def frequent_phrases(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to longest words with f >= support, and (lang, n)."""
    texts = _each(documents).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int"))
    told = cut(shares(texts, support), "shares")
    volume = told.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, volume / (SHARDS * RANGE))))))
    small = told.count() <= BROADCAST_ROWS
    known = told.select("shard", "lang", "local")
    dealt = texts.join(F.broadcast(known) if small else known, ["shard", "lang"])
    counted = dealt.mapInArrow(_count(bits, longest), "shard int, lang string, local long, part int, packed binary")
    mined = counted.repartition("shard", "lang", "part").sortWithinPartitions("shard", "lang", "part").mapInArrow(_mine, "lang string, part int, packed binary")
    rest = told.groupBy("lang").agg((F.sum("local") - F.count("*")).alias("rest"))
    met = mined.join(F.broadcast(rest) if small else rest, "lang")
    frequent = cut(met.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(_bounded(support), "keys binary, n long"), "frequent")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    width = min(MAP_BITS, max(16, int(total * 16).bit_length()))
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(candidate_map(frequent, width))
    drop_scratch(frequent)
    passed = texts.select("text", "lang").mapInArrow(_exact(shared, width, longest), "lang string, size int, phrase string, f long")
    phrases = cut(passed.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= support), "phrases")
    return phrases, told.select("lang", "n").distinct()


def _words(begin: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", begin, length), " ")


def _big(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score), each by its lowest-scoring cut."""
    asked = phrases.where("size >= 2").withColumn("words", F.split("phrase", " "))
    sides = [F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))) for k in range(1, longest) for side, part in (("l", _words(1, k)), ("r", _words(k + 1, F.col("size") - k)))]
    parts = asked.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array_compact(F.array(*sides))).alias("p")).select("lang", "phrase", "a", "p.*")
    # a part has all occurrences of its phrase, so it is among the frequent ones
    counted = parts.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    f = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = counted.groupBy("lang", "phrase", "a").agg(*(f(k, side) for k in range(1, longest) for side in "lr"))
    for k in range(1, longest):
        wide = wide.withColumn(f"s{k}", F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))"))
    cuts = [F.when(F.col(f"s{k}").isNotNull(), F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return wide.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*cuts))).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def covered(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer frequent phrase around each phrase of two words or more."""
    asked = phrases.where("size >= 3").withColumn("words", F.split("phrase", " "))
    inner = [F.when((F.col("size") > n) & (F.col("size") >= k + n - 1), _words(k, n)) for n in range(2, longest) for k in range(1, longest - n + 2)]
    return asked.select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first phrases of each language of documents (text, lang): lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(documents, support, longest)
    kept = scored(phrases, longest).join(covered(phrases, longest), ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (F.lit(100) * _big("most") < F.lit(COVERED) * _big("a"))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold nearly all phrases: the first of each part of it, then the first of these
    some = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
