"""Insert by key: which rows of a load are in a store already, without reading what is stored.

A store holds, beside its rows, 128 bits of each key's SHA-256 in buckets, and for each load and bucket a Bloom filter of these. A load asks the filters of
its own buckets first, reads the stored hashes of those that may hold one of its keys, and reads stored rows only of the parts in which
a hash was found, to compare the keys in full. A load of new rows thus reads filters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import ROWS, Store
from ..tables import TEXTS, cut, drop_scratch

#: Buckets of hashes, fixed when a store is made; bits of a filter for each key, and hash functions.
BUCKETS, BITS, HASHES = 256, 10, 5

KEYS, FILTERS = "keys", "filters"
#: of: the part of the rows that have these keys.
_KEYS = "digest binary, of string, bucket int"
_FILTERS = "bucket int, bits binary"


def digest(key: list[str]) -> Column:
    """SHA-256 of the key's columns, each with its length before it, so that no two keys read alike. Nulls are told from empty texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, key)).cast("binary"), 256))


def _short(digest: str | Column) -> Column:
    return F.substring(digest, 1, 16)


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a filter (a power of two) that each digest of 16 bytes has."""
    halves = digests.view("<u8").reshape(-1, 2)
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((halves[:, 0] + steps * (halves[:, 1] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(digests: np.ndarray) -> bytes:
    """Bloom filter of rows of 16 bytes, sized for their number."""
    bits = 1 << max(9, int(len(digests) * BITS - 1).bit_length())
    own = np.zeros(bits, dtype=bool)
    own[_places(digests, bits).ravel()] = True
    return np.packbits(own, bitorder="little").tobytes()


def may_hold(held: bytes, digests: np.ndarray) -> np.ndarray:
    own = np.unpackbits(np.frombuffer(held, dtype=np.uint8), bitorder="little").view(bool)
    return own[_places(digests, len(own))].all(axis=0)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 16)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each bucket of digests sorted by bucket; of a load's bucket the digests only, 16 bytes a row, are held."""
    held: list[np.ndarray] = []
    at = None

    def end() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([filter_of(np.concatenate(held))], pa.binary())], names=["bucket", "bits"])

    for batch in batches:
        buckets, digests = batch.column("bucket").to_numpy(), _rows(batch.column("digest"))
        for b in np.unique(buckets).tolist():
            if b != at:
                yield from end()
                held, at = [], b
            held.append(digests[buckets == b])
    yield from end()


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of filters and digests, sorted by bucket with filters first, the digests that a filter of their bucket may hold."""
    at, held = None, []
    for batch in batches:
        buckets, bits, digests = batch.column("bucket").to_numpy(), batch.column("bits"), batch.column("digest")
        for b in np.unique(buckets).tolist():
            if b != at:
                at, held = b, []
            here = np.flatnonzero(buckets == b)
            own = bits.take(pa.array(here)).drop_null().to_pylist()
            held += own
            asked = digests.take(pa.array(here)).drop_null()
            if len(asked) and held:
                rows = _rows(asked)
                there = np.zeros(len(rows), dtype=bool)
                for f in held:
                    there |= may_hold(f, rows)
                if there.any():
                    found = asked.filter(pa.array(there))
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(found), pa.int32()), found], names=["bucket", "digest"])


def once(rows: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key (of any, if no order is given) with its `digest`. Keys are grouped by their digests, and of a key that comes often each task sends one row."""
    rest = F.struct(*rows.columns)
    order = order or [F.lit(0)]
    best = F.min_by(rest, F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("best")
    return rows.withColumn("_key", digest(key)).groupBy("_key").agg(best).select("best.*", F.col("_key").alias("digest"))


def maybe_stored(store: Store, fresh: DataFrame) -> DataFrame:
    """(bucket, digest) of the rows of fresh (digest of 16 bytes, bucket) that filters may hold. Filters meet their bucket's digests in one task."""
    filters = store.read(FILTERS, _FILTERS).select("bucket", "bits", F.lit(None).cast("binary").alias("digest"))
    both = filters.unionByName(fresh.select("bucket", F.lit(None).cast("binary").alias("bits"), "digest"))
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("digest").isNotNull()).mapInArrow(_maybe, "bucket int, digest binary")


def stored_hits(store: Store, maybe: DataFrame) -> DataFrame:
    """(digest, of) of stored keys with the digests of `maybe`; of the stored hashes only the buckets asked are read."""
    buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # BUCKETS at most
    keys = store.read(KEYS, _KEYS).where(F.col("bucket").isin(buckets))
    return keys.join(maybe, ["bucket", "digest"]).select("digest", "of")


def confirmed(store: Store, fresh: DataFrame, hits: DataFrame, key: list[str], schema: str, at: str = "digest") -> DataFrame:
    """Digests (of 32 bytes) of the rows of fresh whose whole key a stored row has, looked for in the parts in which their hashes were found."""
    parts = {r.of for r in hits.select("of").distinct().collect()}  # a name for each part that holds a hit
    stored = store.read(ROWS, schema, only=lambda p: p["id"] in parts).select(*(F.col(c).alias(f"_{c}") for c in key), _short(digest(key)).alias("_digest"))
    # of the stored rows only those that were found are shuffled
    stored = stored.join(hits.select(F.col("digest").alias("_digest")).distinct(), "_digest", "left_semi")
    asked = fresh.join(hits.select(F.col("digest").alias("_short")).distinct(), F.col("short") == F.col("_short"), "left_semi")
    same = F.col("short") == F.col("_digest")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return asked.join(stored, same, "left_semi").select(at)


def append(store: Store, rows: DataFrame, key: list[str], schema: str, order: list[Column] | None = None, extra: dict[str, list[dict]] | None = None, notes: dict | None = None) -> int:
    """Append the rows whose key is neither stored nor earlier in the load; rows, hashes and filters count together. Returns how many rows were added.

    schema is the stored rows' one (columns of rows beyond it are not stored). extra: parts of other tables of the store, staged before, and
    notes that are to count with these rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    buckets = store.notes.get("buckets", BUCKETS)
    fresh = cut(once(rows, key, order).withColumn("short", _short("digest")).withColumn("bucket", _bucket("short", buckets)), "fresh", TEXTS)
    new = fresh
    if store.parts(FILTERS):
        maybe = cut(maybe_stored(store, fresh.select("bucket", F.col("short").alias("digest"))), "maybe")
        hits = cut(stored_hits(store, maybe), "hits")
        if not hits.isEmpty():
            there = cut(confirmed(store, fresh, hits, key, schema), "there")
            new = fresh.join(there, "digest", "left_anti")
        drop_scratch(maybe, hits)
    add = dict(extra or {})
    part = store.stage(ROWS, new.select(*names))
    staged = store.read_staged(ROWS, part, schema)
    n = staged.count()
    if n:
        digests = new.select(F.col("short").alias("digest"), "bucket")
        held = store.stage(KEYS, digests.repartition("bucket").withColumn("of", F.lit(part["id"])), by=("bucket",))
        sorted_ = store.read_staged(KEYS, held, _KEYS).repartition("bucket").sortWithinPartitions("bucket")
        add |= {ROWS: [part | {"n": n}], KEYS: [held], FILTERS: [store.stage(FILTERS, sorted_.mapInArrow(_filters, _FILTERS))]}
    if add or notes:
        store.commit(add, notes={"buckets": buckets} | (notes or {}))
    drop_scratch(fresh)
    return n
