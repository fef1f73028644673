"""What the operators of this package share: block deals, work within tasks, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words a worker remembers before it starts afresh; bounds the memory of a Python task.
WORDS_HELD = 200_000

def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """df's schema and more fields after it."""
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields))
    return StructType([*df.schema.fields, *more.fields])


def deal_blocks(rows: DataFrame, key: Sequence[str], ident: Column, blocks: Column) -> DataFrame:
    """Deal the rows of every key into pairs of blocks, so that any two rows of a key meet in exactly one cell.

    blocks is the number of blocks of the row's key. Each row takes block b by the hash of
    ident and goes to the cells (min(b, o), max(b, o)) for every block o; a key with one
    block has the one cell (0, 0). Adds cell_i, cell_j and block. A hot key is thus spread over
    many cells of bounded size, and a row is repeated once for each block, not for each partner.
    """
    mine = rows.withColumn("n_blocks", F.greatest(blocks.cast("int"), F.lit(1)))
    mine = mine.withColumn("block", F.pmod(F.xxhash64(ident, F.lit(17)), F.col("n_blocks")).cast("int"))
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return (
        each.withColumn("cell_i", F.least("block", "other"))
        .withColumn("cell_j", F.greatest("block", "other"))
        .drop("other", "n_blocks")
    )


def whole_groups(batches: Iterable[pa.RecordBatch], key: Sequence[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by key, with the offsets at which the groups start and end.

    Holds about rows rows at a time, and a longer group whole; callers bound groups with deal_blocks.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            offsets = _starts(table, key)
            last = int(offsets[-2])
            if last:
                yield table.slice(0, last).combine_chunks(), offsets[:-1]
                table = table.slice(last)
            held, n = table.combine_chunks().to_batches(), table.num_rows
            rows = max(rows, 2 * n) if not last else rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, key)


def _starts(table: pa.Table, key: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in key:
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def pairs_within(offsets: np.ndarray, most: int = 1_000_000, largest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b), a < b, of rows in the same group, at most about `most` at a time; of groups of at most `largest` rows, if given."""
    sizes = np.diff(offsets)
    # each row a is paired with the rows after it in its group
    after = np.repeat(offsets[1:], sizes) - 1 - np.arange(offsets[0], offsets[-1])
    if largest is not None:
        after[np.repeat(sizes, sizes) > largest] = 0
    first = np.arange(offsets[0], offsets[-1])
    ends = np.cumsum(after)
    lo = 0
    while lo < len(first):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        n = after[lo:hi]
        total = int(n.sum())
        if total:
            a = np.repeat(first[lo:hi], n)
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            yield a, a + 1 + step
        lo = hi


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits 64-bit values differ (bitwise_count takes the absolute value of signed ones, so as unsigned)."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row index that each of n rows reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def connect(lo: int, hi: int, linked: Callable[[int, np.ndarray], Iterable[int]]) -> np.ndarray:
    """The smallest row that each of the rows lo to hi reaches over links. linked(p, rows) tells which of some later rows a row links to.

    It is asked only for rows that are not connected to p yet, so a group whose rows are all alike costs one look a row, not one a pair.
    """
    label = np.arange(lo, hi)
    for p in range(lo, hi - 1):
        apart = label != label[p - lo]
        if not apart.any():
            break
        rows = p + 1 + np.flatnonzero(apart[p - lo + 1 :])
        found = [label[k - lo] for k in linked(p, rows)] if len(rows) else []
        if found:
            merged = np.unique([*found, label[p - lo]])
            label[np.isin(label, merged)] = merged[0]
    return label


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def in_slices(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """A batch's texts, of which only some are Python objects at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def text_chunks(texts: Iterable[str | None], words: int = 20_000) -> Iterator[list[str]]:
    """Lists of texts (null: empty) with about so many words in each, so that work arrays stay small."""
    held: list[str] = []
    n = 0
    for text in texts:
        held.append(text or "")
        n += 1 + len(held[-1]) // 6
        if n >= words:
            yield held
            held, n = [], 0
    if held:
        yield held


def across(block: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs a cell of deal_blocks answers for: all within a cell of one block, else those between its two blocks."""
    return (i[a] == j[a]) | (block[a] != block[b])


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest (x, y) of the links (a, b), indices into ids."""
    root = forest(len(ids), a, b)
    (leaf,) = np.nonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], names=["x", "y"])


def link_counts(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each linked row x: y, the root of its tree in a spanning forest, and how many rows it links to, copies included."""
    n = len(ids)
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = forest(n, a, b)
    (some,) = np.nonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some].astype(np.int64))], names=["x", "y", "links"])
