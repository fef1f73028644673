"""Near-duplicate vectors by lattice hashing.

Vectors are scaled to length 1 and projected at random to eight dimensions (or a few times eight), once for each table. The nearest point
of the lattice E8 (or one for each eight) is a vector's cell in that table; E8 packs and covers eight dimensions more tightly than a cubic grid, so near
vectors more often share a cell. Each vector also probes the neighbouring cells (of the 240 around its own) that are
nearest to it. Two vectors that meet in a cell which is the own cell of one of them, and whose random
sign bits differ in few places, are candidates. Candidates of a cell form groups, within which the
cosine of every candidate pair is computed in double precision; a pair that meets in several cells belongs to the first of them, so that it is
verified and counted once, and a chain of vectors costs as many comparisons as it has candidate pairs. Links are pairs with cosine >= 0.9.

Identical vectors form a class, named by a hash, and travel as one. Cells and groups of any size are dealt into pairs of blocks
(common.deal_blocks); pairs exist only as index arrays inside a task, which returns link counts and spanning forests.

A pair at cosine 0.90 is found with probability 0.98, one at 0.95 with 0.999 (measured in tests/llm). A key of several lattice points is met by chance
far less often, and takes more tables: both are chosen by the number of vectors, so that a vector meets some dozens of others by chance whether there
are thousands or millions (SETTINGS).

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component link with nothing and are
their own component; vectors of different length never link; rows that share a vec_id are vectors of their own, linked by what they hold (identical ones link with each other); a row with a null vec_id links with nothing, its component is null and kept is false;
labels and other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .common import across, deal_blocks, differing_bits, forest, link_counts, mix, pairs_within, whole_groups
from .components import components

THRESHOLD = 0.9


class Setting(NamedTuple):
    """Lattice points in a key, the standard deviation of a projected coordinate in units of the lattice, tables, and cells probed besides one's own."""

    points: int
    spread: float
    tables: int
    probes: int


#: Up to how many different vectors. Tables are as many as a recall of 0.98 at cosine 0.9 takes; with them a random vector meets this part of all others by
#: chance: 7e-3, 5e-4, 1e-4, 1.4e-5, and less than 1e-6 for the last two.
SETTINGS = [
    (5_000, Setting(1, 0.9, 8, 8)), (100_000, Setting(2, 0.55, 12, 8)), (1_000_000, Setting(2, 0.65, 22, 8)),
    (10_000_000, Setting(3, 0.5, 24, 16)), (1_000_000_000, Setting(3, 0.6, 62, 16)), (None, Setting(4, 0.5, 82, 16)),
]
#: Of 128 sign bits so many may differ: a pair at cosine 0.9 differs in 18 on average (deviation 4), a random one in 64.
SIGN_BITS, MOST_DIFFERENT = 128, 32
CELL_ROWS, GROUP_ROWS = 2_000, 1_000
#: Up to so many hot cells (12 bytes each) are broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 1_000_000


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sum: where the sum is odd, the coordinate furthest from its integer goes the other way."""
    near = np.rint(x)
    (odd,) = np.nonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the nearest in the even-sum integers and in those moved by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


@lru_cache
def _projections(dim: int, setting: Setting) -> np.ndarray:
    rng = np.random.default_rng([8, dim])
    out, wide = [], 8 * setting.points
    for _ in range(setting.tables):
        drawn = rng.normal(size=(dim, wide))
        q = np.linalg.qr(drawn)[0] if dim >= wide else drawn / np.sqrt(dim)
        out.append(q * np.sqrt(dim) * setting.spread)
    return np.array(out)


@lru_cache
def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng([9, dim]).normal(size=(dim, SIGN_BITS))


def cells(x: np.ndarray, setting: Setting = SETTINGS[0][1]) -> np.ndarray:
    """Keys (n, tables, 1 + probes) of the cells of unit vectors: each table's own cell, then those it probes. A cell is the lattice points of all parts of a
    projection; a probe moves one of them to a neighbour."""
    n, dim = x.shape
    points, probes, around = setting.points, setting.probes, neighbours()
    out = np.empty((n, setting.tables, 1 + probes), dtype=np.uint64)
    rows = np.arange(n)
    for t, p in enumerate(_projections(dim, setting)):
        # einsum, as a vector must have the same cells whatever others it is multiplied with
        y = np.einsum("nd,dk->nk", x, p).reshape(n * points, 8)
        own = decode(y)
        gain = np.einsum("nk,mk->nm", y - own, around).reshape(n, points * len(around))
        nearest = np.argpartition(-gain, probes, axis=1)[:, :probes]
        each = np.repeat(own.reshape(n, 1, points, 8), 1 + probes, axis=1)
        for k in range(probes):
            each[rows, k + 1, nearest[:, k] // len(around)] += around[nearest[:, k] % len(around)]
        each = each.reshape(n, 1 + probes, 8 * points)
        key = np.full(each.shape[:2], np.uint64(1 + t * 65_537 + dim), dtype=np.uint64)
        for k in range(8 * points):
            key = mix(key * np.uint64(0x100000001B3) + (2 * each[:, :, k]).astype(np.int64).astype(np.uint64))
        out[:, t] = key
    return out


def setting_for(n: int) -> Setting:
    """The setting for so many different vectors."""
    return next(s for most, s in SETTINGS if most is None or n <= most)


def unit(lists: pa.Array) -> np.ndarray:
    """Rows of a list array (all of one length) as vectors of length 1, in double precision."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(setting: Setting) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            long = lists.value_lengths().to_numpy()
            for dim in np.unique(long):
                (rows,) = np.nonzero(long == dim)
                for lo in range(0, len(rows), 1000):
                    some = pa.array(rows[lo : lo + 1000])
                    x = unit(lists.take(some))
                    keys = cells(x, setting)
                    signs = np.packbits(x @ _signs(int(dim)) > 0, axis=1).view(np.int64)
                    each = keys.shape[1] * keys.shape[2]
                    ids = batch.column("node").take(some).to_numpy()
                    own = np.zeros(keys.shape, dtype=bool)
                    own[:, :, 0] = True
                    columns = [keys.ravel().view(np.int64), own.ravel(), np.repeat(ids, each), *(np.repeat(signs[:, k], each) for k in range(SIGN_BITS // 64))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "own", "node", "sign0", "sign1"])

    return run


def first_cells(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell to which each pair belongs: in the first table where they meet, the lesser of the cells where they do (0: they never meet)."""
    out = np.zeros(len(a), dtype=np.uint64)
    most = np.uint64(2**64 - 1)
    for t in range(keys.shape[1]):
        x, y = keys[a, t, 0], keys[b, t, 0]
        at_x = np.where((keys[b, t] == x[:, None]).any(axis=1), x, most)
        at_y = np.where((keys[a, t] == y[:, None]).any(axis=1), y, most)
        cell = np.minimum(at_x, at_y)
        new = (out == 0) & (cell < most)
        out[new] = cell[new]
    return out


def _near(s0: np.ndarray, s1: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return differing_bits(s0[a], s0[b]) + differing_bits(s1[a], s1[b]) <= MOST_DIFFERENT


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, offsets in whole_groups(batches, ["cell", "cell_i", "cell_j"]):
        ids, cell, own, block, i, j, s0, s1 = (table.column(c).to_numpy() for c in ("node", "cell", "own", "block", "cell_i", "cell_j", "sign0", "sign1"))
        links = []
        for a, b in pairs_within(offsets):
            here = (own[a] | own[b]) & across(block, i, j, a, b)
            a, b = a[here], b[here]
            near = _near(s0, s1, a, b)
            if near.any():
                links.append((a[near], b[near]))
        if links:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            root = forest(len(ids), a, b)
            within = np.unique(np.concatenate([a, b]))
            name = mix(mix(cell[within].view(np.uint64)) + mix(ids[root[within]].view(np.uint64)) + (i[within].astype(np.uint64) << np.uint64(32)) + j[within].astype(np.uint64))
            # in a cell of two blocks only pairs between them belong to it
            side = np.where(i[within] == j[within], -1, block[within]).astype(np.int32)
            columns = [name.view(np.int64), ids[within], cell[within], side, s0[within], s1[within]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["candidates", "node", "cell", "side", "sign0", "sign1"])


def _verify(setting: Setting) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, offsets in whole_groups(batches, ["candidates", "cell_i", "cell_j"], rows=1024):
            ids, cell, side, block, i, j, s0, s1, copies = (table.column(c).to_numpy() for c in ("node", "cell", "side", "block", "cell_i", "cell_j", "sign0", "sign1", "n_copies"))
            lists = table.column("embedding").combine_chunks()
            dims = lists.value_lengths().to_numpy()
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for dim in np.unique(dims[lo:hi]).tolist():
                    at = lo + np.flatnonzero(dims[lo:hi] == dim)
                    x = unit(lists.take(pa.array(at)))
                    a, b = np.nonzero(np.triu(x @ x.T >= THRESHOLD, 1))
                    p, q = at[a], at[b]
                    here = across(block, i, j, p, q) & ((side[p] < 0) | (side[p] != side[q])) & _near(s0, s1, p, q)
                    if here.any():
                        found.setdefault(dim, []).append((p[here], q[here]))
            # the cells of all rows with a link are found at once
            for pairs in found.values():
                p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
                some, ends = np.unique(np.concatenate([p, q]), return_inverse=True)
                keys = cells(unit(lists.take(pa.array(some))), setting)
                own = first_cells(keys, ends[: len(p)], ends[len(p) :]) == cell[p].view(np.uint64)
                if own.any():
                    yield link_counts(ids, copies, p[own], q[own])

    return run


def near_duplicates(vectors: DataFrame, setting: Setting | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, group_id, kept. The setting is chosen by the number of different vectors where none
    is given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").drop("usable")
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n_copies")).withColumn("node", F.xxhash64("embedding")), "classes")
    setting = setting or setting_for(classes.count())
    hashed = cut(classes.select("node", "embedding").mapInArrow(_hash(setting), "cell long, own boolean, node long, sign0 long, sign1 long"), "cells")
    hot = cut(hashed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / CELL_ROWS)
    found = cut(
        deal_blocks(hashed.join(hot, "cell", "left"), ["cell"], F.col("node"), blocks)
        .drop("n")
        .repartition("cell", "cell_i", "cell_j")
        .sortWithinPartitions("cell", "cell_i", "cell_j")
        .mapInArrow(_candidates, "candidates long, node long, cell long, side int, sign0 long, sign1 long"),
        "candidates",
    )
    drop_scratch(hashed)
    sizes = found.groupBy("candidates").agg(F.count("*").alias("n"))
    dealt = deal_blocks(found.join(sizes, "candidates"), ["candidates"], F.col("node"), F.ceil(F.col("n") / GROUP_ROWS)).drop("n")
    verified = cut(
        dealt.join(classes.select("node", "n_copies", "embedding"), "node")
        .repartition("candidates", "cell_i", "cell_j")
        .sortWithinPartitions("candidates", "cell_i", "cell_j")
        .mapInArrow(_verify(setting), "x long, y long, links long"),
        "verified",
    )
    drop_scratch(found)
    links = verified.groupBy("x").agg(F.sum("links").alias("links"))
    groups = cut(components(verified.select("x", "y")), "groups")
    least = groups.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("group_id"))
    grouped = classes.select("node", "first_id", "n_copies").join(links, F.col("node") == F.col("x"), "left").join(groups.join(least, "component").select("node", "group_id"), "node", "left")
    grouped = grouped.select("node", F.coalesce("group_id", "first_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    linked = good.select("vec_id", F.xxhash64("embedding").alias("node")).join(grouped, "node").select("vec_id", "n_links", "group_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("group_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("group_id"), F.lit(False)))
