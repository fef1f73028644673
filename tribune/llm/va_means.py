"""Centroid clustering of vectors in whole numbers, by a VA-file: most rounds look at a few bits of each component only.

Each component x of a vector becomes the integer floor(1024 x). A VA-file keeps one byte for each of them, the number of the
cell that holds it. For a round's centroids, tables give the least and the largest squared distance that a cell
allows in each dimension; their sums are an interval for the distance to each centroid. Where one centroid's interval ends
before all others begin, the vector is assigned without being read. Full vectors are fetched where intervals overlap, and
where an assignment has changed, as the sums of clusters are kept from round to round and only changes are applied to them.

The byte table, the vectors and the assignments are bucketed by one row number, so that no round shuffles any of them. What the
driver holds are the centroids, their sums and the edges of the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, cut_bucketed, drop_scratch

#: Of what is clustered: components of a vector, centroids, rounds, and what components are multiplied by.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Cells in a dimension, a byte for each.
CELLS = 256
#: Rows on which the edges of the cells are fitted, those first by a hash; the outer cells reach to the extremes of all rows.
SAMPLE = 8192
#: Vectors in a bucket.
BUCKET_ROWS = 200_000
#: Integers up to here have squared distances in 64 bits; larger ones are reckoned with as Python integers.
NARROW = 2**27
#: Sums are added up in parts of so many digits, as decimals of 38.
DIGITS = 27

Batches = Iterator[pa.RecordBatch]


def usable(dimensions: int = DIMENSIONS) -> Column:
    """Whether `embedding` has the dimensions asked, none null or not finite (when multiplied, too)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))
    return F.coalesce((F.size("embedding") == dimensions) & finite, F.lit(False))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of whole numbers, of Python integers if some are large."""
    x = column.flatten().to_numpy().reshape(-1, dimensions)
    if len(x) and np.abs(x).max() > NARROW:
        return np.array([[int(v) for v in row] for row in x], dtype=object)
    return x.astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > NARROW for row in rows for v in row)
    return np.array(rows, dtype=object if wide else np.int64)


def edges_of(sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edges (dimension, CELLS + 1): cell c of a dimension holds the integers from edge c to before edge c + 1."""
    low, high = (np.quantile(sample, q, axis=0) for q in (0.001, 0.999))
    steps = np.arange(CELLS + 1) / CELLS
    edges = np.floor(low[:, None] + steps * (high - low + 1)[:, None]).astype(np.int64)
    edges[:, 0], edges[:, -1] = least, most + 1
    return np.maximum.accumulate(np.clip(edges, least[:, None], most[:, None] + 1), axis=1)


def _number(edges: np.ndarray, dimensions: int) -> Callable[[Batches], Batches]:
    """vectors with their cells; none for vectors beyond the edges, which are those with large integers."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dimensions)
            cells = np.stack([np.searchsorted(edges[d], x[:, d], side="right") - 1 for d in range(dimensions)], axis=1)
            inside = ((x >= edges[:, 0]) & (x < edges[:, -1])).all(axis=1)
            held = [c.tobytes() if ok else None for c, ok in zip(cells.astype(np.uint8), inside, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(held, pa.binary())], names=["row", "vec_id", "v", "cells"])

    return run


def bounds(centroids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance from each centroid that a cell of a dimension allows, (centroid, dimension, cell)."""
    first, last = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
    c = centroids[:, :, None]
    least = np.maximum(0, np.maximum(first - c, c - last)) ** 2
    return least, np.maximum(np.abs(first - c), np.abs(last - c)) ** 2


def decide(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The centroid of each row of cells whose interval ends before all others begin; -1 where intervals overlap."""
    at = np.arange(cells.shape[1])
    low = np.stack([table[at, cells].sum(axis=1) for table in least], axis=1)
    high = np.stack([table[at, cells].sum(axis=1) for table in most], axis=1)
    may = low <= high.min(axis=1)[:, None]
    return np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1)


def _by_cells(centroids: list[list[int]], edges: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        wide = _centroids(centroids).dtype == object
        tables = None if wide else bounds(_centroids(centroids), edges)
        for batch in batches:
            now = np.full(batch.num_rows, -1, dtype=np.int32)
            cells = batch.column("cells")
            some = np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False))
            if len(some) and tables:
                held = np.frombuffer(b"".join(cells.drop_null().to_pylist()), dtype=np.uint8).reshape(len(some), -1)
                now[some] = decide(held, *tables)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("was"), pa.array(now)], names=["row", "was", "now"])

    return run


def _by_vectors(centroids: list[list[int]]) -> Callable[[Batches], Batches]:
    """Assignments of fetched vectors, and after them a row for each cluster with what it has won and lost in this task."""

    def run(batches: Batches) -> Batches:
        k, dimensions = len(centroids), len(centroids[0])
        sums, counts = np.zeros((k, dimensions), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dimensions)
            was, now = batch.column("was").to_numpy(), batch.column("now").to_numpy().copy()
            open_ = now < 0
            now[open_] = distances(x[open_], _centroids(centroids)).argmin(axis=1)
            moved = now != was
            for c in range(k):
                won, lost = moved & (now == c), moved & (was == c)
                sums[c] += x[won].sum(axis=0).astype(object) - x[lost].sum(axis=0).astype(object)
                counts[c] += won.sum() - lost.sum()
            yield _rows(batch.column("row"), now)
        for c in range(k):
            each = [_parts(s) for s in sums[c]]
            for part in range(max(map(len, each)) if counts[c] or any(sums[c]) else 0):
                own = [x[part] if part < len(x) else "0" for x in each]
                columns = [pa.array([None], pa.int64()), pa.array([c], pa.int32()), pa.array([0 if part else counts[c]], pa.int64()), pa.array([part], pa.int32()), pa.array([own])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "now", "n", "part", "sums"])

    return run


def _parts(s: int) -> list[str]:
    """A whole number as parts of DIGITS digits, lowest first, each with its sign."""
    sign, digits = (-1 if s < 0 else 1), str(abs(s))
    return [str(sign * int(digits[max(0, end - DIGITS) : end])) for end in range(len(digits), 0, -DIGITS)]


def _rows(row: pa.Array, now: np.ndarray) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([row, pa.array(now, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string()))], names=["row", "now", "n", "part", "sums"])


def _measure(centroids: list[list[int]]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            d = distances(_matrix(batch.column("v"), len(centroids[0])), _centroids(centroids))
            own = d.argmin(axis=1)
            away = [v if v < 2**63 else None for v in d[np.arange(len(own)), own].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _scaled(x: Column) -> Column:
    """floor(1024 x) as a double; from 2^53 on every double is whole."""
    return F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def _extremes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer of each dimension among vectors without large ones."""
    narrow = rows.where(F.forall("v", lambda x: F.abs(x) <= NARROW)).select(F.posexplode("v").alias("d", "x"))
    found = sorted(narrow.groupBy("d").agg(F.min("x"), F.max("x")).collect())  # a row per dimension
    return np.array([int(r[1]) for r in found]), np.array([int(r[2]) for r in found])


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding) that has the dimensions asked and no null or non-finite component: vec_id, cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of `3:<vec_id>` (a null id counts as empty text; equal ids are ordered by their vectors), all of them where there are
    fewer. Repeated rows count each. Ties go to the smaller centroid. A squared distance or inertia beyond 64 bits is null, and so are sums of such distances. An empty table gives no rows. Other columns are not returned.
    """
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(dimensions))
    scaled = cut(given.select("vec_id", F.transform("embedding", _scaled).alias("v")), "scaled")
    first = scaled.select("v", F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k)
    centroids = [[int(x) for x in r.v] for r in first.collect()]
    if not centroids:
        return given.select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    n = scaled.count()
    buckets = min(max(scaled.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET_ROWS)), 50_000)
    sample = scaled.where(F.forall("v", lambda x: F.abs(x) <= NARROW)).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()
    edges = edges_of(np.stack(sample.v), *_extremes(scaled)) if len(sample) else np.zeros((dimensions, CELLS + 1), dtype=np.int64)
    numbered = scaled.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    file = cut_bucketed(numbered.mapInArrow(_number(edges, dimensions), f"row long, vec_id {dict(given.dtypes)['vec_id']}, v array<double>, cells binary"), "file", "row", buckets)
    drop_scratch(scaled)

    sums, counts = [[0] * dimensions for _ in centroids], [0] * len(centroids)
    state: tuple[DataFrame, ...] = ()
    for _ in range(rounds):
        known = file.select("row", "cells")
        if state:
            marks, exact = state
            known = known.join(marks.select("row", F.col("now").alias("marked")), "row").join(exact.where("row is not null").select("row", F.col("now").alias("found")), "row", "left")
            known = known.select("row", "cells", F.coalesce("found", "marked").alias("was"))
        else:
            known = known.withColumn("was", F.lit(-1))
        marks = cut_bucketed(known.mapInArrow(_by_cells(centroids, edges), "row long, was int, now int"), "marks", "row", buckets, dealt=True)
        wanted = file.select("row", "v").join(marks.where("now < 0 or now <> was"), "row")
        exact = cut_bucketed(wanted.mapInArrow(_by_vectors(centroids), "row long, now int, n long, part int, sums array<string>"), "exact", "row", buckets, dealt=True)
        drop_scratch(*state)
        state = (marks, exact)
        changes = exact.where("row is null").groupBy("now", "part").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dimensions)))
        for r in changes.collect():  # a few rows per centroid
            counts[r.now] += r.n
            sums[r.now] = [s + int(r[f"s{d}"]) * 10 ** (DIGITS * r.part) for d, s in enumerate(sums[r.now])]
        centroids = [[s // m for s in own] if m else old for own, m, old in zip(sums, counts, centroids, strict=True)]
    drop_scratch(*state)
    measured = cut(file.select("vec_id", "v").mapInArrow(_measure(centroids), f"vec_id {dict(given.dtypes)['vec_id']}, cluster int, distance long"), "measured")
    drop_scratch(file)

    whole = F.sum(_whole("distance"))
    inertia = measured.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("cluster_inertia"))
    total = inertia.agg(F.when(F.count("cluster_inertia") == F.count("*"), F.sum("cluster_inertia")).alias("inertia"))  # of a row per centroid
    names = measured.sparkSession.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, centroid string")
    told = F.broadcast(inertia.join(names, "cluster").crossJoin(F.broadcast(total)))  # k rows
    return measured.join(told, "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(cluster_inertia as long)").alias("cluster_inertia"), F.expr("try_cast(inertia as long)").alias("inertia"), F.sha2("centroid", 256).alias("centroid_sha256")
    )
