"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Sketch. Each text becomes the set of hashes of its five-word shingles (words: split at white space, lower
   case; a text of one to four words has one shingle), a digest of that set and 64 MinHash values.
   Rows with equal sets form a class, a node of the graph under a hash of that digest; its smallest doc_id represents it.
2. Candidates. The values are cut into 16 bands; representatives with an equal band meet in a bucket. Buckets of one are
   dropped by a count with partial aggregation before any sketch is shuffled.
3. Bayesian pruning. The values of a candidate pair are compared eight at a time. After n values with m equal, the
   posterior probability (uniform prior) that the similarity reaches the threshold is a Beta tail; a pair goes when
   it falls below the tolerance. A pair that meets in several buckets belongs to that of its first equal band. Pairs live only as index
   arrays inside a task: what leaves it are the groups of representatives that surviving pairs of its bucket connect.
4. Verification. Whole texts of the members are dealt to their groups, and the exact Jaccard similarity of the pairs that survived in
   that bucket, and of no others, is found from shared shingles: each pair is verified once, and a chain of similar
   documents costs as many comparisons as it has candidate pairs. Only link counts and
   a spanning forest of true links leave a task. The groups of the result are the components of these links.

Buckets and groups of any size are dealt into pairs of blocks of bounded size (common.deal_blocks), so a
hot group is work for many tasks; no pair list and no group is ever gathered. With 16 bands of 4 a pair at similarity
0.8 is missed with probability 0.0002, one at 0.9 with 3e-8; pruning at a tolerance of one in a million adds less than that (tests simulate both).

Defined cases: null and empty texts have no shingles and are linked with nothing; repeated rows are copies, each a row of the result and a
link of the others; rows that share a doc_id but not their text are compared like any two; a null doc_id is left out of the join and kept by
filter_first(); extra columns are ignored or kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .common import Words, across, deal_blocks, forest, in_slices, link_counts, mix, pairs_within, text_chunks, whole_groups
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 16, 4
STEP = 8
#: A candidate goes when the probability that it reaches the threshold falls below this.
TOLERANCE = 1e-6
#: Representatives in a block of a bucket; blocks are compared in pairs.
BUCKET_ROWS = 1_000
#: Representatives and characters in a block of a candidate group.
GROUP_ROWS, GROUP_CHARS = 300, 2_000_000
#: Up to so many ids (8 bytes each) are broadcast to filter the documents; beyond, a shuffle joins them.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(texts: list[str], words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts (repeats included), and how many each text has."""
    each: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split()
        counts[k] = len(own)
        each += own
    h = words.hashes(each)
    if not len(h):
        return h, np.zeros(len(texts), dtype=np.int64)
    # a window's hash starts at each word; windows that pass the end of a text take what is left of it
    ends = np.repeat(np.cumsum(counts), counts)
    rolled = np.zeros(len(h), dtype=np.uint64)
    place = np.arange(len(h))
    for k in range(n):
        at = place + k
        inside = at < ends
        rolled = np.where(inside, rolled * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at, len(h) - 1)] + np.uint64(1), rolled)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    use = (place + n <= ends) | (place == starts)
    kept = np.concatenate(([0], np.cumsum(use)))
    last = np.cumsum(counts)
    return mix(rolled[use]), kept[last] - kept[last - counts]


def minhash(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of each set (one row each; sets of no value have the largest number)."""
    out = np.full((len(counts), len(_A)), 2**32 - 1, dtype=np.uint32)
    (some,) = np.nonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(len(_A)):
            out[some, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts) >> np.uint64(32)
    return out


def _beta_tail(m: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold) after m of n values were equal, for a uniform prior: the tail of Beta(m + 1, n - m + 1)."""
    # P(Beta(a, b) > t) = P(Binomial(a + b - 1, t) < a)
    total = n + 1
    return sum(math.comb(total, k) * threshold**k * (1 - threshold) ** (total - k) for k in range(m + 1))


def least_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, size: int = BANDS * BAND_ROWS) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones with which a pair stays) after each step."""
    return [(n, next(m for m in range(n + 1) if _beta_tail(m, n, threshold) >= tolerance)) for n in range(STEP, size + 1, STEP)]


def survivors(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that Bayesian pruning leaves."""
    equal = np.zeros(len(a), dtype=np.int64)
    done = 0
    for n, least in steps:
        equal += (sketch[a, done:n] == sketch[b, done:n]).sum(axis=1)
        stay = equal >= least
        a, b, equal, done = a[stay], b[stay], equal[stay], n
        if not len(a):
            break
    return a, b


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, n_chars, set_digest, sketch, bands of every document with a doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            done = 0
            for texts in text_chunks(in_slices(batch.column(1))):
                values, counts = shingles(texts, words)
                signs = minhash(values, counts)
                ends = np.cumsum(counts)
                sets = [np.unique(values[e - c : e]) for e, c in zip(ends, counts, strict=True)]
                bands = np.zeros((len(texts), BANDS), dtype=np.uint64)
                for k in range(BAND_ROWS):
                    bands = mix(bands * np.uint64(0x100000001B3) + signs[:, k::BAND_ROWS] + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        batch.column(2).slice(done, len(texts)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([len(t) for t in texts], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in signs], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "n_chars", "set_digest", "sketch", "bands"],
                )
                done += len(texts)

    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles int, n_chars int, set_digest binary, sketch binary, bands array<long>")


def _owned(signs: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have their first equal band in the bucket that both are in."""
    equal = (signs[a] == signs[b]).reshape(len(a), BANDS, BAND_ROWS).all(axis=2)
    return equal.argmax(axis=1) == band[a]


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = least_equal()
    for table, offsets in whole_groups(batches, ["band", "cell_i", "cell_j"]):
        ids, key, band, block, i, j = (table.column(c).to_numpy() for c in ("node", "band", "band_no", "block", "cell_i", "cell_j"))
        signs = _sketches(table.column("sketch"))
        left, right = [], []
        for a, b in pairs_within(offsets):
            here = across(block, i, j, a, b)
            a, b = survivors(signs, a[here], b[here], steps)
            own = _owned(signs, band, a, b)
            left.append(a[own])
            right.append(b[own])
        a, b = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (left, right))
        if len(a):
            root = forest(len(ids), a, b)
            within = np.unique(np.concatenate([a, b]))
            name = mix(mix(key[within].view(np.uint64)) + mix(ids[root[within]].view(np.uint64)) + (i[within].astype(np.uint64) << np.uint64(32)) + j[within].astype(np.uint64))
            # in a cell of two blocks only pairs between them belong to it
            side = np.where(i[within] == j[within], -1, block[within]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[within]), pa.array(band[within]), pa.array(side), table.column("sketch").combine_chunks().take(pa.array(within))], names=["candidates", "node", "band_no", "side", "sketch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, steps = Words(), least_equal()
    for table, offsets in whole_groups(batches, ["candidates", "cell_i", "cell_j"], rows=256):
        ids, band, side, block, i, j, copies = (table.column(c).to_numpy() for c in ("node", "band_no", "side", "block", "cell_i", "cell_j", "n_copies"))
        signs, texts = _sketches(table.column("sketch")), table.column("text").to_pylist()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            left, right = [], []
            for a, b in pairs_within(np.array([lo, hi])):
                here = across(block, i, j, a, b) & ((side[a] < 0) | (side[a] != side[b]))
                a, b = survivors(signs, a[here], b[here], steps)
                own = _owned(signs, band, a, b)
                left.append(a[own] - lo)
                right.append(b[own] - lo)
            if not left or not sum(map(len, left)):
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            values, counts = shingles([t or "" for t in texts[lo:hi]], words)
            n, ends = hi - lo, np.cumsum(counts)
            sets = [np.unique(values[e - c : e]) for e, c in zip(ends, counts, strict=True)]
            size = np.array([len(s) for s in sets])
            owner, shingle = np.repeat(np.arange(n), size), np.concatenate(sets)
            order = np.argsort(shingle, kind="stable")
            shingle, owner = shingle[order], owner[order]
            shared = np.empty(len(a), dtype=np.int64)
            by_a = np.argsort(a, kind="stable")
            firsts = np.flatnonzero(np.append(True, np.diff(a[by_a]) > 0))
            for pairs in np.split(by_a, firsts[1:]):
                k = a[pairs[0]]
                # owners of each of its shingles
                first, last = np.searchsorted(shingle, sets[k]), np.searchsorted(shingle, sets[k], side="right")
                long = last - first
                at = np.arange(long.sum()) + np.repeat(first - np.cumsum(long) + long, long)
                shared[pairs] = np.bincount(owner[at], minlength=n)[b[pairs]]
            near = (shared > 0) & (shared >= THRESHOLD * (size[a] + size[b] - shared) - 1e-9)
            if near.any():
                yield link_counts(ids[lo:hi], copies[lo:hi], a[near], b[near])


def _classes(sketches: DataFrame) -> DataFrame:
    """A row per set of shingles: node, set_digest, first (the smallest of its rows: doc_id, text_hash, n_chars), n_copies, sketch, bands."""
    some = sketches.where("n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_hash", "n_chars")).alias("first")
    found = cut(some.groupBy("set_digest").agg(first, F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")
    salt = 0
    while True:  # 64 bits tell billions of sets apart nearly always, and another salt does the rest
        named = found.withColumn("node", F.xxhash64("set_digest", F.lit(salt)))
        if named.groupBy("node").count().where("count > 1").isEmpty():
            return named
        salt += 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, text_hash (xxhash64 of its text), class_id (smallest doc_id with an equal set of shingles), group_id (smallest
    doc_id reached over links), n_links (other rows at the threshold or above, copies included), kept (whether its doc_id and text are those of its
    group's first row: of a group one text stays)."""
    sketches = cut(sketch(docs), "sketch")
    classes = _classes(sketches)
    # buckets with more than one class
    banded = classes.select("node", F.posexplode("bands").alias("band_no", "band"))
    full = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    dealt = deal_blocks(banded.join(full, "band"), ["band"], F.col("node"), F.ceil(F.col("n") / BUCKET_ROWS)).drop("n")
    pruned = cut(
        dealt.join(classes.select("node", "sketch"), "node")
        .repartition("band", "cell_i", "cell_j")
        .sortWithinPartitions("band", "cell_i", "cell_j")
        .mapInArrow(_prune, "candidates long, node long, band_no int, side int, sketch binary"),
        "pruned",
    )
    # exact similarity of the surviving pairs of each group
    rows = pruned.join(classes.select("node", F.col("first.n_chars").alias("n_chars"), "n_copies"), "node")
    sizes = rows.groupBy("candidates").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("chars") / GROUP_CHARS))
    blocks = F.least(blocks, F.col("n"))  # a block of one text is the smallest
    dealt = deal_blocks(rows.join(sizes, "candidates"), ["candidates"], F.col("node"), blocks).drop("n", "chars", "n_chars")
    wanted = cut(pruned.select("node").distinct().join(classes.select("node", "first.doc_id", "first.text_hash"), "node"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # one text for each class, however often its row is repeated
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text"))
    verified = cut(
        texts.join(dealt, "node")
        .repartition("candidates", "cell_i", "cell_j")
        .sortWithinPartitions("candidates", "cell_i", "cell_j")
        .mapInArrow(_verify, "x long, y long, links long"),
        "verified",
    )
    drop_scratch(pruned, wanted)
    links = verified.groupBy("x").agg(F.sum("links").alias("links"))
    groups = cut(components(verified.select("x", "y")), "groups")
    least = groups.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    of_class = classes.select("node", "set_digest", "first", "n_copies").join(links, F.col("node") == F.col("x"), "left").join(groups.join(least, "component").select("node", "least"), "node", "left")
    of_class = of_class.select("set_digest", F.col("first.doc_id").alias("class_id"), F.coalesce("least", "first").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    linked = sketches.where("n_shingles > 0").select("doc_id", "text_hash", "set_digest").join(of_class, "set_digest")
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    linked = linked.select("doc_id", "text_hash", "class_id", F.col("least.doc_id").alias("group_id"), "n_links", kept.alias("kept"))
    alone = sketches.where("n_shingles = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def filter_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that with the smallest doc_id; all columns stay. Of repeated rows of that document any one stays."""
    found = cut(near_duplicates(docs), "found")
    key = [F.col("doc_id").cast("long") == F.col("_doc"), F.xxhash64("text") == F.col("_text")]
    names = [F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")]
    dropped = cut(found.where("not kept").select(*names).distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    kept = docs.join(dropped, key, "left_anti")
    repeated = cut(found.where("kept and n_links > 0").groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    n = repeated.count()
    if not n:
        return kept
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    again = kept.join(repeated, key, "left_semi")
    once = again.groupBy(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text")).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return kept.join(repeated, key, "left_anti").unionByName(once)
