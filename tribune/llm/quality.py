"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are hashed into one table of weights: its words (letters and digits, lower
case) and their pairs, and the shapes of its words (runs of upper, lower, digits and each
other sign, with a mark for a word that repeats the one before) and their pairs. The value of a
feature is its count over the number of words, times a constant, so that length does not matter.

Training takes a bounded sample of the labelled rows (`sample_rows`), chosen by hash of the id. It is dealt
into shards; each shard runs FTRL-proximal over its rows in hash order, and the weights are averaged.
The weights (2**18 numbers at most) travel with the scoring tasks, which take every row's whole text.

Defined cases: a null or empty text has no features and its score is that of the bias; labels that
are null, or whose document is missing, teach nothing; without any labelled row every score is 0.5;
rows that repeat a doc_id are scored each, and one of those with the same label teaches; extra columns are kept unless they bear the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS_HELD, in_slices, mix, text_chunks, with_fields

BITS = 18
SAMPLE_ROWS = 16_000
SHARDS = 4
EPOCHS = 3
SCALE = 12.0
THRESHOLD = 0.3
_VIEWS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class _Words(dict):
    """word -> hash of its letters (high 32 bits) and hash of its shape (low 32 bits)."""

    def __missing__(self, word: str) -> int:
        letters = "".join(filter(str.isalnum, word)).lower()
        kinds = ("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "o" if c.isalpha() else c for c in word)
        shape = "".join(k for k, _ in groupby(kinds))
        self[word] = h = xxhash.xxh32_intdigest(letters) << 32 | xxhash.xxh32_intdigest(shape)
        return h


_SAME = np.uint64(0x5A3E)


def features(texts: list[str], known: _Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """For all words of all texts the feature numbers (4 rows: word, word pair, shape, shape pair), and words per text."""
    words: list[str] = []
    sizes = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = text.split()
        sizes[k] = len(own)
        words += own
    if len(known) > WORDS_HELD:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    word, shape = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(h), dtype=bool)
    first[starts[sizes > 0]] = True
    before_word, before_shape = np.roll(word, 1), np.roll(shape, 1)
    same = (word == before_word) & ~first
    before_word[first] = before_shape[first] = 0
    shape = np.where(same, _SAME, shape)
    out = np.empty((4, len(h)), dtype=np.int64)
    for row, value in enumerate((word, word * np.uint64(0x100000001B3) + before_word, shape, shape * np.uint64(0x100000001B3) + before_shape)):
        out[row] = (mix(value ^ _VIEWS[row]) >> np.uint64(64 - bits)).astype(np.int64)
    return out, sizes


def _mean_weights(weights: np.ndarray, feats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of a text's feature weights over its number of words."""
    total = np.concatenate(([0.0], np.cumsum(weights[feats].sum(axis=0))))
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)


def ftrl(examples: Iterator[tuple[np.ndarray, np.ndarray, float]], size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights after one pass of FTRL-proximal over (feature numbers, values, label)."""
    z, n = np.zeros(size), np.zeros(size)
    for idx, x, y in examples:
        zi, root = z[idx], np.sqrt(n[idx])
        w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0.0)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n[idx] += g * g
        z[idx] += g - (np.sqrt(n[idx]) - root) / alpha * w
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def _examples(rows: DataFrame, bits: int) -> DataFrame:
    """rows (doc_id, label, place, text) with the feature numbers and values of the text instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                idx, x = [], []
                for text in some.column(3).to_pylist():
                    feats, _ = features([text or ""], known, bits)
                    own, counts = np.unique(feats, return_counts=True)
                    idx.append(np.append(own, 1 << bits))
                    x.append(np.append(SCALE * counts / max(feats.shape[1], 1), 1.0))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(idx, pa.list_(pa.int64())), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "place", "idx", "x"])

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "place", "text").mapInArrow(run, "doc_id string, label double, place long, idx array<long>, x array<double>")


def _train_shard(rows: pd.DataFrame, bits: int, epochs: int) -> pd.DataFrame:
    rows = rows.sort_values(["place", "doc_id", "label"], kind="stable")
    examples = [(np.asarray(idx), np.asarray(x), float(y)) for idx, x, y in zip(rows["idx"], rows["x"], rows["label"], strict=True)]
    w = ftrl((e for _ in range(epochs) for e in examples), (1 << bits) + 1)
    (some,) = np.nonzero(w)
    return pd.DataFrame({"idx": some, "weight": w[some]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learnable: Column | None = None, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the features and, last, of the bias. labels: doc_id and the label (0 or 1); learnable:
    which label rows may be learned from. At most about sample_rows of them are; the bound holds whatever the input."""
    known = labels.where(F.col(label).isin(0, 1))
    known = known.where(learnable) if learnable is not None else known
    place = F.xxhash64("doc_id", F.lit("quality"))
    known = known.select("doc_id", F.col(label).cast("double").alias("label"), place.alias("place")).distinct()
    total = known.count()
    keep = min(1.0, sample_rows / max(total, 1))
    sample = known.where(F.pmod("place", F.lit(1 << 20)) < F.lit(int(keep * (1 << 20))))
    # the sample is bounded by sample_rows, whatever the size of the tables, and so may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "place", "text")
    # features, not texts, are shuffled; of rows with one id and label, one teaches
    learned = _examples(texts, bits).groupBy("doc_id", "label", "place").agg(F.min(F.struct("idx", "x")).alias("f")).select("doc_id", "label", "place", "f.*")
    trained = (
        learned.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda rows: _train_shard(rows, bits, epochs), "idx long, weight double")
    )
    mean = trained.groupBy("idx").agg(F.sum("weight").alias("weight")).toPandas()  # 2**bits + 1 rows at most
    w = np.zeros((1 << bits) + 1)
    w[mean["idx"].to_numpy(dtype=np.int64)] = mean["weight"].to_numpy() / shards
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with `score`, the probability of label 1."""
    docs = docs.drop("score")
    bits = int(len(weights) - 1).bit_length() - 1
    names, table, bias = docs.columns, weights[:-1].astype(np.float32) * np.float32(SCALE), float(weights[-1])
    sent = docs.sparkSession.sparkContext.broadcast(table)  # 1 MB
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = _Words(), sent.value
        for batch in batches:
            done = [np.empty(0)]
            for chunk in text_chunks(in_slices(batch.column(at))):
                feats, sizes = features(chunk, known, bits)
                done.append(_mean_weights(own, feats, sizes))
            logit = np.concatenate(done) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))], names=[*names, "score"])

    return docs.mapInArrow(run, with_fields(docs, ("score", "double")))
