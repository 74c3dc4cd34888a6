"""Quality from hashed word n-grams: logistic regression by follow-the-regularised-leader updates.

A text's words are runs of letters and digits and runs of punctuation, case kept. Features are hashed words and hashed pairs of
neighbours; a word that repeats the one before counts as a pair of its own, whatever the word. A feature's value is the logarithm of
its count, the text's vector has length one. Training streams a bounded sample of labelled rows through one task per epoch, one update a
row; the gradients' sums are all that is kept. Weights are zero until a feature's sum outweighs the L1 term, so scoring is a sparse dot
product in one pass over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Hash buckets (the last stands for the bias), and labelled rows the fit may use (the first by hash of the id).
BUCKETS, SAMPLE = 1 << 18, 8_000
#: Epochs, step, smoothing of the step, L1 and L2 terms.
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.5, 1.0, 0.1, 0.0
#: Words hashed at a time, and words whose hash a worker remembers before it starts anew.
SLICE, REMEMBERED = 1 << 18, 500_000
WORDS = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, ascending, and their values; the bias comes last with value 1."""
    found, sums = [], []
    words, before = WORDS.finditer(text or ""), None
    while True:
        h = np.fromiter((_HASHES[m[0]] for m in islice(words, SLICE)), np.uint64)
        if not len(h):
            break
        left = np.r_[h[:1] if before is None else before, h[:-1]]
        pair = np.where(left == h, np.uint64(1), left * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F))
        if before is None:
            pair = pair[1:]
        buckets, counts = np.unique(np.r_[h >> np.uint64(20), pair >> np.uint64(11)] % np.uint64(BUCKETS - 1), return_counts=True)
        found.append(buckets)
        sums.append(counts)
        before = h[-1:]
    if not found:
        return np.array([BUCKETS - 1], dtype=np.int32), np.ones(1, dtype=np.float32)
    buckets, at = np.unique(np.concatenate(found), return_inverse=True)
    values = np.log1p(np.bincount(at, weights=np.concatenate(sums)))
    return np.r_[buckets, np.uint64(BUCKETS - 1)].astype(np.int32), np.r_[values / np.sqrt(values @ values), 1.0].astype(np.float32)


def leader(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
    """The weights that minimise the regularised sum of all gradients so far."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


@dataclass
class Model:
    """Weight of every bucket; the last is the bias."""

    weights: np.ndarray

    def score(self, text: str | None) -> float:
        at, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ values, -40, 40))))


def _learn(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One follow-the-regularised-leader update a row, in place."""
    for y, at, x in rows:
        w = leader(z[at], n[at])
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - y) * x
        after = n[at] + gradient * gradient
        z[at] += gradient - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
        n[at] = after


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from the ``sample`` labelled ids with the smallest hash of their id.

    Labels other than 0 and 1 and null ids are left out; an id with several labels has the largest, an id with several texts the
    largest text, so a sample never has more rows than ids. Null texts count as empty. Without rows every weight is zero and every
    score one half. Rows are streamed, so the task's memory is that of the sums and one batch.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))

    @F.udf("binary", useArrow=True)
    def packed(text: str) -> bytes:
        at, values = features(text)
        return at.tobytes() + values.tobytes()

    kept = materialise(texts.select("id", "y", packed("text").alias("found")))
    rows = materialise(kept.coalesce(1).sortWithinPartitions(F.xxhash64("id"), "id").select("y", "found")).coalesce(1)
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(EPOCHS):

        def epoch(batches: Iterator[pa.RecordBatch], start=(z, n)) -> Iterator[pa.RecordBatch]:
            z, n = start[0].copy(), start[1].copy()
            _learn(z, n, ((y, np.frombuffer(f, np.int32, len(f) // 8), np.frombuffer(f, np.float32, len(f) // 8, len(f) // 2)) for b in batches for y, f in zip(b.column("y").to_pylist(), b.column("found").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["z", "n"])

        for row in rows.mapInArrow(epoch, "z binary, n binary").collect():  # one row of fixed size, none for an empty sample
            z, n = np.frombuffer(row["z"]), np.frombuffer(row["n"])
    return Model(leader(z, n).astype(np.float32))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score`` in [0, 1], in place of an input column of that name; all other columns and all rows stay.

    Null and empty texts, and texts of white space only, get the bias alone. Whole texts are read, whatever their length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: of fixed size

    @F.udf("double", useArrow=True)
    def good(text: str) -> float:
        return shared.value.score(text)

    return documents.withColumn("score", good(F.col(text_col)))
