"""Toxicity from character n-grams: a linear classifier over features scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its whole lower-cased text. Each is scaled by the log ratio of its
share among toxic and among clean training documents; logistic regression on the scaled features gives the score. Training runs on
the executors in rounds of parameter mixing over a bounded sample of labelled rows; scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: n-gram lengths, hash buckets, and labelled rows the fit may use (the first by hash of the id).
LENGTHS, BUCKETS, SAMPLE = (3, 4, 5), 1 << 18, 8_000
#: Training: parts that learn side by side, rounds of mixing, passes in a round, step, weight decay, smoothing of the counts.
PARTS, ROUNDS, PASSES, STEP, DECAY, SMOOTH = 6, 5, 2, 0.02, 2e-5, 1.0


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of the text's character n-grams, ascending."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen = np.zeros(BUCKETS, dtype=bool)
    for n in LENGTHS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        seen[h & np.uint32(BUCKETS - 1)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """Weight of every bucket, ratio included, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features(text)].sum(dtype=np.float64), -40, 40))))


_VECTORS = pa.schema([("part", pa.int32()), ("vector", pa.binary())])


def _summed(df: DataFrame, make, width: int) -> np.ndarray:
    """Sum of one float32 vector per task; ``make`` gets the task's rows as a list. At most PARTS vectors reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([make(rows).astype(np.float32).tobytes()], pa.binary())], schema=_VECTORS)

    total = np.zeros(width)
    for row in df.mapInArrow(run, "part int, vector binary").collect():
        total += np.frombuffer(row["vector"], dtype=np.float32)
    return total


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from the ``sample`` labelled rows with the smallest hash of their id; labels other than 0 and 1 are left out.

    Without rows of both classes the model answers with the smoothed share of toxic rows.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    vector = F.udf(lambda t: features(t).tobytes(), "binary", useArrow=True)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = rows.select("id", "y", vector("text").alias("found")).repartition(PARTS, "id").sortWithinPartitions(F.xxhash64("id"), "id", "found")
    counted = materialise(found.select("y", "found")).coalesce(PARTS)  # however many tasks would read it back

    def counts(rows: list[dict]) -> np.ndarray:
        out = np.zeros((2, BUCKETS + 1))
        for r in rows:
            out[r["y"], np.frombuffer(r["found"], dtype=np.int32)] += 1
            out[r["y"], BUCKETS] += 1
        return out.ravel()

    clean, toxic = _summed(counted, counts, 2 * (BUCKETS + 1)).reshape(2, BUCKETS + 1)
    bias = float(np.log((toxic[-1] + SMOOTH) / (clean[-1] + SMOOTH)))
    if not toxic[-1] or not clean[-1]:
        return Model(np.zeros(BUCKETS, dtype=np.float32), bias)
    share = lambda c: (c[:-1] + SMOOTH) / (c[:-1] + SMOOTH).sum()
    ratio = np.where(toxic[:-1] + clean[:-1] > 0, np.log(share(toxic) / share(clean)), 0.0)
    weights = np.zeros(BUCKETS + 2)
    weights[BUCKETS] = bias
    for turn in range(ROUNDS):
        start = weights.copy()

        def learn(rows: list[dict], start=start, step=STEP / (1 + turn)) -> np.ndarray:
            w, b = start[:BUCKETS].copy(), start[BUCKETS]
            found = [np.frombuffer(r["found"], dtype=np.int32) for r in rows]
            for _ in range(PASSES):
                for r, at in zip(rows, found, strict=True):
                    scaled = ratio[at]
                    norm = max(1.0, float(scaled @ scaled))
                    wrong = 1 / (1 + np.exp(-np.clip(w[at] @ scaled + b, -40, 40))) - r["y"]
                    w[at] -= step * (wrong * scaled * min(1.0, 400 / norm) + DECAY * w[at])
                    b -= step * wrong * 0.1
            return np.r_[w * len(rows), b * len(rows), len(rows)]

        total = _summed(counted, learn, BUCKETS + 2)
        weights = np.r_[total[: BUCKETS + 1] / total[-1], 0]
    return Model((weights[:BUCKETS] * ratio).astype(np.float32), float(weights[BUCKETS]))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score`` in [0, 1]; null and empty texts get the bias alone, whole texts of any length are read, rows are never dropped."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: of fixed size

    @F.udf("double", useArrow=True)
    def toxic(text: str) -> float:
        return shared.value.score(text)

    return documents.withColumn("score", toxic(F.col(text_col)))
