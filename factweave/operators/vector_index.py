"""Inverted-file index of vectors: k-means cells, stored rows, probing by cell, exact distances inside the probed cells.

Cells are fitted on a bounded sample; every row is stored under its nearest centroid, sorted by cell, so a reader skips files by cell. A
question looks into its nearest cells only. A cell's rows are dealt to parts of bounded size and its questions to blocks, so a group is
one block of questions against one part. How many cells to probe for a wanted recall is measured against the exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scope as scopes
from .lineage import written
from .search import QUERY_BLOCK, SCORES, _best_blocks, _unit, ranked, vector_leg

#: Most cells, sampled rows for each, rows of a part, rounds of the fit, and questions that recall is measured on.
MAX_CELLS, SAMPLED, PART_ROWS, ROUNDS, MEASURED = 4_096, 64, 16_384, 12, 64
#: Rows that a task makes at once when it repeats rows for their cells.
REPEATED = 1 << 15

c = F.col


@dataclass
class VectorIndex:
    """Rows (id, embedding, cell and further columns), sorted by cell, and the cells' unit centroids, nearest first by inner product."""

    rows: DataFrame
    centroids: np.ndarray

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """An index written by :func:`build`; the centroids, at most ``MAX_CELLS``, are read to the driver."""
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array([r.centroid for r in found], dtype=np.float64))


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose embedding has the dimension and only finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(c("embedding").isNotNull() & (F.size("embedding") == dim)).filter(F.coalesce(finite, F.lit(False)))


def nearest_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Each row once for each of its nearest cells."""
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    take = min(probes, len(centroids))
    # neither a batch's distances to all cells nor all its repeated rows are held at once
    step = max(1, min(SCORES // len(centroids), REPEATED // take))

    def place(batches):
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                far = -(_unit(part["embedding"]) @ centroids.T)
                order = np.argsort(far, axis=1, kind="stable")[:, :take]
                yield part.iloc[np.repeat(np.arange(len(part)), take)].assign(cell=order.ravel().astype(np.int32))

    return rows.mapInPandas(place, schema)


def build(vectors: DataFrame, path: str, dim: int, cells: int | None = None) -> VectorIndex:
    """Writes the index of (id, embedding, further columns) below ``path`` and opens it; about sqrt(rows) cells by default.

    Rows without a usable embedding are not in the index. Repeated ids are rows like any other.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim)
    cells = max(1, min(MAX_CELLS, cells or math.isqrt(rows.count())))
    sample = written(_unit_rows(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * cells)).select("unit"))
    if cells > 1 and sample.limit(1).count():
        fitted = KMeans(k=cells, seed=7, maxIter=ROUNDS).fit(sample.select(array_to_vector("unit").alias("features")))
        centroids = _unit(fitted.clusterCenters())
    else:
        centroids = np.eye(1, dim)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    nearest_cells(rows, centroids, 1).repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{path}/rows")
    return VectorIndex.open(spark, path)


def _unit_rows(rows: DataFrame) -> DataFrame:
    """Embeddings as unit vectors for the fit; all-zero ones are left out."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.withColumn("norm", F.sqrt(square)).filter("norm > 0").select(F.transform("embedding", lambda x: x.cast("double") / c("norm")).alias("unit"))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, classes=None) -> DataFrame:
    """Top k by cosine among the rows of each question's ``probes`` nearest cells, inside the allowed classes; ties by id."""
    dim = index.centroids.shape[1]
    live = index.rows.filter(scopes.allowed(c("data_class"), classes)) if "data_class" in index.rows.columns else index.rows
    live = live.select("id", "embedding", "cell")
    asked = nearest_cells(usable(queries.select("query_id", "embedding"), dim), index.centroids, probes)
    sizes = live.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    both = sizes.join(blocks, "cell")
    slot = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    q = asked.join(both, "cell").withColumn("block", slot("query_id", c("blocks"))).withColumn("part", every("parts")).select("query_id", "embedding", "cell", "part", "block")
    v = live.join(both, "cell").withColumn("part", slot("id", c("parts"))).withColumn("block", every("blocks")).select("id", "embedding", "cell", "part", "block")

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return pd.concat(_best_blocks(right["id"].to_numpy(), _unit(left["embedding"]), _unit(right["embedding"]), list(left["query_id"]), k))

    keys = ["cell", "part", "block"]
    return ranked(q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(pair, "query_id string, id string, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact result that was found; 1 if that is empty."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0))).first()[0]


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.9, classes=None) -> int:
    """Smallest power of two of cells whose recall on a bounded sample of questions reaches the target; all cells are exact."""
    few = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    rows = [tuple(r) for r in few.select("query_id", "embedding").collect()]
    few = queries.sparkSession.createDataFrame(rows, few.select("query_id", "embedding").schema)
    exact = vector_leg(few, index.rows, k, classes, index.centroids.shape[1])
    probes = 1
    while probes < len(index.centroids) and recall(search(index, few, k, probes, classes), exact) < target:
        probes *= 2
    return min(probes, len(index.centroids))
