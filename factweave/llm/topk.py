"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into document-range blocks with a forward index (their components), the largest and the smallest value of every term
(dimension). A query's bound for a block is the sum over terms of its value times the block's extreme on that side. A query visits
blocks by falling bound and stops when the next bound is below its k-th score. Query batches meet block groups in a grid, so neither
side is gathered whole; every query brings a floor, the k-th score inside the range it comes from, and so skips blocks anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors in a block; vectors in a group of blocks and queries in a batch of the grid.
BLOCK, GROUP, BATCH = 256, 8_192, 4_096
SCALE = 256.0
_PART = "kind string, dim int, part string, n long, ids binary, matrix binary, low binary, high binary"


def _quantised(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the usable vectors and their components as floor(256 * x)."""
    kept, rows = [], []
    for i, vector in enumerate(column.to_pylist()):
        if vector is None or any(x is None for x in vector):
            continue
        values = np.floor(SCALE * np.asarray(vector, dtype=np.float64))
        if np.isfinite(values).all():
            kept.append(i)
            rows.append(values)
    return np.asarray(kept, dtype=np.int64), rows


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can leave 2**53, in 64-bit integers beyond."""
    largest = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if largest < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _locality(matrix: np.ndarray) -> np.ndarray:
    """Order in which neighbours share the signs of their leading components."""
    signs = matrix[:, :24] > 0
    return np.lexsort(signs.T[::-1]) if matrix.shape[1] else np.arange(len(matrix))


def _parts(block: int, every: int, k: int):
    """Blocks of one range after another, and the range's queries with their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            kept, rows = _quantised(batch.column(1))
            out: list[dict] = []
            for dim in sorted({len(r) for r in rows}):
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                matrix, own = np.array([rows[i] for i in at]).reshape(len(at), dim), ids[kept[at]].astype(np.int64)
                order = _locality(matrix)
                matrix, own = matrix[order], own[order]
                for first in range(0, len(own), block):
                    m, i = matrix[first : first + block], own[first : first + block]
                    out.append({"kind": "block", "dim": dim, "part": f"{i[0]}-{first}", "n": len(i), "ids": i.tobytes(), "matrix": m.tobytes(), "low": m.min(0).tobytes(), "high": m.max(0).tobytes()})
                asked = np.flatnonzero(own % every == 0)
                if len(asked):
                    scores = _products(matrix[asked], matrix)
                    scores[own[asked][:, None] == own[None, :]] = np.iinfo(np.int64).min
                    by_id = np.argsort(own, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(own[by_id]) != 0])
                    scores = np.maximum.reduceat(scores[:, by_id], starts, axis=1)  # an id counts once, with its best score
                    floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(asked), np.iinfo(np.int64).min)
                    out.append({"kind": "query", "dim": dim, "part": f"{own[asked][0]}", "n": len(asked), "ids": own[asked].tobytes(), "matrix": matrix[asked].tobytes(), "low": floor.tobytes(), "high": b""})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return run


_PARTS = pa.schema([("kind", pa.string()), ("dim", pa.int32()), ("part", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id; rows of the same id count once, with their best score."""
    order = np.lexsort((-score, vec, query))
    query, score, vec = query[order], score[order], vec[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])] if len(query) else np.zeros(0, bool)
    query, score, vec = query[new], score[new], vec[new]
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return query[rank < k], score[rank < k], vec[rank < k]


def search_blocks(q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Best k of every query over blocks of (ids, rows, low, high); ``floor`` are scores that k results are known to reach."""
    low, high = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = floor.astype(np.float64)
    empty = np.zeros(0, dtype=np.int64)
    found = (empty, empty, empty)
    for turn in range(len(blocks)):
        mine = order[:, turn]
        active = np.flatnonzero(bounds[np.arange(len(q_ids)), mine] >= kth)  # ties with the k-th may still win by id
        if not len(active):
            break
        hits = [found]
        for b in np.unique(mine[active]):
            at = active[mine[active] == b]
            ids, rows, _, _ = blocks[b]
            scores = _products(queries[at], rows)
            x, y = np.nonzero((scores >= kth[at, None]) & (q_ids[at, None] != ids[None, :]))
            hits.append((at[x], scores[x, y], ids[y]))
        found = _best(*(np.concatenate(h) for h in zip(*hits, strict=True)), k)
        counts = np.bincount(found[0], minlength=len(q_ids))
        ends = np.cumsum(counts) - 1
        full = counts >= k
        kth[full] = np.maximum(kth[full], found[1][ends[full]])
    return found


def _search(k: int):
    def run(blocks: pa.Table, batches: pa.Table) -> pa.Table:
        if not blocks.num_rows or not batches.num_rows:
            return _FOUND.empty_table()
        dim = batches.column("dim")[0].as_py()
        load = lambda b, t: np.frombuffer(b, dtype=t)
        index = [(load(r["ids"], np.int64), load(r["matrix"], np.float64).reshape(-1, dim), load(r["low"], np.float64), load(r["high"], np.float64)) for r in blocks.to_pylist()]
        asked = batches.to_pylist()
        q_ids = np.concatenate([load(r["ids"], np.int64) for r in asked])
        queries = np.concatenate([load(r["matrix"], np.float64).reshape(-1, dim) for r in asked])
        query, score, vec = search_blocks(q_ids, queries, np.concatenate([load(r["low"], np.int64) for r in asked]), index, k)
        return pa.table([pa.array(q_ids[query]), pa.array(vec), pa.array(score)], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """For every row whose id is divisible by ``every``: its k highest integer inner products with all other rows.

    Components become floor(256 * x). Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller id, fewer
    candidates give fewer rows. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
    only vectors of equal length meet. Rows that repeat an id are one candidate (its best score counts) and never their own match.
    An empty table gives an empty result. Scores must fit 64 bits. Further columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL")
    parts = materialise(rows.mapInArrow(_parts(block, every, k), _PART))
    totals = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    groups, batches = -(-totals.get("block", 0) // GROUP) or 1, -(-totals.get("query", 0) // BATCH) or 1
    of = lambda n, salt: F.pmod(F.xxhash64("part", F.lit(salt)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = parts.filter("kind = 'block'").withColumn("grp", of(groups, 1)).withColumn("bat", every_of(batches))
    right = parts.filter("kind = 'query'").withColumn("bat", of(batches, 2)).withColumn("grp", every_of(groups))
    found = left.groupBy("dim", "grp", "bat").cogroup(right.groupBy("dim", "grp", "bat")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
