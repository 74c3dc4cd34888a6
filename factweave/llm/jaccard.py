"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Documents of equal shingle set are one node. A small set enumerates subsets of a fixed size that any similar set of its size must share;
a large set scans the inverted lists of its rarest shingles, so many that a similar set must appear in one. The boundary is the largest
size at which a set's subsets cost no more than its lists, whose mean length a fixed-size count sketch of all shingles tells.

Lists are not expanded into all pairs. First only neighbours in each list are compared and linked nodes gathered into components; then,
for every list that still spans several components, its pairs across components are compared. So a large group of near copies costs
about its size, and no link between components is lost. Parities of the shingles' hashes rule most dissimilar pairs out, those across
components inside the join itself: every parity that differs is a shingle that only one side has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, task_count

#: Words in a shingle; similarity as a share of NUMERATOR / DENOMINATOR.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Counters of the shingle sketch, in slices for summing, and bits of the filter of needed documents: both of fixed size.
COUNTERS, SLICES, FILTER_BITS = 1 << 20, 256, 1 << 23
#: Bits of the signature that the join across components compares.
SIGNED = 512
#: Neighbours a node is compared with before components are known.
FIRST = 12
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles; a shorter text is one shingle, an empty one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound what a task holds at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def set_key(shingle_set: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingle_set.tobytes(), seed=len(shingle_set)) - (1 << 63)


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """For each value of the hashes' last bits, whether an odd number of shingles has it: at least SIGNED values, two to four a shingle."""
    size = max(SIGNED, 1 << (2 * len(shingle_set)).bit_length())
    return (np.bincount((shingle_set & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def signature(parity: np.ndarray) -> list[int]:
    """The parities folded to SIGNED bits, as longs."""
    return np.packbits(np.bitwise_xor.reduce(parity.reshape(-1, SIGNED), axis=0)).view(np.int64).tolist()


def _possible(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether the parities leave room for similarity: sets differ in at least as many shingles as parities."""
    while len(a) != len(b):  # fold the longer one
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return (NUMERATOR + DENOMINATOR) * differing <= (DENOMINATOR - NUMERATOR) * (n + m)


def _least(n: int) -> int:
    """Smallest overlap of a set of n with a similar set that is not larger."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _alike(n: int) -> int:
    """Smallest overlap of a set of n with a similar set that is not smaller."""
    return -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR))


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Subset sizes a small set of n enumerates: what it shares with similar small sets of its size or more."""
    return sorted({_least(m) for m in range(n, min(boundary, DENOMINATOR * n // NUMERATOR) + 1)})


def boundary_of(mean_list: float, most: int = 40) -> int:
    """Largest size at which enumerating subsets costs no more than scanning lists of the mean length."""
    best = 0
    for n in range(1, most):
        if sum(math.comb(n, c) for c in subset_sizes(n, DENOMINATOR * n // NUMERATOR)) > (n - _least(n) + 1) * max(1.0, mean_list):
            break
        best = n
    return best


def postings_of(shingle_set: np.ndarray, counts: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is listed and its position for each: -1 for subsets, else the rank of the shingle, rarest first."""
    from itertools import combinations

    n, keys, at = len(shingle_set), [], []
    if n <= boundary:
        for c in subset_sizes(n, boundary):
            own = [xxhash.xxh64_intdigest(np.array(x, dtype=np.uint64).tobytes(), seed=c) for x in combinations(shingle_set.tolist(), c)]
            keys += own
            at += [-1] * len(own)
    if n * DENOMINATOR >= NUMERATOR * (boundary + 1):  # a similar set may be a large one
        order = np.lexsort((shingle_set, counts[shingle_set & np.uint64(COUNTERS - 1)]))[: n - _least(n) + 1]
        keys += shingle_set[order].tolist()
        at += range(len(order))
    return np.array(keys, dtype=np.uint64), np.array(at, dtype=np.int32)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if len(values) else np.zeros(0, np.int64), pa.int64())


_SET_ROWS = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("signature", pa.list_(pa.int64()))])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and size of every document, and the task's share of the sketch."""
    hashes, counts, seen = _Hashes(), np.zeros(COUNTERS, dtype=np.int64), set()
    for batch in _slices(batches):
        nodes, sizes, bits, signatures, fresh = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, hashes)
            nodes.append(set_key(s))
            sizes.append(len(s))
            parity = parities(s)
            bits.append(np.packbits(parity).tobytes())
            signatures.append(signature(parity))
            if nodes[-1] not in seen:
                seen.add(nodes[-1])
                fresh.append(s)
        if fresh:
            at, more = np.unique((np.concatenate(fresh) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
            counts[at] += more
        k = len(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(["doc"] * k), batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int32()), pa.array(bits, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))], schema=_SET_ROWS)
    if counts.any():
        yield pa.RecordBatch.from_pylist([{"kind": "sketch", "slice": i, "counts": c.tobytes()} for i, c in enumerate(np.split(counts, SLICES))], schema=_SET_ROWS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(c, dtype=np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, by alternating large and small stars until nothing moves. ``links`` has ``a``, ``b``."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        edges = materialise(small.distinct())
        before, now = now, mark(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _sets(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs``, from the text of each one's first document.

    A filter of fixed size over the documents' ids spares most others the work; it may let some through, which changes nothing.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.join(needed, "node", "left_semi").filter("least IS NOT NULL").select(F.pmod(F.xxhash64("least"), F.lit(FILTER_BITS)).alias("bit"))
    words = ids.select(F.floor(F.col("bit") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(bit % 32 AS INT))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in words.toLocalIterator():  # at most FILTER_BITS / 32 rows
        table[row["word"]] = row["bits"]
    shared = documents.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, table = _Hashes(), set(), shared.value
        for batch in _slices(batches):
            bit = batch.column(1).to_numpy(zero_copy_only=False)
            open_ = (table[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool) | batch.column(2).to_numpy(zero_copy_only=False)
            nodes, sets = [], []
            for text in batch.column(0).filter(pa.array(open_)).to_pylist():
                s = shingles(text, hashes)
                if (key := set_key(s)) not in seen:
                    seen.add(key)
                    nodes.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    rows = documents.select("text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"), F.col("id").isNull().alias("unnamed"))
    rows = rows.mapInArrow(run, "node long, shingles binary").join(needed, "node", "left_semi")
    return materialise(rows.groupBy("node").agg(F.first("shingles").alias("shingles")))


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _open(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that the parities do not rule out."""
    possible = F.udf(_possible, "boolean", useArrow=True)
    side = lambda name, x: nodes.select(F.col("node").alias(name), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.filter(possible("x_bits", "x_n", "y_bits", "y_n")).select(*pairs.columns)


def _linked(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    sets, similar = _sets(documents, nodes, pairs), F.udf(_similar, "boolean", useArrow=True)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialise(pairs.join(left, "a").join(right, "b").filter(similar("x", "y")).select("a", "b"))


_OWN = [f"at{i} < n{i} - ceil({2 * NUMERATOR} * n{i} / {NUMERATOR + DENOMINATOR}) + 1" for i in (1, 2)]
#: Sizes and positions in a list leave room for similarity: the smaller set is listed early enough, and enough elements follow in both.
_ROOM = (
    f"{DENOMINATOR} * least(n1, n2) >= {NUMERATOR} * greatest(n1, n2) "
    f"AND 1 + least(n1 - at1 - 1, n2 - at2 - 1) >= ceil({NUMERATOR} * (n1 + n2) / {NUMERATOR + DENOMINATOR}) "
    f"AND (n1 <= n2 AND {_OWN[0]} OR n2 <= n1 AND {_OWN[1]})"
)
_DIFFERING = " + ".join(f"bit_count(signature1[{i}] ^ signature2[{i}])" for i in range(SIGNED // 64))
#: Signatures leave room for similarity, as ``_possible`` says of parities.
_CLOSE = f"{NUMERATOR + DENOMINATOR} * ({_DIFFERING}) <= {DENOMINATOR - NUMERATOR} * (n1 + n2)"


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links of similarity 0.8 or more).

    Null and empty texts have no shingles and are linked with nothing: their component is their own id. Equal sets are linked. Rows
    that repeat an id are rows like any other; a null id never is a component's smallest unless it has no other. An empty table gives
    an empty result; further columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(docs.mapInArrow(_describe, "kind string, id long, node long, n long, slice int, counts binary, signature array<long>"), "kind")
    described = rows.filter("kind = 'doc'").select("id", "node", "n")
    nodes = rows.filter("kind = 'doc'").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("counts").alias("bits"), F.first("signature").alias("signature"))
    nodes = materialise(nodes)
    parts = rows.filter("kind = 'sketch'").select("slice", "counts").repartition(task_count(spark), "slice").mapInArrow(_summed, "slice int, counts binary")
    counts = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
    for row in parts.toLocalIterator():  # SLICES rows
        counts[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    counts = counts.ravel()
    total = max(1, int(counts.sum()))
    mean_list = max(1.0, (float((counts.astype(np.float64) ** 2).sum()) - total * total / COUNTERS) / total)
    boundary = boundary_of(mean_list)
    shared = spark.sparkContext.broadcast(counts.astype(np.uint32))  # COUNTERS numbers, whatever the input
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, table = _Hashes(), set(), shared.value
        for batch in _slices(batches):
            keys, nodes, sizes, at = [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, hashes)
                if len(s) and (node := set_key(s)) not in seen:
                    seen.add(node)
                    k, p = postings_of(s, table, boundary)
                    keys.append(k)
                    at.append(p)
                    nodes.append(np.full(len(k), node, dtype=np.int64))
                    sizes.append(np.full(len(k), len(s), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(at))], schema=schema)

    postings = docs.select("text").mapInArrow(listed, "key long, node long, n int, at int").groupBy("key", "node").agg(F.first("n").alias("n"), F.first("at").alias("at"))
    row = Window.partitionBy("key").orderBy("n", F.xxhash64("node", "key"))
    ranked = postings.withColumn("prev", F.lag(F.struct("node", "n", "at")).over(row)).withColumn("next", F.lead("node").over(row))
    lists = materialise(ranked.filter("prev IS NOT NULL OR next IS NOT NULL").select("key", "node", "n", "at", "prev"))
    near = lists.filter("prev IS NOT NULL").select(*[F.col(c).alias(f"{c}1") for c in ("node", "n", "at")], *[F.col(f"prev.{c}").alias(f"{c}2") for c in ("node", "n", "at")])
    near = near.filter(_ROOM).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    near = materialise(_open(near, nodes))
    # tested first: each node with the neighbours it meets most often; the rest is left to the pairs across components
    best = Window.partitionBy("own").orderBy(F.desc("shared"), F.xxhash64("a", "b"))
    chain = near.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("own")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= FIRST)
    chain = materialise(chain.select("a", "b").distinct())
    links = _linked(chain, docs, nodes)
    first = components(links)
    labelled = lists.select("key", "node", "n", "at").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    biggest = spread.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    mixed = materialise(labelled.join(biggest, "key").join(nodes.select("node", "signature"), "node"))
    one = mixed.filter("root <> main").select("key", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "at", "root", "signature")])
    two = mixed.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "at", "root", "signature")])
    across = one.join(two, "key").filter("root1 <> root2").filter(_ROOM).filter(_CLOSE)
    pairs = across.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct().join(chain, ["a", "b"], "left_anti")
    more = _linked(materialise(_open(pairs, nodes)), docs, nodes)
    roots = components(links.unionByName(more))
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return described.join(named, "node").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
