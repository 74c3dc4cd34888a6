"""Byte-level BPE over overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised from its own start; where two neighbours have a pre-token
boundary in common inside their overlap, they agree from there on, so the text is cut at the first such boundary and every chunk
encodes the pieces between its cuts. A text without a common boundary in some overlap (a pre-token longer than that) is pre-tokenised
from its start in one task, whose work is bounded by the text of one row. Short texts are one chunk. Decoding concatenates the bytes of
the ids, gathered from one table of all tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Characters from one chunk's start to the next, and characters two neighbours share.
CHUNK, OVERLAP = 65_536, 2_048
#: A match may depend on so many characters behind its end (the longest contraction of the pattern).
AHEAD = 4
#: Pieces a worker remembers, and bytes of a piece up to which its pairs are scanned for the next merge.
REMEMBERED, SCANNED = 200_000, 128
#: Ids decoded at a time.
GATHERED = 1 << 20
#: White space as the pattern means it (Unicode White_Space).
_SPACE = r"\t-\r\x20\x85\xA0  -     　"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file, read by Spark: lines of base64 token and rank. A vocabulary has a fixed size."""
    url = path if ":" in path.split("/")[0] else f"file://{path}"
    return {base64.b64decode(r[0].split()[0]): int(r[0].split()[1]) for r in spark.read.text(url).collect() if r[0].strip()}


class Merges:
    """Byte pair merging by ids: which pairs of tokens join to a token, and single bytes' ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(ranks.values(), default=0).bit_length()
        #: (left id, right id) as one number to the id of both together, which is its rank
        self.pairs = {left << self.shift | right: rank for both, rank in ranks.items() for i in range(1, len(both)) if (left := ranks.get(both[:i])) is not None and (right := ranks.get(both[i:])) is not None}
        self.byte = [ranks.get(bytes([i])) for i in range(256)]

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost of equals, until no pair has a rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [self.byte[b] for b in piece]
        return self._scanned(parts) if len(parts) <= SCANNED else self._queued(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        """Looks for the lowest rank among all pairs at each step; for short pieces."""
        get, shift, none = self.pairs.get, self.shift, 1 << 62
        ranked = [get(a << shift | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranked:
            best = min(ranked)
            if best == none:
                break
            at = ranked.index(best)
            parts[at : at + 2] = (best,)
            del ranked[at]
            if at:
                ranked[at - 1] = get(parts[at - 1] << shift | best, none)
            if at < len(ranked):
                ranked[at] = get(best << shift | parts[at + 1], none)
        return parts

    def _queued(self, parts: list[int]) -> list[int]:
        """Keeps the pairs in a heap; for long pieces."""
        get, shift = self.pairs.get, self.shift
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (rank := get(a << shift | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (both := get(parts[left] << shift | parts[right])) is not None:
                    heapq.heappush(heap, (both, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]


class _Ids(dict):
    """Piece to its ids as little-endian 32-bit integers.

    Holds at most two generations of ``REMEMBERED`` / 2 pieces; when the newer is full the older goes, so pieces in use stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.merges, self.older = Merges(ranks), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.asarray(self.merges(piece.encode()), dtype="<u4").tobytes()
            if len(piece) > 64:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Pre-tokenises and encodes inside tasks; built once per worker from the broadcast ranks."""

    _built: dict[str, Encoder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = _Ids(ranks)
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]"))

    @classmethod
    def of(cls, key: str, ranks, pattern: str) -> Encoder:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(ranks.value, pattern)
        return cls._built[key]

    @classmethod
    def rest(cls) -> None:
        """Frees the older pieces at a task's end: the worker may serve other stages next."""
        for encoder in cls._built.values():
            encoder.ids.older = {}

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(text)))

    def between(self, text: str, begin: int, end: int) -> bytes:
        out = []
        for m in self.pattern.finditer(text, begin):
            if m.start() >= end:
                break
            out.append(self.ids[m[0]])
        return b"".join(out)

    def starts(self, text: str) -> tuple[list[int], int]:
        """Starts of all pre-tokens, and from where on the chunk's end may have changed them."""
        spans = [m.span() for m in self.pattern.finditer(text)]
        sure = next((a for a, b in spans if b > len(text) - AHEAD), len(text))
        return [a for a, _ in spans], sure


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    """``make`` turns a batch's columns (lists) into the lists of the output columns."""
    arrow = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                piece = batch.slice(first, 512)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(make(*[c.to_pylist() for c in piece.columns]), fields.types, strict=True)], schema=fields)
        Encoder.rest()

    return df.mapInArrow(run, arrow)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``.

    Null counts as empty and has no ids. Repeated rows and null ids are rows like any other; an empty table gives an empty result;
    further columns are not read. No special tokens.
    """
    spark = documents.sparkSession
    shared, key = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex  # a vocabulary: of fixed size
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = "id long, ids binary"

    def direct(ids, texts):
        encoder = Encoder.of(key, shared, pattern)
        return ids, [encoder.encode(t) for t in texts]

    def split(ids, texts):
        out = []
        for i, text in zip(ids, texts, strict=True):
            name, firsts = uuid.uuid4().hex, range(0, max(1, len(text) - overlap), chunk)
            out += [(name, i, k, len(firsts), text[first : first + chunk + overlap]) for k, first in enumerate(firsts)]
        return list(zip(*out, strict=True)) or [[]] * 5

    def boundaries(rows_, ks, counts, texts):
        encoder = Encoder.of(key, shared, pattern)
        heads, tails = [], []
        for k, n, text in zip(ks, counts, texts, strict=True):
            starts, sure = encoder.starts(text)
            heads.append([s for s in starts if k and s < overlap and (s < sure or k == n - 1)])
            tails.append([s - chunk for s in starts if k < n - 1 and chunk <= s <= sure])
        return rows_, ks, heads, tails

    def pieces(rows_, ids, ks, texts, begins, ends):
        encoder = Encoder.of(key, shared, pattern)
        return rows_, ids, ks, [encoder.between(t, b, chunk + e if e is not None else len(t) + 1) for t, b, e in zip(texts, begins, ends, strict=True)]

    def joined(table: pa.Table) -> pa.Table:
        parts = sorted(table.select(["k", "ids"]).to_pylist(), key=lambda r: r["k"])
        return pa.table({"id": table.column("id")[:1], "ids": pa.array([b"".join(r["ids"] for r in parts)], pa.binary())})

    def rejoined(table: pa.Table) -> pa.Table:
        parts = sorted(table.select(["k", "text"]).to_pylist(), key=lambda r: r["k"])
        text = "".join(r["text"][: chunk if r["k"] < len(parts) - 1 else None] for r in parts)
        return pa.table({"id": table.column("id")[:1], "ids": pa.array([Encoder.of(key, shared, pattern).encode(text)], pa.binary())})

    short = _map(rows.filter(F.length("text") <= chunk + overlap), whole, direct)
    chunks = _map(rows.filter(F.length("text") > chunk + overlap), "row string, id long, k int, n int, text string", split)
    chunks = materialise(chunks.repartition("row", "k"))
    marks = materialise(_map(chunks.select("row", "k", "n", "text"), "row string, k int, head array<int>, tail array<int>", boundaries))
    next_head = marks.select("row", (F.col("k") - 1).alias("k"), "head")
    cuts = marks.drop("head").join(next_head, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("tail", "head")).alias("cut"))
    lost = cuts.groupBy("row").agg(F.max(F.col("cut").isNull()).alias("lost"))
    order = Window.partitionBy("row").orderBy("k")
    chunk_cuts = marks.select("row", "k").join(cuts, ["row", "k"], "left").select("row", "k", F.coalesce(F.lag("cut").over(order), F.lit(0)).alias("begin"), F.col("cut").alias("end"))
    bounded = chunks.join(chunk_cuts.join(lost, "row"), ["row", "k"])
    long = _map(bounded.filter("NOT lost").select("row", "id", "k", "text", "begin", "end"), "row string, id long, k int, ids binary", pieces).groupBy("row").applyInArrow(joined, whole)
    rest = bounded.filter("lost").select("row", "id", "k", "text").groupBy("row").applyInArrow(rejoined, whole)
    out = short.unionByName(long).unionByName(rest)
    return out.select(F.col("id").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes``: the concatenated bytes of the ids; null ids give null."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    sizes = np.array([len(t) for t in table], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    shared = encoded.sparkSession.sparkContext.broadcast((sizes, begins, np.frombuffer(b"".join(table), dtype=np.uint8)))  # a vocabulary: of fixed size

    @F.udf("binary", useArrow=True)
    def text_of(ids: bytes):
        if ids is None:
            return None
        sizes, begins, flat = shared.value
        out = []
        for first in range(0, len(ids), 4 * GATHERED):
            part = np.frombuffer(ids, dtype="<u4", count=min(GATHERED, (len(ids) - first) // 4), offset=first)
            size = sizes[part]
            ends = np.cumsum(size)
            out.append(flat[np.repeat(begins[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    return encoded.withColumn("bytes", text_of(F.col(ids_col)))
