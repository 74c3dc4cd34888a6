"""Merkle fixity audit of WARC replicas.

Every record is hashed with its offset; records are gathered by ranges of offsets, ranges by larger ranges, up to one root per file.
Two replicas are compared at the roots, and only below nodes that differ are the next level's nodes looked at, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of the smallest range; children of a node.
RANGE, FANOUT = 1 << 16, 16


def response_record(url: Column, body: Column) -> Column:
    """Bytes of a WARC response record; a null body is empty, a null address is left blank."""
    content = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def _counted(records: DataFrame, file_col: str) -> DataFrame:
    """(file, offset, digest, copies); null files and digests count as empty."""
    rows = records.select(F.coalesce(F.col(file_col).cast("string"), F.lit("")).alias("file"), F.col("offset").cast("long").alias("offset"), F.coalesce("digest", F.lit("")).alias("digest"))
    return rows.groupBy("file", "offset", "digest").agg(F.count("*").alias("copies"))


def tree(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, node, digest), leaves first, up to one node per file.

    ``records`` has ``file``, ``offset``, ``digest`` and ``copies``, once per record; those of equal offset are ordered by digest, and
    those without an offset have no place in a tree. An empty table has one empty level.
    """
    leaf = F.concat_ws(":", F.col("offset").cast("string"), "digest", F.col("copies").cast("string"))
    placed = records.filter("offset IS NOT NULL")
    rows = placed.select("file", F.floor(F.col("offset") / range_bytes).alias("node"), F.struct("offset", leaf.alias("text")).alias("child"))
    levels = []
    while True:
        hashed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("child")), lambda c: c["text"]), "\n"), 256)
        level = materialise(rows.groupBy("file", "node").agg(hashed.alias("digest")))
        levels.append(level)
        if not level.filter("node > 0").limit(1).count():
            return levels
        rows = level.select("file", F.floor(F.col("node") / fanout).alias("node"), F.struct(F.col("node").alias("offset"), F.concat_ws(":", "node", "digest").alias("text")).alias("child"))


def audit(left: DataFrame, right: DataFrame, file_col: str = "file", range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: ``file``, ``offset``, both digests and ``kind`` (changed, missing, extra).

    ``left`` and ``right`` have the file, ``offset`` and ``digest`` of every record. Missing and extra are seen from ``left``. Files
    that only one replica has are reported record by record. Null digests count as empty, null files are one file. Records that repeat
    file and offset are compared as multisets: equal digests cancel out, and what is left on both sides is paired in the order of the
    digests as changed. Records without an offset are compared by file and digest, as missing or extra. Further columns are not read.
    """
    both = [_counted(r, file_col) for r in (left, right)]
    trees = [tree(r, range_bytes, fanout) for r in both]
    height = max(map(len, trees))
    for levels in trees:  # the lower tree's roots stand for themselves further up
        levels += [levels[-1]] * (height - len(levels))
    open_nodes = None
    for a, b in zip(reversed(trees[0]), reversed(trees[1]), strict=True):
        if open_nodes is not None:
            above = open_nodes.select("file", F.col("node").alias("up")).distinct()
            a, b = (x.withColumn("up", F.floor(F.col("node") / fanout)).join(above, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        pair = a.withColumnRenamed("digest", "x").join(b.withColumnRenamed("digest", "y"), ["file", "node"], "full")
        open_nodes = pair.filter(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")
    lost = []  # records that the other side has not, once per copy, numbered within file and offset
    number = F.row_number().over(Window.partitionBy("file", "offset", "side").orderBy("digest"))
    signed = []
    for rows, sign in zip(both, (1, -1), strict=True):
        near = rows.filter("offset IS NOT NULL").withColumn("node", F.floor(F.col("offset") / range_bytes)).join(open_nodes, ["file", "node"], "left_semi").drop("node")
        signed.append(near.unionByName(rows.filter("offset IS NULL")).withColumn("copies", sign * F.col("copies")))
    left_over = signed[0].unionByName(signed[1]).groupBy("file", "offset", "digest").agg(F.sum("copies").alias("more")).filter("more <> 0")
    once = materialise(left_over.withColumn("side", F.signum("more").cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more")))))
    for side, name in ((1, "left_digest"), (-1, "right_digest")):
        lost.append(once.filter(F.col("offset").isNotNull() & (F.col("side") == side)).withColumn("n", number).select("file", "offset", "n", F.col("digest").alias(name)))
    found = lost[0].join(lost[1], ["file", "offset", "n"], "full").drop("n")
    mine = lambda side: F.when(F.col("side") == side, F.col("digest"))
    found = found.unionByName(once.filter("offset IS NULL").select("file", "offset", mine(1).alias("left_digest"), mine(-1).alias("right_digest")))
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return found.select("file", "offset", "left_digest", "right_digest", kind.alias("kind"))
