"""Exact duplicates by an extendible-hash index kept in shared files. DataFrame functions only.

The index has one entry per distinct 64-bit key of a text: the length of its chain. Its directory starts with one bucket and doubles
until no bucket holds more than ``BUCKET`` entries. Owner tasks take ranges of (bucket, key, page), so each sees all bytes behind its
keys and tells colliding texts apart by comparing them. A chain that is long against the table is cut into pages, so that no owner gets
all copies of one text; the few page heads of such a chain are compared once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Index entries a bucket may hold before it splits, and the deepest directory (so at most 2**16 slots, whatever the input).
BUCKET, DEEPEST = 65_536, 16
#: Copies in one page of a chain, unless the table is so large that 1/1024 of its rows is more: at most 1024 chains have pages.
PAGE, PAGED_CHAINS = 256, 1024


def directory(counts: list[tuple[int, int]], bucket: int = BUCKET, deepest: int = DEEPEST) -> list[tuple[int, int, int]]:
    """(slot, bucket, depth) for every slot in use, from (slot, entries) at the deepest level.

    Doubles the directory as long as some bucket is overfull; buckets that are not keep their depth and span several slots.
    """
    depth, settled = 0, {}
    open_slots = dict(counts)
    while open_slots:
        load: dict[int, int] = {}
        for slot, entries in open_slots.items():
            load[slot >> (deepest - depth)] = load.get(slot >> (deepest - depth), 0) + entries
        for slot in list(open_slots):
            prefix = slot >> (deepest - depth)
            if load[prefix] <= bucket or depth == deepest:
                settled[slot] = (prefix << (deepest - depth), depth)
                del open_slots[slot]
        depth += 1
    return [(slot, start, depth) for slot, (start, depth) in sorted(settled.items())]


def exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, page: int = PAGE) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are copies of each other. Of
    equal texts the row with the largest id stays; a null id stays only where the group has no other. Rows that repeat id and text
    stay or go together and each counts in ``group_size``. An empty table gives an empty result; further columns are not read.
    """
    spark = documents.sparkSession
    entries = documents.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    index = materialise(entries.groupBy("_key").agg(F.count("*").alias("chain")).withColumn("slot", F.shiftrightunsigned("_key", 64 - DEEPEST)))
    slots = index.groupBy("slot").agg(F.count("*").alias("entries"), F.sum("chain").alias("rows")).collect()  # at most 2**16 rows
    total = sum(r["rows"] for r in slots)
    buckets = spark.createDataFrame(directory([(r["slot"], r["entries"]) for r in slots], bucket), "slot LONG, bucket LONG, depth INT")
    size = max(page, -(-total // PAGED_CHAINS))
    paged = index.filter(F.col("chain") > size).select("_key", F.ceil(F.col("chain") / size).alias("pages"))

    def placed(rows: DataFrame) -> DataFrame:
        """Adds the bucket from the directory and the page within a paged chain; both lookups are of bounded size."""
        return (
            rows.withColumn("slot", F.shiftrightunsigned("_key", 64 - DEEPEST)).join(F.broadcast(buckets), "slot")
            .join(F.broadcast(paged), "_key", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
            .withColumn("page", F.pmod(F.xxhash64("_id"), F.col("pages")))
        )

    owned = placed(entries).repartitionByRange("bucket", "_key", "page")
    pages = owned.groupBy("bucket", "_key", "page", "pages", "_text").agg(F.max("_id").alias("newest"), F.count("*").alias("copies"))
    pages = pages.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    heads = materialise(pages.select("_key", "page", "pages", "text_sha256", "newest", "copies", F.when(F.col("pages") > 1, F.col("_text")).alias("_text")))
    single = heads.filter("pages = 1").select("_key", "page", "text_sha256", F.col("newest").alias("keep_id"), F.col("copies").alias("group_size"))
    same = Window.partitionBy("_key", "_text")
    chained = heads.filter("pages > 1").select(
        "_key", "page", "text_sha256", F.max("newest").over(same).alias("keep_id"), F.sum("copies").over(same).alias("group_size"),
    )
    groups = single.unionByName(chained)
    rows = placed(entries).select("_id", "_key", "page", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    return rows.join(groups, ["_key", "page", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def keep_newest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the copies that ``exact_duplicates`` drops."""
    stays = exact_duplicates(documents, id_col, text_col).filter("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    marked = documents.withColumn("_sha", sha)
    return marked.join(stays, marked[id_col].eqNullSafe(stays["_id"]) & (marked["_sha"] == stays["_sha"]), "left_semi").drop("_sha")
