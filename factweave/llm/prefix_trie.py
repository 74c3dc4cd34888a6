"""Trie of conversation prefixes by collapsing whole sequences. DataFrame functions, and one streamed hash.

Identical conversations collapse into one weighted sequence with the list of its ends. Sequences that are proper prefixes of others go
out by an anti-join, which leaves the leaves; the prefixes of distinct sequences, weighted, add up to the nodes. A prefix is known by its
depth and two 64-bit exclusive-ors of (position, role, text) hashes, so its key is a running aggregate that stretches of a long
conversation compute apart. Sums over a subtree are sums over the sequences through its top of what stands at or below it in each.

Texts are read, ordered and hashed once; no group is gathered: a long conversation spreads over ranges of the global order and
stretches of ``STRETCH`` turns, a list of ends over pages of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns whose running keys are computed together, and width of the id ranges a list of ends is joined by.
STRETCH, PAGE = 1024, 4096
KEY = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as (conv_id, pos from 1, e1, e2, bytes, n): hashes of role and text, UTF-8 bytes of the text, turns of the conversation.

    Null role or text becomes empty; turns are ordered by number (null first), then role, then text. Rows without an id belong to no
    conversation and are left out.
    """
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ordered.select(
        "conv_id", F.monotonically_increasing_id().alias("place"), F.xxhash64(F.lit(1), "role", "text").alias("e1"),
        F.xxhash64("text", F.lit(2), "role").alias("e2"), F.octet_length("text").cast("long").alias("bytes"),
    )).withColumn("part", F.shiftrightunsigned("place", 33))
    whole = Window.partitionBy("conv_id")  # a row per range of the order, so as many as tasks at most
    pieces = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("here")).select(
        "conv_id", "part", "first", F.sum("here").over(whole).alias("n"),
        F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return placed.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("place") - F.col("first") + 1).alias("pos"), "e1", "e2", "bytes", "n")


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation starts with the first ``heads`` turns of conversation ``base`` and goes on with its own turns after as many.

    ``turns`` as from ``numbered``, ``base`` and ``heads`` (``most`` at most) expressions of conv_id. Returns the turns with ``len``, the
    length of their conversation, and the table of all conversations (conv_id, len), those without turns included.
    """
    turns = materialise(turns)
    sizes = turns.filter("pos = 1").select("conv_id", "n")
    each = sizes.withColumn("base", base).withColumn("h", F.least(heads, F.lit(most)).cast("long")).withColumn("h", F.when(F.col("base") == F.col("conv_id"), F.lit(0)).otherwise(F.col("h")))
    given = each.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    all_ = materialise(given.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    first = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "e1", "e2", "bytes")
    borrowed = all_.filter("lent > 0").join(first, "base").filter("pos <= lent").select("conv_id", "pos", "e1", "e2", "bytes", "len")
    own = turns.join(all_, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "e1", "e2", "bytes", "len")
    return borrowed.unionByName(own), all_.select("conv_id", "len")


def _running(rows: DataFrame, values: dict[str, tuple[str, str]], down: bool) -> DataFrame:
    """Adds running aggregates by ``pos`` within a conversation: name to (SQL aggregate, column); from the end if ``down``."""
    stretch = F.floor(F.col("pos") / STRETCH)
    inner = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("pos") if down else F.asc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy(F.desc("stretch") if down else F.asc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda agg, column, window: F.expr(f"{agg}({column})").over(window)
    marked = rows.withColumn("stretch", stretch)
    totals = marked.filter(F.col("len") >= STRETCH).groupBy("conv_id", "stretch").agg(*[F.expr(f"{agg}({c})").alias(name) for name, (agg, c) in values.items()])
    before = totals.select("conv_id", "stretch", *[over(agg, name, outer).alias(f"_{name}") for name, (agg, _) in values.items()])
    part = marked.withColumns({name: over(agg, c, inner) for name, (agg, c) in values.items()})
    both = part.join(before, ["conv_id", "stretch"], "left")
    add = {"bit_xor": lambda a, b: a.bitwiseXOR(b), "sum": lambda a, b: a + b}
    return both.withColumns({name: add[agg](F.col(name), F.coalesce(f"_{name}", F.lit(0))) for name, (agg, _) in values.items()}).drop("stretch", *[f"_{name}" for name in values])


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of each key's conversation ids, ascending, joined by commas; pages of ids are joined apart and hashed in order."""
    pages = members.groupBy(*KEY, F.floor(F.col("conv_id") / PAGE).alias("page")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for *now, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])
                done = []
        if state:
            done.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])

    return pages.repartition(*KEY).sortWithinPartitions(*KEY, "page").select(*KEY, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: every distinct sequence of first turns, from the empty root.

    Columns, long: ``conv_id``, smallest member, a member being a conversation that starts with the node; ``depth``; ``parent_conv_id``,
    the parent's ``conv_id`` (root: null); ``n_convs``, members; ``n_children``; ``n_leaves``, childless nodes at or below;
    ``saved_tokens``, over the nodes at or below, (``n_convs`` - 1) times the bytes of the last text; and ``ends_sha256``. Conversations
    without turns end in the root. Without conversations there is no node.
    """
    z1, z2 = F.xxhash64("pos", "e1"), F.xxhash64("e2", "pos", F.lit(3))
    keyed = _running(turns.select("conv_id", "pos", "bytes", "len", z1.alias("z1"), z2.alias("z2")), {"k1": ("bit_xor", "z1"), "k2": ("bit_xor", "z2")}, down=False)
    prefixes = materialise(keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("z1")), "p2": F.col("k2").bitwiseXOR(F.col("z2"))}).drop("z1", "z2"))

    nothing = F.lit(0).cast("long")
    ended = prefixes.filter("pos = len").select("conv_id", F.col("len").alias("depth"), "k1", "k2")
    members = ended.unionByName(conversations.filter("len = 0").select("conv_id", nothing.alias("depth"), nothing.alias("k1"), nothing.alias("k2")))
    sequences = materialise(members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")))

    # the prefixes of one conversation of each sequence stand for all of them; the root is everybody's
    kept = prefixes.withColumnRenamed("pos", "depth").join(sequences.select("conv_id", "weight"), "conv_id")
    root = sequences.select("conv_id", nothing.alias("depth"), nothing.alias("bytes"), F.col("depth").alias("len"), *[nothing.alias(c) for c in ("k1", "k2", "p1", "p2")], "weight")
    kept = materialise(kept.unionByName(root))
    longer = kept.filter("depth < len").groupBy(*KEY).agg(F.lit(1).alias("one"))
    leaves = sequences.join(longer, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    counted = kept.join(leaves, "conv_id", "left")
    nodes = materialise(counted.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), nothing).alias("n_leaves"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    ))

    # a node is one depth of its smallest member, whose sequence owns the node's own bytes
    owners = nodes.select("conv_id", "depth", F.lit(True).alias("owner"))
    worth = kept.join(owners, ["conv_id", "depth"], "left").withColumn("worth", F.col("weight") * F.col("bytes") - F.when(F.col("owner"), F.col("bytes")).otherwise(0))
    below = _running(worth.withColumnRenamed("depth", "pos").select("conv_id", "pos", "len", "k1", "k2", "worth"), {"saved": ("sum", "worth")}, down=True)
    saved = below.withColumnRenamed("pos", "depth").groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(saved, KEY).join(children, KEY, "left").join(_ends(members), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return known.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", nothing).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
