"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only.

Each source has a weight that changes linearly over the run. Its integral, scaled to the source's target, is the source's cumulative
token demand; a document that begins after c tokens of its source is due when the demand reaches c. Inverting the integral gives its
position in [0, 1], and a range sort by position gives the training order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Weights by rank of the source's name, repeating, and how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Weight at the start and at the end of the run, relative to its mean, by the same rank: heavy sources fade, light ones grow.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _nth(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, most: int = MOST) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target``, ``begin``, ``end``. ``sizes`` has ``source``, ``size``.

    Targets share all sizes by weight; those over ``most`` times their source's size stop there and the rest is shared again by weight.
    In order of most * size / weight the stopped sources come first, so running sums tell where sharing ends without a loop. The
    windows here are over the table of sources, after aggregation.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("room", "rank")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(names))
    table = table.withColumn("weight", _nth(F.col("rank"), weights)).withColumn("room", most * F.col("source_size") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    table = table.withColumn("level", level)
    final = F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "rank", "level"))).over(every)["level"]
    target = F.coalesce(F.least(F.col("weight") * final, (most * F.col("source_size")).cast("double")), F.lit(0.0))
    return table.withColumn("target", target.cast("double")).select(
        "source", "source_size", "weight", "target", _nth(F.col("rank"), tuple(a for a, _ in schedules)).alias("begin"),
        _nth(F.col("rank"), tuple(b for _, b in schedules)).alias("end"),
    )


def due(share: Column, begin: Column, end: Column) -> Column:
    """Time at which a linear weight from ``begin`` to ``end`` has brought in ``share`` of its integral."""
    return share * (begin + end) / (begin + F.sqrt(begin * begin + (end * end - begin * begin) * share))


def curriculum(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple = ("*",), **targets) -> DataFrame:
    """One row per document: ``row`` (its columns, or those of ``keep``), ``size``, ``source_size``, ``target``, ``taken``, ``begun``, ``begin``, ``end``.

    Documents of a source stand in the order of the MD5 of their id, so reruns agree. ``taken`` counts words with repeats: every whole
    pass over the source, and in the last pass what the target still asks for; only one document of a source is taken in part.
    Null texts have size 0, a null source is a source of its own, null ids are ordered by text. Repeated rows count as often as they
    stand there. An empty table gives an empty result. ``begun`` is the number of tokens of the source before the document.

    Running sums are built from two levels of about sqrt(rows) steps each, so a source that holds most rows is spread over its slices.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary"))
    rows = documents.select(F.struct(*keep).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("order"))
    sizes = materialise(rows.select("source", "size", "order"))
    digits = max(1, math.ceil(math.log(max(1, sizes.count()), 16) / 2))
    slice_ = F.substring("order", 1, digits)
    by_source = source_targets(sizes, **targets)
    slices = sizes.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    slices = slices.alias("s").join(by_source.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "slice", "before", "source_size", "target", "begin", "end")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null-safe key for the join and the window
    slices = slices.select(named.alias("name"), "slice", "before", "source_size", "target", "begin", "end")
    rows = rows.withColumn("name", named).withColumn("slice", slice_)
    within = Window.partitionBy("name", "slice").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(slices, ["name", "slice"]).withColumn("begun", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    demand = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(F.lit(0))
    rest = demand - passes * F.col("source_size") - F.col("begun")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"), "begun", "begin", "end")


def positions(placed: DataFrame) -> DataFrame:
    """``curriculum``'s rows with the position of each pass over the document, in [0, 1]; empty where nothing of it is taken."""
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    share = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + F.col("begun")) / F.greatest(F.col("target"), F.lit(1.0)))
    return placed.withColumn("positions", F.transform(
        F.when(passes > 0, F.sequence(F.lit(0).cast("long"), (passes - 1).cast("long"))).otherwise(F.array().cast("array<long>")),
        lambda k: due(share(k), F.col("begin"), F.col("end")),
    ))


def training_order(documents: DataFrame, **columns) -> DataFrame:
    """The documents in training order, by range sort; one that is taken in several passes stands there once for each.

    Whole documents only: the one that a target cuts through is taken if at least half of it is asked for. Documents of no words ask
    for nothing and have no place.
    """
    placed = curriculum(documents, **columns)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)) * F.col("size")
    rows = positions(placed.withColumn("taken", whole.cast("long"))).select("row", F.explode("positions").alias("_position"))
    return rows.select("_position", "row.*").orderBy("_position").drop("_position")
