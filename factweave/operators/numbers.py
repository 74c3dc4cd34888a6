"""Numeric comparison: scales, comparable points, limits, topic groups, matrices and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.units import unit_label
from . import skew
from .lineage import written

# Cell text for differing units and the name of a missing unit.
INCOMPARABLE = "единицы измерений различаются"
NO_UNIT = "без единицы"


def scales(findings: DataFrame) -> DataFrame:
    """Smallest, largest and number of normalised values per property and unit."""
    c = F.col
    obs = findings.select(F.explode("observations").alias("o")).select(
        c("o.property_name").alias("property_name"), c("o.normalized_unit").alias("unit"),
        F.explode(F.filter(F.array("o.normalized_value", "o.normalized_min", "o.normalized_max"), lambda v: v.isNotNull())).alias("v"),
    )
    return obs.groupBy("property_name", "unit").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))


def measure_bars(findings: DataFrame) -> DataFrame:
    """Place of each observation on its scale: left edge and width in per cent, by operator."""
    c = F.col
    obs = findings.select("id", F.posexplode("observations").alias("pos", "o")).withColumns({
        "property_name": c("o.property_name"), "unit": c("o.normalized_unit"),
    })
    rows = obs.join(scales(findings), ["property_name", "unit"], "left")
    span = c("hi") - c("lo")
    at = (c("o.normalized_value") - c("lo")) / span * 100
    left = (F.coalesce("o.normalized_min", "lo") - c("lo")) / span * 100
    right = (F.coalesce("o.normalized_max", "hi") - c("lo")) / span * 100
    op = c("o.operator")
    bar = F.when(op == "between", F.struct(left.alias("left"), F.greatest(right - left, F.lit(0.0)).alias("width"))).when(
        c("o.normalized_value").isNotNull(),
        F.when(op.isin("lt", "lte"), F.struct(F.lit(0.0).alias("left"), at.alias("width")))
        .when(op.isin("gt", "gte"), F.struct(at.alias("left"), (100 - at).alias("width")))
        .otherwise(F.struct(at.alias("left"), F.lit(0.0).alias("width"))),
    )
    empty = F.coalesce("o.normalized_value", "o.normalized_min", "o.normalized_max").isNull()
    note = F.when(c("lo").isNull(), "absent").when(empty, "noValue").when(span <= 0, "single")
    return rows.select("id", "pos", "property_name", F.when(note.isNull(), bar).alias("bar"), note.alias("note"))


def points(findings: DataFrame, by: list[str]) -> DataFrame:
    """The widest range of a finding per property and unit: a later observation replaces one it exceeds on either side."""
    c = F.col
    seen = F.transform(
        F.filter("observations", lambda o: M.table_bounds(o).isNotNull()),
        lambda o: F.struct(
            o["property_name"].alias("property_name"), M.comparison_unit(o).alias("unit"),
            M.table_bounds(o)["lo"].alias("lo"), M.table_bounds(o)["hi"].alias("hi"),
        ),
    )
    keyed = findings.select(*by, c("id").alias("finding_id"), seen.alias("seen"))
    keys = F.array_distinct(F.transform("seen", lambda s: F.struct(s["property_name"].alias("p"), s["unit"].alias("u"))))
    first = lambda k: F.filter("seen", lambda s: (s["property_name"] == k["p"]) & (s["unit"] == k["u"]))
    widest = lambda k: F.aggregate(
        first(k), F.element_at(first(k), 1), lambda held, s: F.when((held["lo"] > s["lo"]) | (held["hi"] < s["hi"]), s).otherwise(held)
    )
    return keyed.select(*by, "finding_id", F.explode(F.transform(keys, widest)).alias("w")).select(*by, "finding_id", "w.*")


def chain_disjoint(rows: DataFrame, keys: list[str], hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Per group: do the ranges, sorted by (lo, hi), each start above the end of the one before?

    Large groups are cut into value bins; inside a bin neighbours are compared by a window, between bins by the last range
    of the bin before.
    """
    c = F.col
    cuts = skew.value_cuts(rows, keys, "lo", hot_rows)
    binned = skew.with_bin(rows, keys, "lo", cuts).drop("_cuts")
    w = Window.partitionBy(*keys, "_bin").orderBy("lo", "hi")
    inside = binned.withColumn("_ok", F.coalesce(c("lo") > F.lag("hi").over(w), F.lit(True)))
    bins = inside.groupBy(*keys, "_bin").agg(
        F.min("_ok").alias("ok"), F.min(F.struct("lo", "hi")).alias("first"), F.max(F.struct("lo", "hi")).alias("last")
    )
    b = Window.partitionBy(*keys).orderBy("_bin")
    return bins.withColumn("ok", c("ok") & F.coalesce(c("first.lo") > F.lag("last.hi").over(b), F.lit(True))).groupBy(*keys).agg(
        F.min("ok").alias("disjoint")
    )


def comparisons(findings: DataFrame, by: list[str]) -> DataFrame:
    """Properties in one unit named by two or more findings of a group, with spread, overlap and disjointness.

    ``hi`` is the end of the last range in (lo, hi) order, not the largest end.
    """
    c = F.col
    # Written once: the group sizes, the cuts, the groups and their order read it.
    rows = written(points(findings, by))
    keys = [*by, "property_name", "unit"]
    last = F.max(F.struct("lo", "hi"))["hi"]
    grouped = rows.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min("lo").alias("lo"), last.alias("hi"), F.max("lo").alias("max_lo"), F.min("hi").alias("min_hi"),
        F.min_by("finding_id", F.struct("lo", "hi", "finding_id")).alias("low_id"),
        F.max_by("finding_id", F.struct("lo", "hi", "finding_id")).alias("high_id"),
    ).filter(c("points") >= 2)
    spread = c("hi") - c("lo")
    meets = c("min_hi") >= c("max_lo")
    return grouped.join(chain_disjoint(rows, keys), keys).select(
        *keys, "points", "lo", "hi", spread.alias("spread"), M.spread_ratio(c("lo"), c("hi")).alias("relative"),
        F.when(meets, c("max_lo")).alias("overlap_lo"), F.when(meets, c("min_hi")).alias("overlap_hi"), "disjoint",
        ((c("points") >= 2) & (spread > 0)).alias("diverges"), "low_id", "high_id",
    )


def headline(compared: DataFrame, by: list[str]) -> DataFrame:
    """The comparison with the largest relative spread per group; a missing ratio counts as -1, the wider spread wins ties."""
    w = Window.partitionBy(*by).orderBy(F.coalesce("relative", F.lit(-1.0)).desc(), F.desc("spread"), "property_name", "unit")
    return compared.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def strictest_limits(findings: DataFrame, by: list[str]) -> DataFrame:
    """One limit per group and property: the direction seen first, then its smallest lte or largest gte."""
    c = F.col
    rows = findings.select(*by, c("id").alias("finding_id"), F.posexplode("observations").alias("pos", "o")).withColumn(
        "l", M.detect_limit(c("o"))
    ).filter(c("l").isNotNull()).select(*by, c("o.property_name").alias("property_name"), "finding_id", "pos", "l.*")
    keys = [*by, "property_name"]
    rows = rows.dropna(subset=keys)
    place = F.struct("finding_id", "pos")
    per_kind = rows.groupBy(*keys, "kind").agg(
        F.min(place).alias("seen"),
        F.min_by(F.struct("at", "unit", "origin"), F.struct("at", place)).alias("least"),
        # The first finding that states the largest gte gives its unit and origin; NaN is the largest.
        F.min_by(F.struct("at", "unit", "origin"), F.struct(~F.isnan("at"), -c("at"), place)).alias("most"),
    )
    pick = F.when(c("kind") == "lte", c("least")).otherwise(c("most"))
    chosen = per_kind.groupBy(*keys).agg(F.min_by(F.struct("kind", pick.alias("l")), "seen").alias("f"))
    return chosen.select(*keys, "f.kind", "f.l.at", "f.l.unit", "f.l.origin")


def compare(findings: DataFrame, by: list[str], dimensions: list[str] = ()) -> DataFrame:
    """Comparison matrix in long form: one cell per (group, subject, property).

    A cell joins the distinct values in first-seen order; with differing units each value carries its own unit and the cell
    has none. A requested property without data stays as an empty cell.
    """
    c = F.col
    item = F.coalesce(F.when(c("subject") != "", c("subject")), c("id"))
    base = findings.select(*by, item.alias("item"), "id", "confidence", F.try_element_at("evidence", F.lit(1))["quote"].alias("quote"), "observations")
    rows = base.select("*", F.posexplode("observations").alias("pos", "o")).select(
        *by, "item", c("o.property_name").alias("property_name"), "id", "pos", "confidence", "quote",
        M.format_value(c("o")).alias("plain"), c("o.normalized_unit").alias("unit"),
        F.concat(M.raw_value(c("o")), F.lit(" "), c("o.unit"), F.lit(" ("), M.format_value(c("o")), F.lit(" "), c("o.normalized_unit"), F.lit(")")).alias("full"),
    )
    keys = [*by, "item", "property_name"]
    cell = rows.groupBy(*keys).agg(
        F.count_distinct("unit").alias("units"), F.min("unit").alias("unit"),
        F.max("confidence").alias("confidence"),
    )
    texts = rows.join(cell.select(*keys, "units"), keys).withColumn("text", F.when(c("units") == 1, c("plain")).otherwise(c("full")))
    order = F.struct("id", "pos")
    distinct = texts.groupBy(*keys, "text").agg(F.min(order).alias("at"))
    joined = distinct.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " / ").alias("text")
    )
    best = rows.join(cell.select(*keys, "confidence"), [*keys, "confidence"]).groupBy(*keys).agg(F.min_by("quote", order).alias("evidence"))
    filled = cell.join(joined, keys).join(best, keys).select(
        *keys, F.when(c("units") == 1, c("text")).otherwise(F.concat(F.lit(INCOMPARABLE + ": "), c("text"))).alias("value"),
        F.when(c("units") == 1, c("unit")).alias("unit"), "evidence", "confidence",
    )
    wanted = [d.strip() for d in dimensions if d.strip()]
    if not wanted:
        return filled
    empty = base.select(*by, "item").distinct().withColumn("property_name", F.explode(F.array(*[F.lit(d) for d in wanted])))
    empty = empty.join(filled.select(*keys), keys, "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def limit_violations(cells: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Cells checked against the limit of their property: outside, within or none."""
    c = F.col
    rows = cells.join(
        limits.select(*by, "property_name", "kind", "at", c("unit").alias("limit_unit")), [*by, "property_name"], "left"
    )
    return rows.withColumn("verdict", M.check_limit(F.coalesce("value", F.lit("")), c("unit"), c("kind"), c("at"), c("limit_unit"))).select(
        *cells.columns, "kind", "at", "verdict.*"
    )


TOPIC = ["subject", "predicate"]


def _topics(findings: DataFrame) -> DataFrame:
    return findings.withColumns({k: F.coalesce(k, F.lit("")) for k in TOPIC})


def topic_groups(findings: DataFrame) -> DataFrame:
    """Findings per (subject, predicate): count, sources, comparisons and the headline comparison."""
    rows = _topics(findings)
    size = rows.groupBy(*TOPIC).agg(
        F.count("*").alias("findings"), F.min("id").alias("first_id"),
    )
    second = rows.join(size.select(*TOPIC, "first_id"), TOPIC).filter(F.col("id") > F.col("first_id")).groupBy(*TOPIC).agg(
        F.min("id").alias("second_id")
    )
    sources = rows.select(*TOPIC, F.explode("evidence.document_id").alias("d")).groupBy(*TOPIC).agg(F.count_distinct("d").alias("sources"))
    compared = comparisons(rows, TOPIC)
    counted = compared.groupBy(*TOPIC).agg(F.count("*").alias("comparisons"))
    top = headline(compared, TOPIC).select(*TOPIC, F.col("property_name").alias("headline"), F.col("relative").alias("divergence"))
    # The first comparison of a group is the one with the widest spread.
    w = Window.partitionBy(*TOPIC).orderBy(F.desc("spread"), "property_name", "unit")
    widest = compared.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*TOPIC, "low_id", "high_id")
    return (
        size.join(second, TOPIC, "left").join(sources, TOPIC, "left").join(counted, TOPIC, "left").join(top, TOPIC, "left")
        .join(widest, TOPIC, "left").fillna(0, ["comparisons", "sources"])
    )


def widest_pair(groups: DataFrame) -> DataFrame:
    """Two findings that show a topic: the ends of its widest comparison, else the first two."""
    base = F.coalesce("low_id", "first_id")
    other = F.coalesce("high_id", "second_id")
    # One finding cannot stand on both sides: the first other one of the topic takes its place.
    fallback = F.when(base == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    return groups.select(*TOPIC, base.alias("base"), F.when(other == base, fallback).otherwise(other).alias("other"))


def gap_notes(findings: DataFrame) -> DataFrame:
    """Why a topic or finding cannot be compared: single finding, no common unit, no value, no locator."""
    c = F.col
    groups = topic_groups(findings)
    note = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), *TOPIC, key.alias("id"), "findings")
    pair = note(groups.filter(c("findings") < 2), "pair", c("first_id"))
    unit = note(groups.filter((c("findings") >= 2) & (c("comparisons") == 0)), "unit", c("first_id"))
    rows = _topics(findings).join(groups.select(*TOPIC, "findings"), TOPIC)
    value = note(rows.filter(F.size("observations") == 0), "value", c("id"))
    locator = note(rows.filter(F.size("evidence") == 0), "locator", c("id"))
    return pair.unionByName(unit).unionByName(value).unionByName(locator)


def interval_groups(findings: DataFrame, by: list[str]) -> DataFrame:
    """Envelope of every finding on the common interval of its group and unit; a single point is padded by a tenth."""
    c = F.col
    labels = F.filter(F.transform("observations", lambda o: unit_label(
        F.when(o["normalized_unit"] != "", o["normalized_unit"]).otherwise(o["unit"])
    )), lambda u: u != "")
    rows = findings.select(*by, "id", F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(NO_UNIT)).alias("unit"), M.envelope(c("observations")).alias("e"))
    keys = [*by, "unit"]
    ends = rows.groupBy(*keys).agg(F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"))
    pad = F.when(c("lo") == 0, 1.0).otherwise(F.abs("lo") * 0.1)
    flat = c("lo") == c("hi")
    ends = ends.withColumn("pad", pad).select(
        *keys, F.when(flat, c("lo") - c("pad")).otherwise(c("lo")).alias("lo"), F.when(flat, c("hi") + c("pad")).otherwise(c("hi")).alias("hi")
    )
    span = c("hi") - c("lo")
    left = (c("e.lo") - c("lo")) / span * 100
    right = (c("e.hi") - c("lo")) / span * 100
    shown = c("e").isNotNull() & (span > 0)
    return rows.join(ends, keys).select(
        *keys, "id", "lo", "hi", F.when(shown, F.greatest(F.lit(0.0), F.least(left, F.lit(100.0)))).alias("left"),
        F.when(shown, F.greatest(F.lit(1.0), F.least(right - left, 100 - F.greatest(left, F.lit(0.0))))).alias("width"),
    )


def rivals(findings: DataFrame, by: list[str], hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Findings of one answer about the same subject and predicate whose envelopes do not meet, with the gap."""
    c = F.col
    rows = findings.filter((c("subject") != "") & (c("predicate") != "")).select(
        *by, *TOPIC, c("id").alias("finding_id"), M.envelope(c("observations")).alias("e")
    ).filter(c("e").isNotNull()).select(*by, *TOPIC, "finding_id", "e.lo", "e.hi")
    keys = [*by, *TOPIC]
    cuts = skew.value_cuts(rows, keys, "lo", hot_rows)
    low = skew.with_bin(rows, keys, "hi", cuts)
    low = low.withColumn("_bin", F.explode(F.sequence(c("_bin"), F.size("_cuts")))).select(
        *keys, "_bin", c("finding_id").alias("low"), c("hi").alias("end")
    )
    high = skew.with_bin(rows, keys, "lo", cuts).select(*keys, "_bin", c("finding_id").alias("high"), c("lo").alias("start"))
    found = low.join(high, [*keys, "_bin"]).filter(c("end") < c("start")).withColumn("delta", c("start") - c("end"))
    sides = F.explode(F.array(
        F.struct(c("low").alias("finding_id"), c("high").alias("rival_id")), F.struct(c("high").alias("finding_id"), c("low").alias("rival_id"))
    ))
    return found.select(*keys, sides.alias("s"), "delta").select(*keys, "s.*", "delta")


def filter_range(flt: Column) -> Column:
    """(lo, hi) of a plan filter, open ends as infinities; null without usable values."""
    inf = float("inf")
    make = lambda a, b: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))
    op, v = flt["operator"], flt["value"]
    return (
        F.when(op.isin("between", "range"), F.when(
            flt["min_value"].isNotNull() & flt["max_value"].isNotNull(), make(flt["min_value"], flt["max_value"])
        ))
        .when(v.isNull(), None)
        .when(op.isin("lte", "lt"), make(F.lit(-inf), v))
        .when(op.isin("gte", "gt"), make(v, F.lit(inf)))
        .otherwise(make(v, v))
    )


def filter_coverage(plans: DataFrame, answer_findings: DataFrame, by: str) -> DataFrame:
    """Observations inside each filter of a plan; null when the filter has no range."""
    c = F.col
    flt = plans.select(by, F.posexplode("numeric_filters").alias("filter_pos", "f")).withColumn("r", filter_range(c("f"))).withColumn(
        "prop", F.lower("f.property_name")
    )
    obs = answer_findings.select(by, F.explode("observations").alias("o")).select(
        by, F.lower("o.property_name").alias("prop"), M.table_bounds(c("o")).alias("b")
    ).filter(c("b").isNotNull())
    hits = obs.join(flt.select(by, "prop", "filter_pos", "r"), [by, "prop"]).filter(
        (c("b.hi") >= c("r.lo")) & (c("b.lo") <= c("r.hi"))
    ).groupBy(by, "filter_pos").agg(F.count("*").alias("n"))
    return flt.join(hits, [by, "filter_pos"], "left").select(
        by, "filter_pos", c("f.property_name").alias("property_name"), c("f.operator").alias("operator"),
        F.when(c("r").isNotNull(), F.coalesce("n", F.lit(0))).alias("covered"),
    )


def outside_filter(plans: DataFrame, answer_findings: DataFrame, by: str) -> DataFrame:
    """Observations that a filter of their plan in the same unit leaves out: the ranges do not meet."""
    c = F.col
    rows = answer_findings.join(plans.select(by, "numeric_filters"), by).select(
        by, "id", F.posexplode("observations").alias("pos", "o"), "numeric_filters"
    )
    same = F.filter("numeric_filters", lambda f: (F.lower(f["property_name"]) == F.lower("o.property_name")) & (f["unit"] == c("o.normalized_unit")))
    rows = rows.withColumn("r", filter_range(F.try_element_at(same, F.lit(1)))).withColumn("b", M.table_bounds(c("o")))
    outside = (c("b.hi") < c("r.lo")) | (c("b.lo") > c("r.hi"))
    return rows.select(by, "id", "pos", c("o.property_name").alias("property_name"), F.coalesce(outside, F.lit(False)).alias("outside"))
