"""Numeric observations: bounds, filters, limits, ranges and their printed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import label_key

# Signs of the comparison cells and words of the observation text.
OPERATOR_SIGNS = {"gte": "≥", "lte": "≤", "gt": ">", "lt": "<", "eq": "="}
EPSILON = 1e-9


def bounds(obs: Column) -> Column:
    """Normalised range, normalised value, raw range, raw value: the first that exists, as (lo, hi, unit)."""
    make = lambda lo, hi, unit: F.struct(lo.alias("lo"), hi.alias("hi"), unit.alias("unit"))
    return (
        F.when(
            obs["normalized_min"].isNotNull() & obs["normalized_max"].isNotNull(),
            make(obs["normalized_min"], obs["normalized_max"], obs["normalized_unit"]),
        )
        .when(
            obs["normalized_value"].isNotNull(),
            make(obs["normalized_value"], obs["normalized_value"], obs["normalized_unit"]),
        )
        .when(
            obs["min_value"].isNotNull() & obs["max_value"].isNotNull(),
            make(obs["min_value"], obs["max_value"], obs["unit"]),
        )
        .when(obs["value"].isNotNull(), make(obs["value"], obs["value"], obs["unit"]))
    )


def table_bounds(obs: Column) -> Column:
    """Bounds of the comparison tables: each end prefers its normalised form, then the point value."""
    lo = F.coalesce(obs["normalized_min"], obs["min_value"])
    hi = F.coalesce(obs["normalized_max"], obs["max_value"])
    point = F.coalesce(obs["normalized_value"], obs["value"])
    make = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    return F.when(lo.isNotNull() & hi.isNotNull(), make(lo, hi)).when(point.isNotNull(), make(point, point))


def comparison_unit(obs: Column) -> Column:
    """Unit that groups the comparison tables: the normalised one when present."""
    return label_key(F.when(obs["normalized_unit"] != "", obs["normalized_unit"]).otherwise(obs["unit"]))


def observation_matches(obs: Column, flt: Column) -> Column:
    """Does an observation meet a numeric filter in the filter's unit? A missing bound keeps it."""
    raw = obs["unit"] == flt["unit"]
    pick = lambda a, b: F.when(raw, a).otherwise(b)
    value = pick(obs["value"], obs["normalized_value"])
    low = pick(obs["min_value"], obs["normalized_min"])
    high = pick(obs["max_value"], obs["normalized_max"])
    op, at = flt["operator"], flt["value"]
    point = (
        F.when(op == "eq", F.abs(value - at) < EPSILON)
        .when(op == "lt", value < at)
        .when(op == "lte", value <= at)
        .when(op == "gt", value > at)
        .when(op == "gte", value >= at)
        .otherwise(True)
    )
    spread = (
        F.when(op == "eq", (low <= at) & (at <= high))
        .when(op == "lt", low < at)
        .when(op == "lte", low <= at)
        .when(op == "gt", high > at)
        .when(op == "gte", high >= at)
        .otherwise(True)
    )
    inside = (value >= flt["min_value"]) & (value <= flt["max_value"])
    overlap = (low <= flt["max_value"]) & (high >= flt["min_value"])
    ranged = F.coalesce(F.when(value.isNotNull(), inside).otherwise(overlap), F.lit(True))
    pointed = F.coalesce(F.when(value.isNotNull(), point).otherwise(F.when(high.isNotNull(), spread)), F.lit(True))
    comparable = raw | (obs["normalized_unit"] == flt["unit"])
    return F.coalesce(comparable, F.lit(False)) & F.when(op.isin("between", "range"), ranged).otherwise(pointed)


def numeric_filters_keep(observations: Column, filters: Column) -> Column:
    """Every filter finds no comparable observation or at least one that matches."""

    def one(flt: Column) -> Column:
        comparable = F.filter(
            observations,
            lambda o: (o["property_name"] == flt["property_name"])
            & ((o["normalized_unit"] == flt["unit"]) | (o["unit"] == flt["unit"])),
        )
        return (F.size(comparable) == 0) | F.exists(comparable, lambda o: observation_matches(o, flt))

    return F.coalesce(F.forall(filters, one), F.lit(True))


def general_number(col: Column) -> Column:
    """Six significant digits without trailing zeros (the C ``%g`` form)."""
    text = F.regexp_replace(F.format_string("%.6g", col), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.(e|$)", "$1"))


def format_range(lo: Column, hi: Column, unit: Column) -> Column:
    upper = F.when(lo == hi, F.lit("")).otherwise(F.concat(F.lit("–"), general_number(hi)))
    return F.trim(F.concat_ws(" ", F.concat(general_number(lo), upper), unit))


def _shown(col: Column) -> Column:
    """A float as the comparison cells print it: one decimal at least."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, F.concat(col.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(col.cast("string"))


def format_value(obs: Column) -> Column:
    """Cell text with the operator sign; a range prints both ends; no value prints the raw text."""
    sign = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in OPERATOR_SIGNS.items() for x in p]), obs["operator"]), F.lit("")
    )
    return (
        F.when(obs["operator"] == "between", F.concat(_shown(obs["normalized_min"]), F.lit("–"), _shown(obs["normalized_max"])))
        .when(obs["normalized_value"].isNotNull(), F.concat(sign, _shown(obs["normalized_value"])))
        .otherwise(obs["raw_text"])
    )


def raw_value(obs: Column) -> Column:
    return F.coalesce(_shown(obs["value"]), F.lit("None"))


def gap_between(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.when(b_lo > a_hi, b_lo - a_hi).when(a_lo > b_hi, a_lo - b_hi)


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def spread_ratio(lo: Column, hi: Column) -> Column:
    return F.when(finite(lo) & finite(hi) & (hi >= lo) & (lo > 0), (hi - lo) / lo)


def delta_from_base(base: Column, other: Column) -> Column:
    """(ratio, miss): relative change, or why there is none."""
    known = finite(base) & finite(other)
    miss = F.when(~known, "absent").when(base == 0, "zero").when(base < 0, "negative")
    return F.struct(F.when(known & (base > 0), (other - base) / base).alias("ratio"), miss.alias("miss"))


def band(point_lo: Column, point_hi: Column, lo: Column, hi: Column) -> Column:
    """Left edge and width of a value on a scale, per cent; the width is at least 1.5."""
    span = hi - lo
    return F.when(
        span > 0,
        F.struct(
            ((point_lo - lo) / span * 100).alias("left"),
            F.greatest((point_hi - point_lo) / span * 100, F.lit(1.5)).alias("width"),
        ),
    )


def detect_limit(obs: Column) -> Column:
    """(kind, at, unit, origin) of a limit given by the operator, else by its wording; null when it is none."""
    at = F.coalesce(obs["normalized_value"], obs["value"])
    unit = F.coalesce(F.when(obs["normalized_unit"] != "", obs["normalized_unit"]), obs["unit"], F.lit(""))
    op, raw = obs["operator"], obs["raw_text"]
    make = lambda kind, origin: F.struct(
        F.lit(kind).alias("kind"), at.alias("at"), unit.alias("unit"), F.lit(origin).alias("origin")
    )
    return F.when(
        at.isNotNull(),
        F.when(op.isin("lte", "lt"), make("lte", "operator"))
        .when(op.isin("gte", "gt"), make("gte", "operator"))
        .when(raw.rlike("[≤<]") | raw.rlike("не (выше|более)"), make("lte", "wording"))
        .when(raw.rlike("[≥>]") | raw.rlike("выше|не (ниже|менее)"), make("gte", "wording")),
    )


def check_limit(text: Column, unit: Column, kind: Column, at: Column, limit_unit: Column) -> Column:
    """(check, offending): the worst number of a cell against a limit in the same unit."""
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(r"(-?\d+(?:[.,]\d+)?)"), F.lit(1)),
        lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"),
    )
    worst = F.when(kind == "lte", F.array_max(numbers)).otherwise(F.array_min(numbers))
    over = F.when(kind == "lte", worst > at).otherwise(worst < at)
    applies = (text != "") & kind.isNotNull() & (label_key(unit) == label_key(limit_unit)) & (F.size(numbers) > 0)
    verdict = lambda check, value: F.struct(F.lit(check).alias("check"), value.alias("offending"))
    nothing = F.lit(None).cast("double")
    return (
        F.when(F.coalesce(applies, F.lit(False)) & over, verdict("outside", worst))
        .when(F.coalesce(applies, F.lit(False)), verdict("within", nothing))
        .otherwise(verdict("none", nothing))
    )


def envelope(observations: Column) -> Column:
    """Smallest low and largest high over the observations that have bounds."""
    known = F.filter(F.transform(observations, table_bounds), lambda b: b.isNotNull())
    return F.when(
        F.size(known) > 0,
        F.struct(
            F.array_min(F.transform(known, lambda b: b["lo"])).alias("lo"),
            F.array_max(F.transform(known, lambda b: b["hi"])).alias("hi"),
        ),
    )


def all_values(observations: Column) -> Column:
    """All values of an array of observations; adding zero makes a negative zero a zero."""
    fields = ("value", "min_value", "max_value", "normalized_value", "normalized_min", "normalized_max")
    return F.transform(F.array_compact(F.flatten(F.array(*[observations[f] for f in fields]))), lambda v: v + F.lit(0.0))
