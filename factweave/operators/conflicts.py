"""Claims, comparable groups, numeric conflicts, review overlay, research space and coverage gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures, scope as scopes
from ..functions.ids import conflict_pair_id
from . import catalog, dominance, ranks, skew
from .lineage import written

GROUP = ["subject_id", "predicate", "property_name", "unit"]
QUEUE_LIMIT = 500
FACT_LIMIT = 8
GAP_LIMIT = 12
# Rows per place of the queue that are tried before all are read.
HEAD = 16
WIDE_DIMENSION = 8

# Reason texts.
REASON_SAME = "внутри одного тезиса — источник приводит противоречивые числа."
REASON_OTHER = "в непересекающихся диапазонах при совместимых условиях применимости; требуется экспертная проверка источников."


def to_claims(findings: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per observation with a value, of the findings that have evidence."""
    c = F.col
    exploded = findings.filter(F.size("evidence") > 0).select(
        *carry,
        c("id").alias("finding_id"),
        F.coalesce(F.when(c("subject") != "", c("subject")), c("id")).alias("subject_id"),
        F.coalesce(F.when(c("predicate") != "", c("predicate")), F.lit("HAS_PROPERTY")).alias("predicate"),
        "scope",
        F.transform("evidence", lambda e: e["document_id"]).alias("evidence_ids"),
        F.when(c("status") == "consensus", "expert_validated").otherwise("extracted").alias("kind"),
        F.posexplode("observations").alias("index", "obs"),
    )
    b = exploded.withColumn("b", measures.bounds(c("obs"))).filter(c("b").isNotNull())
    return b.select(
        *carry,
        F.concat_ws("#", "finding_id", "obs.property_name", c("index").cast("string")).alias("claim_id"),
        "finding_id", "subject_id", "predicate", c("obs.property_name").alias("property_name"),
        c("b.lo").alias("lo"), c("b.hi").alias("hi"), c("b.unit").alias("unit"), "scope", "evidence_ids", "kind",
    )


def comparable_groups(claims: DataFrame) -> DataFrame:
    """Sizes of the groups whose numbers may be compared, with the pairs a full comparison would look at."""
    n = F.count("*")
    return claims.groupBy(*GROUP).agg(n.alias("claims"), (n * (n - 1) / 2).cast("bigint").alias("pairs"))


def _sides(claims: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Claims repeated once per scope key set ("pattern") that occurs in their group.

    Two claims agree when the values of the keys both carry are equal; with both patterns known that is an equality of
    one text, so agreement becomes a join key instead of a condition on all pairs of a group.
    """
    keys = by + GROUP
    own = F.array_join(F.array_sort(F.map_keys("scope")), "\x1f")
    rows = claims.withColumn("own", own)
    # Written: their true size is known, so where the groups are few the claims stay where they are.
    patterns = written(rows.groupBy(*keys).agg(F.collect_set("own").alias("patterns")))
    wide = rows.join(patterns, keys).withColumn("partner", F.explode("patterns")).drop("patterns")
    both = F.array_intersect(F.split("own", "\x1f"), F.split("partner", "\x1f"))
    shared = scopes.scope_text(
        F.transform(
            F.filter(both, lambda k: k != ""),
            lambda k: F.struct(k.alias("key"), F.try_element_at(F.col("scope"), k).alias("value")),
        )
    )
    return wide.withColumn("shared_scope", shared), keys + ["own", "partner", "shared_scope"]


def detect_conflicts(
    claims: DataFrame, by: list[str] | None = None, hot_rows: int = skew.HOT_ROWS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of claims of one group with disjoint ranges and agreeing scopes; ``carry`` columns come as left_ and right_ ones.

    Every pair is found once, from the claim with the lower range to the claim with the higher one. In large groups the
    lower claim meets only value bins at or above its own, so work follows the number of conflicts, not the square of the
    group, and a hot group is spread over its bins.
    """
    by = by or []
    c = F.col
    rows, bucket = _sides(_worded(claims), by)
    # Both sides of a pair must be cut at the same values, so cuts belong to the unordered pair of patterns.
    rows = rows.select(
        *bucket, F.least("own", "partner").alias("_p"), F.greatest("own", "partner").alias("_q"), *_SIDE, *carry
    )
    place = [*by, *GROUP, "_p", "_q", "shared_scope"]
    cuts = skew.value_cuts(rows, place, "lo", hot_rows)
    low = skew.with_bin(rows, place, "hi", cuts)
    low = low.withColumn("_bin", F.explode(F.sequence(c("_bin"), F.size("_cuts"))))
    high = skew.with_bin(rows, place, "lo", cuts)
    fixed = by + GROUP + ["shared_scope", "_bin"]
    low = low.select(*fixed, c("own").alias("_a"), c("partner").alias("_b"), *[c(x).alias(f"l_{x}") for x in [*_SIDE, *carry]])
    high = high.select(*fixed, c("partner").alias("_a"), c("own").alias("_b"), *[c(x).alias(f"h_{x}") for x in [*_SIDE, *carry]])
    pairs = low.join(high, fixed + ["_a", "_b"]).filter(c("l_hi") < c("h_lo"))
    return pairs.select(*by, *_pair_columns(carry))


_SIDE = ["claim_id", "finding_id", "lo", "hi", "value_text"]


def _pair_columns(carry: tuple[str, ...] = ()) -> list[Column]:
    """Left and right by claim id, with the pair id and the reason."""
    c = F.col
    straight = c("l_claim_id") < c("h_claim_id")
    pick = lambda name: F.when(straight, c(f"l_{name}")).otherwise(c(f"h_{name}"))
    other = lambda name: F.when(straight, c(f"h_{name}")).otherwise(c(f"l_{name}"))
    same = c("l_finding_id") == c("h_finding_id")
    reason = F.concat(
        pick("value_text"), F.lit(" против "), other("value_text"), F.lit(" "),
        F.when(same, F.lit(REASON_SAME)).otherwise(F.lit(REASON_OTHER)),
    )
    return [
        conflict_pair_id(c("l_claim_id"), c("h_claim_id"), c("property_name"), c("shared_scope")).alias("pair_id"),
        c("subject_id"), c("predicate"), c("property_name"), c("unit"),
        pick("claim_id").alias("left_claim_id"), other("claim_id").alias("right_claim_id"),
        pick("finding_id").alias("left_finding_id"), other("finding_id").alias("right_finding_id"),
        c("shared_scope"), same.alias("same_source"), reason.alias("reason"),
        *[side(x).alias(f"{name}_{x}") for x in carry for name, side in (("left", pick), ("right", other))],
    ]


def overlay_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Expert decisions over the candidates; a pair without one is a candidate."""
    decided = reviews.select(
        F.col("candidate_id").alias("pair_id"), F.col("status").alias("_s"), F.col("actor_id").alias("decided_by"),
        F.col("created_at").alias("decided_at"),
    )
    return candidates.join(decided, "pair_id", "left").withColumn("status", F.coalesce("_s", F.lit("candidate"))).drop("_s")


def overlay_conflicts(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """``overlay_reviews`` over ``detect_conflicts``, without moving the pairs, whose number grows with the square of a group.

    A claim carries the reviews whose ``left_finding_id`` is its finding, so a pair finds its own on one of its sides; the pair's id is
    formed only where a review names both of its findings (or no right one).
    """
    c = F.col
    decided = reviews.groupBy(c("left_finding_id").alias("finding_id")).agg(
        F.collect_list(F.struct("candidate_id", "right_finding_id", "status", c("actor_id").alias("decided_by"), c("created_at").alias("decided_at"))).alias("_r")
    )
    pairs = detect_conflicts(claims.join(decided, "finding_id", "left"), carry=("_r",))
    none = F.array().cast(decided.schema["_r"].dataType)
    second = F.when(~c("same_source"), c("right__r"))
    near = F.concat(F.coalesce("left__r", none), F.coalesce(second, none))
    # Not c("pair_id"): that would be formed for every pair.
    own_id = conflict_pair_id(c("left_claim_id"), c("right_claim_id"), c("property_name"), c("shared_scope"))
    named = lambda r: F.coalesce((r["right_finding_id"] == c("left_finding_id")) | (r["right_finding_id"] == c("right_finding_id")), F.lit(True))
    own = F.when(
        c("left__r").isNotNull() | c("right__r").isNotNull(), F.filter(near, lambda r: F.when(named(r), r["candidate_id"] == own_id).otherwise(False))
    )
    rows = pairs.withColumn("_x", F.explode_outer(own)).drop("left__r", "right__r")
    return rows.withColumns({
        "status": F.coalesce("_x.status", F.lit("candidate")), "decided_by": c("_x.decided_by"), "decided_at": c("_x.decided_at")
    }).drop("_x")


def resolve_candidates(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviews whose pair is still a conflict, with both finding ids; ``resolved`` is false for the others.

    Only the findings named by the reviews are compared, so the cost follows the reviews, not all conflicts.
    """
    # Written once: reviews and claims are read on both sides.
    reviews = written(reviews)
    pairs = reviewed_pairs(reviews, _worded(written(to_claims(findings).drop("evidence_ids", "kind"))))
    return reviews.select(F.col("candidate_id").alias("pair_id"), "status").join(
        pairs.select("pair_id", F.col("left_finding_id"), F.col("right_finding_id"), F.lit(True).alias("_hit")), "pair_id", "left"
    ).withColumn("resolved", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _worded(claims: DataFrame) -> DataFrame:
    return claims.withColumn("value_text", measures.format_range(F.col("lo"), F.col("hi"), F.col("unit")))


def reviewed_pairs(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """Current conflicts among the reviewed pairs of findings, from claims with their printed values."""
    c = F.col
    side = lambda p: claims.select(
        *[c(x).alias(f"{p}_{x}") for x in [*_SIDE, "scope", "subject_id", "predicate", "property_name", "unit"]]
    )
    named = reviews.select(
        c("candidate_id").alias("_id"), c("left_finding_id").alias("l_finding_id"), c("right_finding_id").alias("h_finding_id")
    ).distinct()
    same_group = (
        (c("l_subject_id") == c("h_subject_id")) & (c("l_predicate") == c("h_predicate"))
        & (c("l_property_name") == c("h_property_name")) & (c("l_unit") == c("h_unit"))
    )
    high = side("h").withColumnRenamed("h_finding_id", "_h")
    joined = named.join(side("l"), "l_finding_id").join(high, (c("h_finding_id") == c("_h")) & same_group).drop("_h")
    disjoint = (c("l_hi") < c("h_lo")) | (c("h_hi") < c("l_lo"))
    ok = joined.filter(
        disjoint & (c("l_claim_id") != c("h_claim_id")) & scopes.scopes_agree(c("l_scope"), c("h_scope"))
    )
    ok = ok.select(
        "*", c("l_subject_id").alias("subject_id"), c("l_predicate").alias("predicate"), c("l_unit").alias("unit"),
        c("l_property_name").alias("property_name"),
        scopes.scope_text(scopes.shared_scope(c("l_scope"), c("h_scope"))).alias("shared_scope"),
    )
    return ok.select("_id", *_pair_columns()).filter(c("_id") == c("pair_id")).drop("_id").dropDuplicates(["pair_id"])


def conflict_queue(findings: DataFrame, reviews: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The first ``limit`` conflicts: unreviewed before reviewed, then subject, property, claim ids; demo content removed.

    The queue does not enumerate all conflicts. A claim has a conflict when its bucket holds a range wholly above or below
    its own, which the bucket's largest low and smallest high tell. Each of the first 2 x limit such claims without any
    review takes part in an unreviewed pair and a pair has two claims, so at least ``limit`` unreviewed pairs start at or
    before the last of them: later claims need not be paired.
    """
    c = F.col
    corpus = findings.filter(~scopes.is_demo(c("scope")))
    # Written once: the claims feed the bucket ends, both sides of the pairs and the reviewed pairs.
    claims = written(to_claims(corpus).drop("evidence_ids", "kind"))
    reviews = written(reviews)
    rows, bucket = _sides(claims, [])
    ends_of = ["claim_id", "finding_id", "lo", "hi"]
    rows = written(rows.select(*bucket, *ends_of))
    order = [c("subject_id"), c("property_name"), c("claim_id")]
    ends = written(rows.groupBy(*bucket).agg(F.max("lo").alias("max_lo"), F.min("hi").alias("min_hi")))
    # The partner side of a bucket is the bucket with own and partner swapped.
    partner_ends = ends.select(
        *GROUP, c("partner").alias("own"), c("own").alias("partner"), "shared_scope", "max_lo", "min_hi"
    )
    live = rows.join(partner_ends, bucket).filter((c("max_lo") > c("hi")) | (c("min_hi") < c("lo"))).select(*bucket, *ends_of)
    touched = written(reviews.select(F.explode(F.array("left_finding_id", "right_finding_id")).alias("finding_id")).distinct())
    untouched = lambda df: df.join(touched, "finding_id", "left_anti").select(
        "subject_id", "property_name", "claim_id"
    ).distinct().orderBy(*order).limit(2 * limit)
    named = live.select("finding_id", "subject_id", "property_name", "claim_id")
    clean = _from_head(named, order, HEAD * limit, untouched, 2 * limit)
    cut = clean.agg(F.when(F.count("*") == 2 * limit, F.max(F.struct(*order))).alias("cut"))
    lefts = live.filter(F.coalesce(F.struct(*order) <= cut.scalar(), F.lit(True)))
    left = written(lefts.select(
        *GROUP, "shared_scope", c("own").alias("_a"), c("partner").alias("_b"), *[c(x).alias(f"l_{x}") for x in ends_of]
    ))
    right = rows.select(
        *GROUP, "shared_scope", c("partner").alias("_a"), c("own").alias("_b"), *[c(x).alias(f"h_{x}") for x in ends_of]
    )
    met = left.join(right, GROUP + ["shared_scope", "_a", "_b"]).filter(
        (c("l_claim_id") < c("h_claim_id")) & ((c("l_hi") < c("h_lo")) | (c("h_hi") < c("l_lo")))
    )
    rank = [c("subject_id"), c("property_name"), c("left_claim_id"), c("right_claim_id")]

    def unreviewed(df: DataFrame) -> DataFrame:
        formed = written(df.withColumns({f"{m}_value_text": measures.format_range(c(f"{m}_lo"), c(f"{m}_hi"), c("unit")) for m in "lh"}).select(*_pair_columns()))
        known = reviews.select(c("candidate_id").alias("pair_id")).join(formed.select("pair_id"), "pair_id", "left_semi")
        return formed.join(known, "pair_id", "left_anti").orderBy(*rank).limit(limit)

    places = [c("subject_id"), c("property_name"), c("l_claim_id"), c("h_claim_id")]
    fresh = _from_head(met, places, HEAD * limit, unreviewed, limit)
    # Reviewed pairs stand behind the others: where those fill the queue only reviews that leave a candidate one can still come in.
    if fresh.count() == limit:
        open_reviews = written(reviews.filter(F.coalesce("status", F.lit("candidate")) == "candidate"))
        ids = open_reviews.select(F.explode(F.array("left_finding_id", "right_finding_id")).alias("finding_id"))
        seen = reviewed_pairs(open_reviews, _worded(written(claims.join(ids, "finding_id", "left_semi"))))
    else:
        seen = reviewed_pairs(reviews, _worded(claims))
    both = written(fresh.unionByName(seen.orderBy(*rank).limit(limit)))
    theirs = reviews.join(both.select(c("pair_id").alias("candidate_id")), "candidate_id", "left_semi")
    queue = overlay_reviews(both, written(theirs))
    return queue.orderBy((c("status") != "candidate").cast("int"), *rank).limit(limit)


def _from_head(df: DataFrame, order: list[Column], rows: int, first: Callable[[DataFrame], DataFrame], wanted: int) -> DataFrame:
    """``first`` of the frame, written: from its first rows in order if they give as many rows as are wanted, else from all."""
    found = written(first(df.orderBy(*order).limit(rows)))
    return found if found.count() >= wanted else written(first(df))


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Both findings of a confirmed pair become disputed; dismissed pairs leave their findings as they are."""
    hit = (
        reviews.filter(F.col("status") == "confirmed")
        .select(F.explode(F.array("left_finding_id", "right_finding_id")).alias("id")).distinct().withColumn("_hit", F.lit(True))
    )
    return findings.join(hit, "id", "left").withColumn(
        "status", F.when(F.col("_hit"), "disputed").otherwise(F.col("status"))
    ).drop("_hit")


def repeated_decisions(reviews: DataFrame) -> DataFrame:
    """Decisions equal to the one before on the same pair; they are refused."""
    from pyspark.sql import Window

    w = Window.partitionBy("candidate_id").orderBy("created_at", "id")
    return reviews.withColumn("_before", F.lag("status").over(w)).filter(F.col("_before") == F.col("status")).drop("_before")


def conflict_counts(claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, subject, property, conflicts): how many pairs :func:`detect_conflicts` would give, counted without forming them."""
    rows, _ = _sides(claims, by)
    return _counted(rows, by)


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    place = [*by, *GROUP, "shared_scope"]
    ends = rows.select(*place, c("own").alias("_a"), c("partner").alias("_b"), c("hi").alias("value"))
    begins = rows.select(*place, c("partner").alias("_a"), c("own").alias("_b"), c("lo").alias("value"))
    found = dominance.pairs_below(ends, begins, [*place, "_a", "_b"])
    return found.groupBy(*by, "subject_id", "property_name").agg(F.sum("pairs").alias("conflicts"))


def conflict_facts(claims: DataFrame, pool: str, limit: int = FACT_LIMIT) -> DataFrame:
    """Per pool: number of conflicts, the first ``limit`` by subject, property and claim ids, and how many are not shown.

    Work is linear in the claims. Pairs are counted by ranks. A claim conflicts when its range ends below the largest beginning on the
    partner side, or begins above the smallest end there. Every subject and property with conflicts shows one at least, so the first
    ``limit`` of them are enough; in one of them the first 2 x ``limit`` conflicting claims by id take part as the smaller id in
    ``limit`` pairs at least, so only they meet their partners.
    """
    c = F.col
    topic = [pool, "subject_id", "property_name"]
    ends_of = ["claim_id", "finding_id", "lo", "hi"]
    # Each step's small tables are written, so that claims stay where they are when such a table turns out to be small.
    claims = written(claims.select(pool, *GROUP, "scope", *ends_of))
    rows, _ = _sides(claims, [pool])
    place = [pool, *GROUP, "shared_scope"]
    rows = written(rows.select(*place, "own", "partner", *ends_of))
    counts = written(_counted(rows, [pool]))
    first = written(catalog.top_k(counts, [pool], [c("subject_id"), c("property_name")], limit).select(*topic))
    near = rows.join(first, topic)
    across = written(near.groupBy(*place, c("own").alias("partner"), c("partner").alias("own")).agg(F.min("hi").alias("_least"), F.max("lo").alias("_most")))
    conflicting = near.join(across, [*place, "own", "partner"]).filter((c("hi") < c("_most")) | (c("lo") > c("_least")))
    chosen = written(catalog.top_k(conflicting.select(*topic, "claim_id").distinct(), topic, [c("claim_id")], 2 * limit).select(*topic, "claim_id"))
    side = lambda df, own, partner, mark: df.select(*place, c(own).alias("_a"), c(partner).alias("_b"), *[c(x).alias(f"{mark}_{x}") for x in ends_of])
    one, other = written(side(near.join(chosen, [*topic, "claim_id"], "left_semi"), "own", "partner", "x")), side(near, "partner", "own", "y")
    pairs = one.join(other, [*place, "_a", "_b"]).filter((c("x_claim_id") < c("y_claim_id")) & ((c("x_hi") < c("y_lo")) | (c("y_hi") < c("x_lo"))))
    lower = c("x_hi") < c("y_lo")
    both = {f"{mark}_{x}": F.when(lower if mark == "l" else ~lower, c(f"x_{x}")).otherwise(c(f"y_{x}")) for mark in "lh" for x in ends_of}
    # The smaller claim id is the left one: texts and ids are formed for the shown pairs only.
    found = catalog.top_k(pairs, [pool], [c("subject_id"), c("property_name"), c("x_claim_id"), c("y_claim_id")], limit, "pos")
    formed = found.select(*place, "pos", *[v.alias(k) for k, v in both.items()])
    formed = formed.withColumns({f"{m}_value_text": measures.format_range(c(f"{m}_lo"), c(f"{m}_hi"), c("unit")) for m in "lh"})
    shown = formed.select(pool, *_pair_columns(), "pos")
    total = counts.groupBy(pool).agg(F.sum("conflicts").alias("conflicts"))
    return shown.join(total, pool).withColumn("omitted", F.greatest(c("conflicts") - limit, F.lit(0)))


# --- research space and gaps -------------------------------------------------------------------------------------------


def dimension_values(claims: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values per dimension and pool (``by``): scope keys when there are two or more, else subject x property."""
    c = F.col
    scope = claims.select(*by, F.explode("scope").alias("name", "value")).distinct()
    fields = claims.select(
        *by, F.explode(F.create_map(F.lit("subject"), c("subject_id"), F.lit("property"), c("property_name"))).alias("name", "value")
    ).distinct()
    values = scope.withColumn("kind", F.lit("scope")).unionByName(fields.withColumn("kind", F.lit("field")))
    sizes = values.groupBy(*by, "kind", "name").agg(F.count("*").alias("n"))
    choice = sizes.groupBy(*by).agg(
        F.count_if(c("kind") == "scope").alias("scopes"),
        F.count_if((c("kind") == "field") & (c("n") >= 2)).alias("fields"),
    )
    use_fields = (c("scopes") < 2) & (c("fields") == 2)
    return values.join(choice, by).filter(F.when(use_fields, c("kind") == "field").otherwise(c("kind") == "scope")).select(*by, "name", "value")


def research_space(claims: DataFrame, by: list[str]) -> DataFrame:
    """The dimensions of each pool with the number of their values; wide ones have eight or more."""
    sizes = dimension_values(claims, by).groupBy(*by, "name").agg(F.count("*").alias("values"))
    return sizes.withColumn("wide", F.col("values") >= WIDE_DIMENSION)


def gap_summary(claims: DataFrame, by: list[str], limit: int = GAP_LIMIT) -> DataFrame:
    """Combinations of dimension values without a claim, per pool: how many, and the first ``limit``.

    A combination's number is its values' ranks in mixed radix. Free numbers lie between neighbours among the sorted covered numbers,
    so all combinations of a pool count and no product of the dimensions is built. Values and covered numbers are numbered in one
    global order, so a pool that holds most claims spreads over all tasks. Totals are exact up to 38 digits.
    """
    c = F.col
    whole = "decimal(38,0)"
    claims = written(claims.select(*by, "subject_id", "property_name", "scope"))
    values = written(dimension_values(claims, by))
    sizes = values.groupBy(*by, "name").agg(F.count("*").alias("n"))
    names = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("dims"))
    product = lambda dims: F.aggregate(dims, F.lit(1).cast(whole), lambda a, d: (a * d["n"].cast(whole)).cast(whole))
    names = written(names.withColumn("total", product(c("dims"))))
    stride = F.transform(F.sequence(F.lit(1), F.size("dims")), lambda i: product(F.slice(c("dims"), i + 1, F.size("dims"))))
    steps = names.select(*by, F.explode(F.arrays_zip("dims", stride.alias("stride"))).alias("x")).select(
        *by, c("x.dims.name").alias("name"), c("x.dims.n").cast(whole).alias("n"), c("x.stride").alias("stride")
    )
    numbered = ranks.row_numbers(values, [*by, "name"], [c("value")], "_number", "_size")
    ranked = written(numbered.select(*by, "name", "value", (c("_number") - 1).alias("rank")).join(steps, by + ["name"]))
    # Covered combinations: claims that carry every dimension of their pool.
    with_dims = claims.join(names.select(*by, "dims"), by)
    value_of = lambda d: (
        F.coalesce(
            F.try_element_at(c("scope"), d["name"]),
            F.when(d["name"] == "subject", c("subject_id")).when(d["name"] == "property", c("property_name")),
        )
    )
    combos = with_dims.select(*by, F.transform("dims", lambda d: F.struct(d["name"].alias("name"), value_of(d).alias("value"))).alias("combo"))
    combos = combos.filter(~F.exists("combo", lambda x: x["value"].isNull())).distinct()
    placed = combos.select(*by, "combo", F.explode("combo").alias("x")).select(*by, "combo", "x.name", "x.value").join(ranked, by + ["name", "value"])
    taken = written(placed.groupBy(*by, "combo").agg(F.sum((c("rank").cast(whole) * c("stride")).cast(whole)).cast(whole).alias("i")).drop("combo"))
    covered = taken.groupBy(*by).agg(F.count("*").alias("covered"))
    # The end of a pool stands behind its numbers as one more; a hole begins behind the number before.
    marks = written(ranks.row_numbers(taken.unionByName(names.select(*by, c("total").alias("i"))), by, [c("i")], "_number", "_size"))
    one = F.lit(1).cast(whole)
    before = marks.select(*by, (c("_number") + 1).alias("_number"), (c("i") + one).cast(whole).alias("start"))
    holes = marks.join(before, [*by, "_number"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast(whole))).filter(c("start") < c("i"))
    holes = catalog.top_k(holes, by, [c("i")], limit, "hole")
    free = holes.withColumn("off", F.explode(F.sequence(F.lit(0), F.least(c("i") - c("start"), F.lit(limit).cast(whole)).cast("int") - 1)))
    free = free.select(*by, (c("start") + c("off").cast(whole)).cast(whole).alias("i"))
    shown = catalog.top_k(free, by, [c("i")], limit, "pos")
    rank = F.expr("(i % CAST(stride * n AS DECIMAL(38,0))) div stride")
    picked = shown.join(steps, by).withColumn("rank", rank).join(ranked.select(*by, "name", "rank", "value"), by + ["name", "rank"]).groupBy(*by, "pos").agg(
        F.array_sort(F.collect_list(F.struct("name", "value"))).alias("combo")
    ).select(*by, "pos", _combo_text(c("combo")).alias("combo"))
    gaps = picked.groupBy(*by).agg(
        F.count("*").alias("shown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "combo"))), lambda x: x["combo"]), " | ").alias("gaps"),
    )
    out = names.select(*by, "dims", "total").join(covered, by, "left").join(gaps, by, "left").fillna(0, ["covered", "shown"])
    return out.select(
        *by, F.array_join(F.transform("dims", lambda d: F.concat(d["name"], F.lit(":"), d["n"])), "×").alias("dimensions"),
        F.array_join(F.transform(F.filter("dims", lambda d: d["n"] >= WIDE_DIMENSION), lambda d: d["name"]), ", ").alias("wide"),
        "total", "covered", "shown", F.greatest(c("total") - c("covered") - c("shown"), F.lit(0)).cast(whole).alias("omitted"),
        F.coalesce("gaps", F.lit("")).alias("gaps"),
    )


def gap_report(claims: DataFrame, by: list[str], limit: int = GAP_LIMIT) -> DataFrame:
    """``gap_summary`` with what it rests on: claims and findings looked at, combinations without a claim, and a status.

    "success" where gaps are shown, else "warning": every combination is covered, or the pool's claims span no space (no dimensions; the
    figures of the space are null). A pool without claims has no row.
    """
    c = F.col
    claims = written(claims.select(*by, "finding_id", "subject_id", "property_name", "scope"))
    seen = claims.groupBy(*by).agg(F.count("*").alias("claims"), F.count_distinct("finding_id").alias("findings"))
    out = seen.join(gap_summary(claims, by, limit), by, "left")
    status = F.when(c("shown") > 0, "success").otherwise("warning")
    return out.withColumns({"status": status, "uncovered": (c("total") - c("covered")).cast("decimal(38,0)")})


def _combo_text(combo: Column) -> Column:
    return F.array_join(F.transform(combo, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ", ")
