"""Conflicts, gaps and large groups on small made-up claims."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import conflicts as K
from factweave.operators import numbers as N

CLAIMS = "claim_id STRING, finding_id STRING, subject_id STRING, predicate STRING, property_name STRING, lo DOUBLE, hi DOUBLE, unit STRING, scope MAP<STRING,STRING>, evidence_ids ARRAY<STRING>, kind STRING"


def claim(i, lo, hi, scope, subject="ro", prop="rejection", unit="%", finding=None):
    return (f"{i}#{prop}#0", finding or str(i), subject, "HAS_PROPERTY", prop, float(lo), float(hi), unit, scope, ["d"], "extracted")


def brute(rows):
    found = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[2:5] != b[2:5] or a[7] != b[7]:
                continue
            if any(a[8][k] != b[8][k] for k in a[8].keys() & b[8].keys()):
                continue
            if a[6] < b[5] or b[6] < a[5]:
                found.add(tuple(sorted((a[0], b[0]))))
    return found


def pairs(df):
    rows = df.select("left_claim_id", "right_claim_id").collect()
    assert len(rows) == len(set(rows))
    return {tuple(sorted(r)) for r in rows}


def test_scope_and_disjoint_ranges(spark):
    ru, kz = {"geography": "RU"}, {"geography": "KZ"}
    rows = [claim("a", 92, 98, ru), claim("b", 40, 70, ru), claim("c", 30, 50, kz)]
    assert pairs(K.detect_conflicts(spark.createDataFrame(rows, CLAIMS))) == {("a#rejection#0", "b#rejection#0")}


def test_unit_is_part_of_the_group(spark):
    rows = [claim("a", 0.2, 0.3, {}, unit="g/L"), claim("b", 200, 300, {}, unit="mg/L")]
    assert K.detect_conflicts(spark.createDataFrame(rows, CLAIMS)).count() == 0


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_split_groups_give_the_same_pairs(spark, hot_rows):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        scope = {k: v for k, v in (("year", rng.choice("12")), ("geography", rng.choice("AB"))) if rng.random() < 0.7}
        lo = rng.randint(0, 20)
        rows.append(claim(f"c{i:03d}", lo, lo + rng.randint(0, 5), scope, subject=rng.choice(["s", "s", "t"])))
    assert pairs(K.detect_conflicts(spark.createDataFrame(rows, CLAIMS), hot_rows=hot_rows)) == brute(rows)


def test_pair_id_is_symmetric(spark):
    from factweave.functions.ids import conflict_pair_id

    row = spark.range(1).select(
        conflict_pair_id(F.lit("a"), F.lit("b"), F.lit("p"), F.lit("")).alias("x"), conflict_pair_id(F.lit("b"), F.lit("a"), F.lit("p"), F.lit("")).alias("y")
    ).first()
    assert row.x == row.y


def test_gap_of_an_explicit_space(spark):
    rows = [claim("a", 1, 2, {"geography": "RU", "water": "mine"}), claim("b", 1, 2, {"geography": "KZ"})]
    df = spark.createDataFrame(rows, CLAIMS).withColumn("pool", F.lit("p"))
    out = K.gap_summary(df, ["pool"]).first()
    assert (out.total, out.covered, out.shown, out.omitted, out.gaps) == (2, 1, 1, 0, "geography=KZ, water=mine")


def test_gap_limit_and_omitted(spark):
    rows = [claim(f"{g}{r}", 1, 2, {"geography": g, "regime": str(r), "reagent": str(r % 2)}) for g in "ABCD" for r in range(1)]
    rows += [claim("x", 1, 2, {"geography": "A", "regime": "1", "reagent": "1"}), claim("y", 1, 2, {"geography": "A", "regime": "2", "reagent": "0"})]
    df = spark.createDataFrame(rows, CLAIMS).withColumn("pool", F.lit("p"))
    out = K.gap_summary(df, ["pool"]).first()
    assert out.total == 24 and out.shown == 12 and out.omitted == out.total - out.covered - 12


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_chain_of_ranges(spark, hot_rows):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        ranges = sorted((float(lo), float(lo + rng.randint(0, 3))) for lo in rng.sample(range(60), rng.randint(2, 12)))
        rows += [(str(g), lo, hi) for lo, hi in ranges]
        want[str(g)] = all(b[0] > a[1] for a, b in zip(ranges, ranges[1:]))
    df = spark.createDataFrame(rows, "g STRING, lo DOUBLE, hi DOUBLE")
    assert {r.g: r.disjoint for r in N.chain_disjoint(df, ["g"], hot_rows).collect()} == want


def test_gaps_beyond_the_first_combinations(spark):
    full = [(i, j) for i in range(60) for j in range(100)]
    free = {(0, 3), (55, 7), (55, 8), (59, 99)}
    rows = [("a", {"x": f"{i:02d}", "y": f"{j:02d}"}, "s", "p") for i, j in full if (i, j) not in free] + [("b", {"x": "1"}, "s", "p"), ("b", {"x": "2"}, "s", "p"), ("b", {"y": "3"}, "s", "p")]
    rows += [("c", {f"d{k:02d}": v for k in range(20)}, "s", "p") for v in [f"{i:02d}" for i in range(10)]]
    claims = spark.createDataFrame(rows, "pool STRING, scope MAP<STRING, STRING>, subject_id STRING, property_name STRING")
    got = {r.pool: r for r in K.gap_summary(claims, ["pool"]).collect()}
    assert (got["a"].total, got["a"].covered, got["a"].shown, got["a"].omitted) == (6000, 5996, 4, 0)
    assert got["a"].gaps == " | ".join(f"x={i:02d}, y={j:02d}" for i, j in sorted(free))
    assert (got["b"].total, got["b"].covered, got["b"].gaps) == (2, 0, "x=1, y=3 | x=2, y=3")
    assert (got["c"].total, got["c"].covered, got["c"].shown, got["c"].omitted) == (10**20, 10, 12, 10**20 - 22)
    assert got["c"].gaps.split(" | ")[0] == ", ".join(f"d{k:02d}={'01' if k == 19 else '00'}" for k in range(20))


def test_counted_conflicts_are_the_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        scope = {k: v for k, v in (("year", rng.choice("12")), ("geography", rng.choice("AB"))) if rng.random() < 0.6}
        lo = rng.randint(0, 12)
        rows.append(claim(f"c{i:03d}", lo, lo + rng.randint(0, 6), scope, subject="s" if rng.random() < 0.7 else f"t{i % 4}", prop=rng.choice("pq")))
    claims = spark.createDataFrame(rows, CLAIMS).withColumn("pool", F.when(F.col("subject_id") == "t1", "b").otherwise("a"))
    all_pairs = K.detect_conflicts(claims, by=["pool"])
    counted = {tuple(r) for r in K.conflict_counts(claims, ["pool"]).select("pool", "subject_id", "property_name", "conflicts").collect()}
    assert counted == {tuple(r) for r in all_pairs.groupBy("pool", "subject_id", "property_name").count().collect()}
    for limit in (1, 8, 40):
        facts = K.conflict_facts(claims, "pool", limit).collect()
        for pool in ("a", "b"):
            want = sorted((r.subject_id, r.property_name, r.left_claim_id, r.right_claim_id, r.pair_id, r.reason) for r in all_pairs.filter(F.col("pool") == pool).collect())
            got = [r for r in facts if r.pool == pool]
            assert [(r.subject_id, r.property_name, r.left_claim_id, r.right_claim_id, r.pair_id, r.reason) for r in sorted(got, key=lambda r: r.pos)] == want[:limit]
            assert {(r.conflicts, r.omitted) for r in got} == {(len(want), max(0, len(want) - limit))}
    assert K.conflict_facts(claims.limit(0), "pool").count() == 0


def test_pairs_below_counts_ties_and_nulls(spark):
    from factweave.operators import dominance as D

    ends = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), (None, 1.0), ("b", None)], "k STRING, value DOUBLE")
    begins = spark.createDataFrame([("a", 2.0), ("a", 3.0), (None, 5.0), ("b", 9.0), ("c", 1.0)], "k STRING, value DOUBLE")
    assert {tuple(r) for r in D.pairs_below(ends, begins, ["k"]).collect()} == {("a", 1 + 3), (None, 1)}


def test_queue_past_its_head(spark):
    """Reviews name every claim of the first ones, and every pair of the first: the queue reads on behind its head."""
    rng = random.Random(3)
    rows = [(f"f{i:03}", "s", float(rng.randint(0, 40))) for i in range(60)]
    obs = "named_struct('property_name', 'p', 'operator', 'eq', 'value', v, 'min_value', NULL, 'max_value', NULL, 'unit', '%', 'normalized_value', v, 'normalized_min', CAST(NULL AS DOUBLE), 'normalized_max', CAST(NULL AS DOUBLE), 'normalized_unit', '%', 'raw_text', '')"
    df = spark.createDataFrame(rows, "id STRING, subject STRING, v DOUBLE").selectExpr(
        "id", "subject", "'HAS' AS predicate", "'consensus' AS status", "map('geography', 'x') AS scope", f"array({obs}) AS observations",
        "array(named_struct('document_id', 'd')) AS evidence",
    )
    pairs = sorted((r.left_claim_id, r.right_claim_id, r.pair_id, r.left_finding_id, r.right_finding_id) for r in K.detect_conflicts(K.to_claims(df)).collect())
    schema = "candidate_id STRING, status STRING, actor_id STRING, left_finding_id STRING, right_finding_id STRING, created_at STRING"
    for reviewed, limit in ((50, 1), (len(pairs) - 2, 1), (len(pairs) - 2, 4), (len(pairs), 3), (0, 5)):
        done = [(p[2], None if i == 0 else "dismissed", "e", p[3], p[4], "t") for i, p in enumerate(pairs[:reviewed])]
        got = [(r.left_claim_id, r.right_claim_id, r.status) for r in K.conflict_queue(df, spark.createDataFrame(done, schema), limit).collect()]
        state = [(*p[:2], "candidate" if i >= reviewed or i == 0 else "dismissed") for i, p in enumerate(pairs)]
        assert got == sorted(state, key=lambda x: (x[2] != "candidate", x))[:limit]


def test_claims_stay_where_groups_are_few(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        claims = spark.range(20_000).selectExpr("concat('c', id, uuid()) AS claim_id", "'s' AS subject_id", "'p' AS predicate", "'q' AS property_name", "'%' AS unit", "map('k', string(id % 2)) AS scope")
        rows, _ = K._sides(K.written(claims), [])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pairs_below_with_one_value_many_times(spark):
    from factweave.operators import dominance as D

    ends = spark.range(30_000).selectExpr("'k' AS k", "CAST(id % 3 AS DOUBLE) AS value")
    assert [tuple(r) for r in D.pairs_below(ends, ends, ["k"]).collect()] == [("k", 3 * 10_000 * 10_000)]
