"""Queries and operators that a review found lacking: whole rows, and parts in place of whole answers."""

from pathlib import Path

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check
from factweave.operators import access
from factweave.operators import conflicts as K
from factweave.operators import hypotheses as H
from factweave.operators import ingest
from factweave.sources import sinks

SF = "/root/testdata/sf0.01"

tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@tables
def test_one_row_per_bar(spark):
    df = entry.queries()["measure_bars"](spark, SF)
    assert {"id", "pos", "property_name", "left", "width"} == set(df.columns)
    ok, note, _, _ = oracle_check.compare(df, oracle_check.duck(SF), entry.oracle_sql()["measure_bars"])
    assert ok, note


@tables
def test_one_row_per_rival(spark):
    df = entry.queries()["rivals_whole"](spark, SF)
    assert {"finding_id", "rival_id", "delta"} < set(df.columns)
    seen = {(r.query_id, r.property_name, r.subject, r.finding_id, r.rival_id) for r in df.collect()}
    assert seen and seen == {(q, p, s, b, a) for q, p, s, a, b in seen}


def test_access_answers_of_rows(spark):
    answers = spark.createDataFrame([("a", ["c"], ["g"]), ("b", ["c"], []), (None, ["c"], []), ("e", ["c"], [])], "query_id STRING, conflicts ARRAY<STRING>, knowledge_gaps ARRAY<STRING>")
    findings = spark.createDataFrame([("a", "1", "public"), ("a", "2", "restricted"), ("b", "2", "public"), (None, "1", None), ("a", "3", "public"), ("a", "3", "public")], "query_id STRING, id STRING, data_class STRING")
    seen = [("a", "o1", ["1", "3"]), ("a", "o2", ["1", "2"]), ("a", "o3", []), ("b", "o4", ["2"]), ("b", "o5", ["1"]), (None, "o6", ["1"]), (None, "o7", []), ("a", "o8", None), ("a", "o9", ["1", None])]
    cut, kept, cited = access.acl_answers(answers, findings, spark.createDataFrame(seen, "query_id STRING, id STRING, finding_ids ARRAY<STRING>"), {"public"})
    assert {(r.query_id, r.hidden, len(r.conflicts), len(r.knowledge_gaps)) for r in cut.collect()} == {("a", True, 0, 0), ("b", False, 1, 0), (None, True, 0, 0), ("e", False, 1, 0)}
    assert sorted((r.query_id, r.id) for r in kept.collect()) == [("a", "1"), ("a", "3"), ("a", "3"), ("b", "2")]
    assert sorted(r.id for r in cited.collect()) == ["o1", "o3", "o4", "o7"]


FINDINGS = (
    "id STRING, statement STRING, confidence DOUBLE, status STRING, version INT, evidence ARRAY<STRUCT<source_title STRING, page INT, sheet STRING, source_url STRING, "
    "retrieved_at STRING, quote STRING>>, observations ARRAY<STRUCT<property_name STRING, raw_text STRING, normalized_unit STRING>>"
)


@pytest.mark.parametrize("export", [sinks.export_jsonld, sinks.export_markdown])
def test_pieces_are_the_whole_text(spark, export):
    place = [("T", 2, None, "u", None, 'a "quote"'), ("S", None, "s1", None, "now", "b")]
    rows = [(q, f"f{i % 7}", f"says, {i}", 0.5, None, i, place[: i % 3], [("p", "1 m", None)][: i % 2]) for q in ("x", "y") for i in range(25)]
    findings = spark.createDataFrame(rows, f"query_id STRING, {FINDINGS}")
    head = spark.createDataFrame(
        [(q, f"{q}?", None if q == "x" else "S", 0.5, "none", ["c"], ["g"] if q == "y" else [], [], []) for q in ("x", "y", "z")],
        "query_id STRING, question STRING, summary STRING, confidence DOUBLE, model_mode STRING, conflicts ARRAY<STRING>, knowledge_gaps ARRAY<STRING>, recommendations ARRAY<STRING>, trace ARRAY<STRING>",
    )
    arrays = findings.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*sinks.FIELDS))).alias("findings"))
    arrays = head.join(arrays, "query_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(arrays.schema["findings"].dataType)))
    pieces = {}
    for r in sorted(export(head, findings).collect(), key=lambda r: (r.query_id, r.section, r.number)):
        pieces.setdefault(r.query_id, []).append(r.value)
    assert {q: len(p) for q, p in pieces.items()} == {"x": 27, "y": 27, "z": 2}
    assert {q: "".join(p) for q, p in pieces.items()} == {r.query_id: r.value for r in export(arrays).collect()}


def test_overlay_without_moving_pairs(spark):
    claims = spark.createDataFrame(
        [(f"f{i // 2}#ro#{i % 2}", f"f{i // 2}", "s", "P", "ro", float(i), i + 0.5, "%", {"g": "RU"} if i % 3 else {}) for i in range(12)],
        "claim_id STRING, finding_id STRING, subject_id STRING, predicate STRING, property_name STRING, lo DOUBLE, hi DOUBLE, unit STRING, scope MAP<STRING, STRING>",
    )
    pairs = K.detect_conflicts(claims)
    some = pairs.filter("crc32(pair_id) % 3 = 0").selectExpr(
        "pair_id AS candidate_id", "IF(crc32(pair_id) % 2 = 0, left_finding_id, right_finding_id) AS left_finding_id", "IF(crc32(pair_id) % 2 = 0, right_finding_id, left_finding_id) AS right_finding_id", "'confirmed' AS status", "'e' AS actor_id", "'d' AS created_at"
    )
    reviews = some.unionByName(some.filter("crc32(candidate_id) % 5 = 0").withColumn("status", F.lit("dismissed")))
    reviews = reviews.unionByName(some.limit(1).withColumn("candidate_id", F.lit("gone")))
    want = K.overlay_reviews(pairs, reviews)
    got = K.overlay_conflicts(claims, reviews)
    assert set(got.columns) == set(want.columns) and {"confirmed", "dismissed", "candidate"} <= {r.status for r in got.collect()}
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_signals_without_moving_pairs(spark):
    obs = lambda i: [("p", "eq", float(i % 5), None, None, "%", float(i % 5), None, None, "%", "x")] * (1 + i % 2)
    place = lambda d, q: ("T" if q else " ", d, 1, None, None, None, None, q)
    rows = [(None if i in (4, 9, 14) else f"f{i % 11}", "s", "P", 0.1 * i, ("public", "restricted", None)[i % 3], "extracted", {"g": "RU"} if i % 4 else {},
             [place(f"d{i % 4}", "q" if i % 3 else None)] * (1 + i % 2), obs(i)) for i in range(16)]
    o = "STRUCT<property_name STRING, operator STRING, value DOUBLE, min_value DOUBLE, max_value DOUBLE, unit STRING, normalized_value DOUBLE, normalized_min DOUBLE, normalized_max DOUBLE, normalized_unit STRING, raw_text STRING>"
    e = "STRUCT<source_title STRING, document_id STRING, page INT, sheet STRING, cell_range STRING, char_start INT, char_end INT, quote STRING>"
    findings = spark.createDataFrame(rows, f"id STRING, subject STRING, predicate STRING, confidence DOUBLE, data_class STRING, status STRING, scope MAP<STRING, STRING>, evidence ARRAY<{e}>, observations ARRAY<{o}>")
    claims = K.to_claims(findings)
    want = H.numeric_signals(K.detect_conflicts(claims), findings)
    pairs = K.detect_conflicts(H.with_sides(claims, findings), carry=H.SIDES)
    got = H.numeric_signals(pairs, findings)
    assert got.columns == want.columns and want.count() > 20
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert plan(got.select("pair_id", "statement")) <= plan(pairs)


def _evidence(spark):
    fragment = "STRUCT<text: STRING, page: INT, sheet: STRING, cell_range: STRING, source_char_start: INT>"
    cut = lambda *lines: [(t, i + 1, None, None, 10 * i) for i, t in enumerate(lines)]
    documents = spark.createDataFrame(
        [("a", "A", "One TWO\nthree two\nnull", cut("One TWO", "three two", None)), ("b", "B", None, []), ("c", "C", "x", None), ("d", "D", "d one", cut("d", "one")), ("d", "E", "one", cut("one"))],
        f"document_id STRING, title STRING, text STRING, fragments ARRAY<{fragment}>",
    )
    quotes = [("a", 0, "two"), ("a", 1, "ONE two"), ("a", 2, "absent"), ("a", 3, ""), ("a", 4, None), ("b", 0, "q"), ("c", 0, "x"), ("d", 0, "one"), ("e", 0, "gone"), (None, 0, "two")]
    claims = spark.createDataFrame([(d, p, q, "s", "o") for d, p, q in quotes], "document_id STRING, pos INT, evidence_quote STRING, subject STRING, object STRING")
    return claims, documents


def test_quotes_meet_fragments_as_lists(spark):
    claims, documents = _evidence(spark)
    found = ingest.locate_evidence(claims, documents)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row per claim and fragment
    got = {(r.document_id, r.pos): (r.source_title, r.page, r.char_start, r.char_end, r.quote) for r in found.collect()}
    assert got == {
        ("a", 0): ("A", 2, 16, 19, "two"), ("a", 1): ("A", 1, 0, 7, "ONE two"), ("a", 2): ("A", 1, None, None, "absent"), ("a", 3): ("A", 1, None, None, "A"),
        ("a", 4): ("A", 1, None, None, "A"), ("b", 0): (None, 1, None, None, "q"), ("c", 0): (None, 1, None, None, "x"), ("d", 0): ("E", 1, 0, 3, "one"),
        ("e", 0): (None, 1, None, None, "gone"), (None, 0): (None, 1, None, None, "two"),
    }


def test_texts_are_lowered_once(spark):
    claims, documents = _evidence(spark)
    entities = spark.createDataFrame([], "document_id STRING, name STRING, canonical_name STRING, aliases ARRAY<STRING>")
    kept, _ = ingest.supported_claims(claims, documents, entities)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "lower(" not in join and kept.columns == claims.columns
    assert sorted((r.document_id, r.pos) for r in kept.collect()) == [("a", 0), ("a", 1), ("c", 0), ("d", 0), ("d", 0)]
