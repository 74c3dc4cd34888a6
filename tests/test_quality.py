"""Gates and small samples."""

import random

from pyspark.sql import functions as F

from factweave.operators import quality as Q


def test_three_samples_are_no_percentile(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 9.0), (1, 7.0)], "g INT, v DOUBLE")
    r = Q.latency_report(df, ["g"], "v").first()
    assert (r.samples, r.average, r.p95, r.is_percentile) == (3, 7.0, 9.0, False)


def test_recall_counts_distinct_sources(spark):
    runs = spark.createDataFrame([("c", 1, "x"), ("c", 2, "a"), ("c", 3, "a")], "case_id STRING, rank INT, source_title STRING")
    qrels = spark.createDataFrame([("c", "a"), ("c", "b"), ("lost", "z")], "case_id STRING, source_title STRING")
    got = {r.case_id: r for r in Q.ranking_metrics(runs, qrels).collect()}
    assert (got["c"].recall_at_3, got["c"].hit_at_3, got["c"].mrr) == (0.5, 1.0, 0.5)
    assert got["lost"].recall_at_10 == 0 and got["lost"].ndcg_at_3 == 0


def test_regressions(spark):
    cur = spark.createDataFrame([("mrr", 0.9), ("p95_seconds", 2.2), ("zero", 0.0)], "metric STRING, value DOUBLE")
    base = spark.createDataFrame([("mrr", 1.0), ("p95_seconds", 2.0), ("zero", 0.0)], "metric STRING, value DOUBLE")
    assert {r.metric for r in Q.regressions(cur, base).collect()} == {"mrr", "p95_seconds"}
    assert [r.metric for r in Q.regressions(cur.limit(0), base).collect()] == ["no_shared_metrics"]


def test_answer_without_findings_fails(spark):
    schema = "query_id STRING, findings INT, citation_coverage DOUBLE, numeric_support DOUBLE, unsupported_ratio DOUBLE, content_match DOUBLE, judge DOUBLE, correctness DOUBLE, conflict_recall DOUBLE, gap_recall DOUBLE"
    rows = [("none", 0, None, None, None, None, None, None, None, None), ("good", 2, 1.0, 1.0, 0.0, 1.0, None, None, None, None), ("bad", 2, 1.0, 1.0, 0.0, 1.0, None, 0.5, None, None)]
    got = {r.query_id: (r.overall, r.passed) for r in Q.assess(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"none": (0.0, False), "good": (1.0, True), "bad": (1.0, False)}


def test_acceptance_without_measure(spark):
    df = spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in ("recall_at_10", "p95_seconds", "hybrid_mrr", "lexical_mrr")], F.lit(True).alias("require_hybrid"))
    assert Q.acceptance(df).first().accepted is False


def test_exact_percentile_of_one_large_group(spark):
    from factweave.operators import quality as Q

    rng = random.Random(5)
    rows = [("hot", float(rng.choice((1, 2, rng.randint(0, 500))))) for _ in range(4000)] + [("few", 3.0), ("few", 9.0), (None, 4.0), ("hot", None)] + [("five", float(i)) for i in range(5)]
    got = {r.g: r for r in Q.latency_report(spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(7), ["g"], "v").collect()}
    for g in ("hot", "five"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].p95 == values[min(round((len(values) - 1) * 0.95), len(values) - 1)] and got[g].is_percentile and got[g].samples == len(values)
    assert got["few"].p95 == 9.0 and not got["few"].is_percentile and got[None].p95 == 4.0


def test_row_numbers(spark):
    from factweave.operators import ranks

    rows = [(None if i % 7 == 0 else i % 3, i % 5) for i in range(300)] + [(1, 2)] * 200
    got = ranks.row_numbers(spark.createDataFrame(rows, "g INT, v INT"), ["g"], [F.desc("v")]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.number, r.v, r.size) for r in got if r.g == g)
        want = sorted((v for k, v in rows if k == g), reverse=True)
        assert mine == [(i + 1, v, len(want)) for i, v in enumerate(want)]


def test_users_extractor_and_judge_in_sql(spark):
    from factweave.operators import tools

    docs = spark.createDataFrame([(1, "a 12\nb"), (2, None), (3, "7 and 8")], "id LONG, text STRING")
    tools.register_extractor(spark, "digits_of", lambda row: ((row["id"], w) for w in (row["text"] or "").split() if w.isdigit()), "id LONG, found STRING")
    got = spark.sql("SELECT * FROM digits_of(TABLE({docs}))", docs=docs).collect()
    assert sorted((r.id, r.found) for r in got) == [(1, "12"), (3, "7"), (3, "8")]
    tools.register_judge(spark, "longer", lambda q, a, c: (a.str.len() > q.str.len()).astype("float64"))
    assert spark.sql("SELECT longer('ab', 'abc', '') AS x").first().x == 1.0
    none = tools.judge_with(spark.createDataFrame([("q", "a", "c")], "question STRING, answer STRING, context STRING"), None)
    assert none.first().judge is None
    upper = tools.extract_with(docs.filter("text IS NOT NULL"), lambda batches: (b.assign(text=b["text"].str.upper()) for b in batches), "id LONG, text STRING")
    assert {r.text for r in upper.collect()} == {"A 12\nB", "7 AND 8"}


def test_acceptance_compares_hybrid_with_lexical(spark, tmp_path):
    from factweave.plans import QUERIES
    from factweave.sources.testdata import SCHEMAS

    # Two equal statements: the term score ties and the smaller id leads, the hybrid run knows the expected source by its title.
    rows = {"documents": [(1, "zinc copper tank", "en", "other", 16), (2, "zinc copper tank", "en", "src0", 16)], "events": []}
    for k in range(6):
        rows["events"].append((k, None, k % 2, "click", float(k), '{"k": 1}'))
    for name, asked, want in (("told", "zinc copper src0", (True, True, True)), ("plain", "zinc copper", (True, True, False))):
        for table, values in {**rows, "benchmark": [(0, asked)]}.items():
            spark.createDataFrame(values, SCHEMAS[table]).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        got = QUERIES["acceptance"](spark, str(tmp_path / name)).first()
        assert (got.recall_ok, got.latency_ok, got.accepted) == want


def test_ungrounded_numbers_by_paragraph_and_repeated_answers(spark):
    from factweave.sources.testdata import SCHEMA_OBSERVATIONS

    schema = f"query_id STRING, text STRING, cited ARRAY<STRUCT<id STRING, evidence ARRAY<STRUCT<quote STRING, source_title STRING, page INT>>, observations {SCHEMA_OBSERVATIONS}>>"
    finding = lambda i, quote, *values: (i, [(quote, "", None)], [("p", "eq", v, None, None, "", v, None, None, "", "") for v in values])
    a, b = finding("a", "holds 5 and 7,50", 3.0, -0.0), finding("b", "holds 9")
    rows = [
        ("links", "5, 7.5 and 3 [x](finding:a)\n\n9 and 5 [y](finding:b)\n\n0 here", [a, b]),  # 5 is not b's, 0 is nobody's there
        ("whole", "5 and 9 and 11", [a, b]), ("none", "4", []), ("text", None, [a]), ("twice", "12", [a]), ("twice", "5 and 13", [a]),
    ]
    df = Q.ungrounded_numbers(spark.createDataFrame(rows, schema))
    got = sorted((r.query_id, r.missing) for r in df.collect())
    assert got == [("links", ["0", "5"]), ("none", ["4"]), ("text", []), ("twice", ["12", "13"]), ("twice", ["12", "13"]), ("whole", ["11"])]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()  # an answer is read once
