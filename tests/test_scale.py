"""Work that must not grow: what is read once, what does not travel with the rows, and groups of any size."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from factweave.functions import measures as M
from factweave.functions import text as X
from factweave.operators import conflicts as K
from factweave.operators import hypotheses as H
from factweave.operators import numbers as N
from factweave.operators import quality as Q
from factweave.operators import ranks
from factweave.operators import search as S
from factweave.sources import testdata as T

OBSERVATION = T.SCHEMA_OBSERVATIONS[len("ARRAY<"):-1]


def observation(name, operator, value=None, lo=None, hi=None, unit="%", raw=""):
    return (name, operator, value, lo, hi, unit, value, lo, hi, unit, raw)


def findings(spark, tmp_path, rows):
    """(id, object, statement, quote, observations) as a stored table."""
    schema = f"id string, object string, statement string, quote string, observations {T.SCHEMA_OBSERVATIONS}"
    place = "named_struct('document_id', 'd', 'source_title', 't', 'source_url', '', 'page', 1, 'sheet', '', 'cell_range', '', 'char_start', 0, 'quote', quote)"
    df = spark.createDataFrame(rows, schema).selectExpr("*", f"array({place}) AS evidence", "map('year', '1999') AS scope", "'s' AS subject", "'p' AS predicate", "0.5D AS confidence", "'public' AS data_class", "'consensus' AS status")
    df.write.parquet(f"{tmp_path}/findings")
    return spark.read.parquet(f"{tmp_path}/findings")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_measure_bars_one_per_observation(spark, tmp_path):
    f = findings(spark, tmp_path, [("a", "x", "", "", [observation("p", "lte", 1.0), observation("p", "lte", 3.0)]), ("b", "x", "", "", [observation("p", "gte", 2.0)])])
    assert sorted((r.id, r.pos, r.bar.width) for r in N.measure_bars(f).collect()) == [("a", 0, 0.0), ("a", 1, 100.0), ("b", 0, 50.0)]


def test_strictest_limits_reads_once(spark, tmp_path):
    nan = float("nan")
    f = findings(spark, tmp_path, [
        ("a", "x", "", "", [observation("p", "gte", 2.0, unit="u")]), ("b", "x", "", "", [observation("p", "gte", 5.0, unit="v"), observation("p", "lte", 9.0)]),
        ("c", "x", "", "", [observation("p", "gte", 5.0, unit="w")]), ("d", "y", "", "", [observation("p", "lte", 4.0), observation("p", "gte", 7.0)]),
        ("e", "y", "", "", [observation("p", "lte", 3.0, unit="w")]), ("f", "z", "", "", [observation("p", "gte", 3.0), observation("p", "gte", nan, unit="n")]),
        ("g", None, "", "", [observation("p", "lte", 4.0)]),
    ])
    out = N.strictest_limits(f, ["object"])
    assert sorted((r.object, r.kind, str(r.at), r.unit) for r in out.collect()) == [("x", "gte", "5.0", "v"), ("y", "lte", "3.0", "w"), ("z", "gte", "nan", "n")]
    assert plan(out).count("Relation [") == 1


def test_comparisons_form_points_once(spark, tmp_path):
    f = findings(spark, tmp_path, [(f"f{i}", "x", "", "", [observation("p", "between", lo=float(3 * i), hi=float(3 * i + 1))]) for i in range(5)])
    out = N.comparisons(f, ["object"])
    assert [(r.points, r.lo, r.hi, r.disjoint, r.low_id, r.high_id) for r in out.collect()] == [(5, 0.0, 13.0, True, "f0", "f4")]
    assert "observations" not in plan(out)


def test_resolve_candidates_reads_claims_once(spark, tmp_path):
    f = findings(spark, tmp_path, [("a", "x", "", "", [observation("p", "eq", 1.0), observation("q", "eq", 1.0)]), ("b", "x", "", "", [observation("p", "eq", 2.0), observation("q", "eq", 1.0)])])
    pair = K.detect_conflicts(K.to_claims(f)).first()
    reviews = spark.createDataFrame([(pair.pair_id, "confirmed", "a", "b"), ("gone", "confirmed", "a", "b")], "candidate_id string, status string, left_finding_id string, right_finding_id string")
    out = K.resolve_candidates(reviews, f)
    assert sorted((r.pair_id == pair.pair_id, r.left_finding_id, r.right_finding_id, r.resolved) for r in out.collect()) == [(False, None, None, False), (True, "a", "b", True)]
    assert "observations" not in plan(out)


def test_finalize_moves_marks_only(spark, tmp_path):
    f = findings(spark, tmp_path, [(f"f{i}", "x", "", "", [observation("p", "eq", float(i))]) for i in range(9)])
    flt = "array(named_struct('property_name', 'p', 'operator', 'gte', 'value', 3D, 'min_value', CAST(NULL AS DOUBLE), 'max_value', CAST(NULL AS DOUBLE), 'unit', '%'))"
    cands = f.selectExpr("*", "object AS plan_id", "CAST(substr(id, 2) AS INT) AS pos", f"{flt} AS numeric_filters", "1990 AS year_from", "CAST(NULL AS INT) AS year_to", "CAST(array() AS ARRAY<STRING>) AS countries")
    kept, report = S.finalize(cands.unionByName(cands.withColumn("pos", F.col("pos") + 100)), "plan_id")
    assert [(r.id, r["rank"]) for r in kept.orderBy("rank").collect()] == [(f"f{i + 2}", i) for i in range(1, 7)]
    row = report.first()
    assert (row.pool, row.numeric_removed, row.scope_removed, row.matching, row.returned) == (9, 3, 0, 6, 6)
    for df in (kept.select("plan_id", "id", "rank"), report):
        lines = plan(df).splitlines()
        moved = [below for at, below in zip(lines, lines[1:], strict=False) if "Window [" in at]
        assert moved and not any(line.split("Project [")[-1].count("observations#") and "AS _numeric" not in line for line in moved)


def test_numbers_as_doubles(spark, tmp_path):
    text = "10 000 and 70,0 or 0 1e3 999999999999999 9007199254740993 12345678901234567890 0,5 70"
    got = spark.range(1).select(X.canonical_numbers(F.lit(text)).alias("t"), X.numbers(F.lit(text)).alias("d")).first()
    assert got.t[:4] == ["10000", "70", "0", "1"] and len(got.t) == len(got.d) == len(set(got.t))
    plain = lambda v: spark.range(1).select(X.plain_number(F.lit(v).cast("double"))).first()[0]
    assert [plain(v) for v in (-0.0, 3.0, -7.0, 0.5, 1e14, 1e15, 9e18, None)] == ["0", "3", "-7", "0.5", "100000000000000", "1000000000000000", "9000000000000000000", None]
    f = findings(spark, tmp_path, [("a", "x", "0 of 5, 7 and 8,50", "has 7", [observation("p", "between", lo=-0.0, hi=8.5), None]), ("b", "x", "12 or 3", "has 3", [])])
    got = {r.id: (r.missing_numbers, r.grounded) for r in Q.numbers_grounded(f).collect()}
    assert got == {"a": (["5"], False), "b": (["12"], False)}
    assert spark.range(1).select(X.term_prefixes(F.lit("abc Abcdef, which abcd-efghi 12345678 ёлка"))).first()[0] == ["abcde", "abcd", "efghi", "12345", "ёлка"]


def test_row_before(spark):
    rows = [(g, i, f"{g}{i}" if i % 3 else None) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v string").repartition(7)
    want = df.withColumn("w", F.lag("v").over(Window.partitionBy("g").orderBy("i")))
    key = lambda r: (str(r.g), r.i)
    assert sorted(ranks.row_before(df, ["g"], [F.col("i")], "v", "w").collect(), key=key) == sorted(want.collect(), key=key)


def test_line_offsets(spark, tmp_path):
    texts = ["one\ntwo\n\nthree", "", "x", None, "\n", "\n".join("line" * (i % 5) for i in range(3000))]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], T.SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in T.documents(spark, str(tmp_path)).collect():
        text = texts[int(r.document_id[4:])]
        if text is None:
            assert r.fragments is None
            continue
        at, want = 0, []
        for i, line in enumerate(text.split("\n")):
            want.append((line, i + 1, at))
            at += len(line) + 1
        assert [(f.text, f.page, f.source_char_start) for f in r.fragments] == want


def test_pack_batches_joins_once(spark, tmp_path):
    f = findings(spark, tmp_path, [(f"f{i:02}", "x", "s" * 300, "q" * 300, []) for i in range(30)])
    out = H.pack_batches(f.selectExpr("id", "object AS root", "data_class"), f, 2000, 7)
    assert [r.batch for r in out.orderBy("id").collect()] == [i // 2 for i in range(30)]


def test_equal_documents_tie(spark):
    """Equal terms rank by id to the last digit, wherever they are added up; texts are cut into terms once."""
    words = [f"term{i}" for i in range(60)]
    docs = spark.createDataFrame([(f"d{i:02}", " ".join(words[:50]) if i % 2 else " ".join(words[49::-1])) for i in range(40)] + [("e", "other words")], "id string, text string")
    queries = spark.createDataFrame([("q", " ".join(words[::3]))], "query_id string, text string")
    for d in (docs, docs.repartition(5)):
        assert [r.id for r in S.best_terms(queries, d, 18).orderBy("rank").collect()] == [f"d{i:02}" for i in range(18)]
        assert "lower(body" not in plan(S.bm25(queries, d.withColumnRenamed("text", "body"), "body"))
