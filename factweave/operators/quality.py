"""Ranking metrics, grounding of answers, correctness, gates and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as X
from ..functions import units as U
from . import ranks
from .catalog import case_diff, one_row

# Floors and limits of the gates.
PASS_TOLERANCE, OVERALL_FLOOR, CORRECTNESS_FLOOR, JUDGE_FLOOR, CONTENT_FLOOR, RECALL_FLOOR = 0.999, 0.8, 0.8, 0.8, 0.999, 0.6
RECALL3_FLOOR, MRR_FLOOR = 0.6, 0.5
MIN_RECALL10, MAX_P95_SECONDS, MAX_REGRESSION = 0.90, 3.0, 0.05
MIN_AB_CASES, AB_LATENCY_GROWTH, MIN_P95_SAMPLE = 5, 1.25, 5
PENALTY, UNTRACED_CAP = 0.85, 0.5
CONTENT_TERMS, DIFFERENTIAL_TERMS = 0.5, 0.6
LOWER_IS_BETTER = ("p95_seconds", "average_seconds")


# --- percentiles -------------------------------------------------------------------------------------------------------


def nearest_rank(sorted_values: Column, share: float) -> Column:
    """Value at index min(round((n-1) p), n-1) of a sorted array; round goes to the even neighbour."""
    n = F.size(sorted_values)
    at = F.least(F.rint((n - 1) * F.lit(share)).cast("int"), n - 1)
    return F.get(sorted_values, at)


def latency_report(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average and 95th percentile by nearest rank; below five samples the largest value stands in and is named so.

    The rank of the percentile is known from the count, and the row of that rank from the distributed numbering of the group's values,
    so the result is exact and one group may hold all rows.
    """
    c = F.col
    sizes = df.groupBy(*by).agg(F.count(value).alias("samples"), F.avg(value).alias("average"), F.max(value).alias("top"))
    numbered = ranks.row_numbers(df.filter(c(value).isNotNull()).select(*by, value), by, [c(value)], "_n", "_size")
    position = F.least(F.rint((c("_size") - 1) * 0.95), c("_size") - 1) + 1
    hit = numbered.filter(c("_n") == position).select(*[c(k).alias(f"_{k}") for k in by], c(value).alias("_p95"))
    same = F.lit(True)
    for k in by:
        same &= c(k).eqNullSafe(c(f"_{k}"))
    enough = c("samples") >= MIN_P95_SAMPLE
    return sizes.join(hit, same, "left").select(
        *by, "samples", F.round("average", 1).alias("average"), F.round(F.when(enough, F.coalesce("_p95", "top")).otherwise(c("top")), 1).alias("p95"),
        enough.alias("is_percentile"),
    )


# --- ranking -----------------------------------------------------------------------------------------------------------


def ranking_metrics(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Per case: recall@k over distinct expected sources, hit@k, precision@3 and @5, reciprocal rank, NDCG@3.

    ``runs``: case_id, rank, source_title; ``qrels``: case_id, source_title. Cases without a run score zero.
    """
    c = F.col
    expected = qrels.select("case_id", "source_title").distinct()
    total = expected.groupBy("case_id").agg(F.count("*").alias("total"))
    hits = runs.join(expected, ["case_id", "source_title"], "left_semi")
    gain = lambda rank: 1 / F.log2(rank + 1)
    aggs = [
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(c("rank") <= 3, gain(c("rank")))), F.lit(0.0)).alias("dcg"),
    ]
    for k in ks:
        aggs.append(F.count_distinct(F.when(c("rank") <= k, c("source_title"))).alias(f"_found{k}"))
        if k in (3, 5):
            aggs.append((F.count_if(c("rank") <= k) / k).alias(f"precision_at_{k}"))
    cases = total.join(hits.groupBy("case_id").agg(*aggs), "case_id", "left")
    ideal = F.when(c("total") >= 3, 1 + gain(F.lit(2)) + gain(F.lit(3))).when(c("total") == 2, 1 + gain(F.lit(2))).otherwise(1.0)
    zero = lambda name: F.coalesce(name, F.lit(0))
    out = [
        *[(zero(f"_found{k}") / c("total")).alias(f"recall_at_{k}") for k in ks],
        *[(zero(f"_found{k}") > 0).cast("double").alias(f"hit_at_{k}") for k in ks],
        *[F.coalesce(f"precision_at_{k}", F.lit(0.0)).alias(f"precision_at_{k}") for k in ks if k in (3, 5)],
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_3"),
    ]
    return cases.select("case_id", *out)


def distinct_titles(runs: DataFrame) -> DataFrame:
    """Runs over evidence titles: each title once per case, at the place of its first occurrence."""
    first = runs.groupBy("case_id", "source_title").agg(F.min(F.struct("rank", "evidence_pos")).alias("at"))
    w = Window.partitionBy("case_id").orderBy("at", "source_title")
    return first.select("case_id", "source_title", F.row_number().over(w).alias("rank"))


def ranking_metrics_titles(runs: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """Per case over the first k distinct titles: hits over expected, precision, reciprocal rank inside k, NDCG."""
    c = F.col
    expected = qrels.select("case_id", "source_title").distinct()
    total = expected.groupBy("case_id").agg(F.count("*").alias("total"))
    hits = distinct_titles(runs).filter(c("rank") <= k).join(expected, ["case_id", "source_title"], "left_semi")
    gain = lambda r: 1 / F.log2(r + 1)
    got = hits.groupBy("case_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain(c("rank"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + gain(i))
    return total.join(got, "case_id", "left").select(
        "case_id", (F.coalesce("n", F.lit(0)) / c("total")).alias("recall_at_3"), (F.coalesce("n", F.lit(0)) / k).alias("precision_at_3"),
        F.coalesce(1 / c("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_3"),
    )


def mean_with_n(metrics: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of every metric over the cases that have it, with their number."""
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    long = metrics.select(*by, pairs.alias("m")).select(*by, "m.*")
    return long.groupBy(*by, "metric").agg(F.round(F.avg("value"), 3).alias("mean"), F.count("value").alias("n"))


def retrieval_benchmark(hybrid: DataFrame, lexical: DataFrame, qrels: DataFrame, questions: DataFrame, titles: DataFrame, k: int = 3) -> DataFrame:
    """One row: averages of both rankings, scored cases, validity checks and the verdict.

    A case is scored when all its expected titles are in the corpus.
    """
    c = F.col
    names = ["recall_at_3", "precision_at_3", "mrr", "ndcg_at_3"]
    one = lambda runs, p: ranking_metrics_titles(runs, qrels, k).agg(*[F.round(F.avg(n), 3).alias(f"{p}_{n}") for n in names])
    corpus = titles.select("source_title").distinct()
    expected = qrels.select("case_id", "source_title").distinct()
    absent = expected.join(corpus, "source_title", "left_anti").select("case_id").distinct()
    cases = expected.select("case_id").distinct()
    copied = expected.join(questions.select(c("query_id").alias("case_id"), "text"), "case_id").filter(
        F.lower("text").contains(F.lower("source_title"))
    )
    counts = cases.agg(F.count("*").alias("gold_cases")).withColumns({
        "scored_cases": c("gold_cases") - absent.agg(F.count("*")).scalar(),
        "corpus_documents": corpus.agg(F.count("*")).scalar(),
        "copied_titles": copied.agg(F.count("*")).scalar(),
        "_h": one_row(one(hybrid, "hybrid")), "_l": one_row(one(lexical, "lexical")),
    })
    out = counts.select("*", "_h.*", "_l.*").drop("_h", "_l")
    valid = (c("scored_cases") == c("gold_cases")) & (c("corpus_documents") > k) & (c("copied_titles") == 0)
    return out.withColumn("valid", valid).withColumn(
        "passed", valid & (c("hybrid_recall_at_3") >= RECALL3_FLOOR) & (c("hybrid_mrr") >= MRR_FLOOR)
    )


# --- grounding ---------------------------------------------------------------------------------------------------------


def supported_values(evidence: Column, observations: Column) -> Column:
    """Numbers a finding's quotes, raw texts and observation values can answer with, as doubles."""
    joined = lambda arr, f: F.array_join(F.transform(arr, lambda x: x[f]), " ")
    return F.concat(X.numbers(joined(evidence, "quote")), X.numbers(joined(observations, "raw_text")), M.all_values(observations))


def supported_numbers(evidence: Column, observations: Column) -> Column:
    """``supported_values`` in canonical form."""
    return X.plain_numbers(F.array_distinct(supported_values(evidence, observations)))


def numbers_grounded(findings: DataFrame) -> DataFrame:
    """Numbers of the statement that its own evidence lacks, sorted, and whether there are none."""
    missing = F.array_except(X.numbers(F.col("statement")), supported_values(F.col("evidence"), F.col("observations")))
    missing = F.array_sort(X.plain_numbers(missing))
    return findings.withColumn("missing_numbers", missing).withColumn("grounded", F.size("missing_numbers") == 0)


def content_match(findings: DataFrame) -> DataFrame:
    """Does the text of the addressed quotes hold the statement's numbers and half of its terms?"""
    addressed = F.filter("evidence", lambda e: (F.trim(e["source_title"]) != "") & (F.trim(e["quote"]) != "") & (
        e["page"].isNotNull() | F.coalesce(e["sheet"] != "", F.lit(False)) | F.coalesce(e["cell_range"] != "", F.lit(False)) | e["char_start"].isNotNull()
    ))
    quote = F.array_join(F.transform(addressed, lambda e: e["quote"]), " ")
    rows = findings.withColumns({"_q": quote, "_any": F.size(addressed) > 0}).withColumns({
        "_n": X.numbers(F.col("statement")), "_t": X.term_prefixes(F.col("statement")),
        "_qn": X.numbers(F.col("_q")), "_qt": X.term_prefixes(F.col("_q")),
    })
    numbers = F.size(F.array_except("_n", "_qn")) == 0
    terms = F.when(F.size("_t") == 0, F.size("_n") > 0).otherwise(F.size(F.array_intersect("_t", "_qt")) / F.size("_t") >= CONTENT_TERMS)
    return rows.withColumn("content_match", F.col("_any") & numbers & terms).drop("_q", "_any", "_n", "_t", "_qn", "_qt")


def answer_metrics(answer_findings: DataFrame, by: str = "query_id") -> DataFrame:
    """Per answer: citation coverage, numeric support, unsupported ratio, content match, mean confidence."""
    c = F.col
    rows = content_match(numbers_grounded(answer_findings)).withColumns({
        "_cited": F.size("evidence") > 0, "_numeric": c("statement").rlike(r"\d"),
    })
    n = F.count("*")
    numeric = F.count_if("_numeric")
    return rows.groupBy(by).agg(
        n.alias("findings"), (F.count_if("_cited") / n).alias("citation_coverage"),
        F.when(numeric > 0, F.count_if(c("_cited") & c("_numeric")) / numeric).otherwise(1.0).alias("numeric_support"),
        (F.count_if(~c("grounded")) / n).alias("unsupported_ratio"), (F.count_if("content_match") / n).alias("content_match"),
        # Millionths add up to the same sum in any order.
        (F.sum(F.round(c("confidence") * 1_000_000).cast("bigint")) / (n * 1_000_000)).alias("mean_confidence"),
    )


def signature_recalled(signature: Column, lines: Column, share: float = DIFFERENTIAL_TERMS) -> Column:
    """One line holds all numbers and enough terms of an expected line."""
    numbers, terms = X.canonical_numbers(signature), X.term_prefixes(signature)
    one = lambda line: (F.size(F.array_except(numbers, X.canonical_numbers(line))) == 0) & (
        (F.size(terms) == 0) | (F.size(F.array_intersect(terms, X.term_prefixes(line))) >= F.size(terms) * F.lit(share))
    )
    return ((F.size(numbers) > 0) | (F.size(terms) > 0)) & F.exists(lines, one)


def differential_recall(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of the expected conflicts and gaps an answer names; null where nothing was expected."""
    c = F.col
    rows = gold.join(answers.select("query_id", "conflicts", "knowledge_gaps"), "query_id", "left")
    empty = F.array().cast("array<string>")
    share = lambda wanted, lines: F.when(F.size(wanted) > 0, F.round(F.size(F.filter(
        wanted, lambda s: signature_recalled(s, F.coalesce(lines, empty))
    )) / F.size(wanted), 3))
    return rows.select(
        "query_id", share(c("expected_conflicts"), c("conflicts")).alias("conflict_recall"),
        share(c("expected_gaps"), c("knowledge_gaps")).alias("gap_recall"),
    )


def answer_correctness(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Number and term support of the expected answer; only where its source is given."""
    c = F.col
    usable = gold.filter((c("expected_answer") != "") & (c("expected_answer_source") != ""))
    rows = usable.join(answers.select("query_id", "answer_text"), "query_id").withColumns({
        "_n": X.canonical_numbers(c("expected_answer")), "_t": X.term_prefixes(c("expected_answer")),
        "_fn": X.canonical_numbers(c("answer_text")), "_ft": X.term_prefixes(c("answer_text")),
    }).filter((F.size("_n") > 0) | (F.size("_t") > 0))
    share = lambda need, have: F.when(F.size(need) == 0, 1.0).otherwise(F.size(F.array_intersect(need, have)) / F.size(need))
    n, t = share("_n", "_fn"), share("_t", "_ft")
    return rows.select(
        "query_id", F.round((n + t) / 2, 3).alias("correctness"), F.round(n, 3).alias("number_support"), F.round(t, 3).alias("claim_support"),
        F.array_sort(F.array_except("_n", "_fn")).alias("missing_numbers"), F.array_sort(F.array_except("_t", "_ft")).alias("missing_claims"),
    )


def assess(metrics: DataFrame) -> DataFrame:
    """Overall score and verdict. Parts that were not measured are null and do not count; an answer without findings fails.

    Columns: findings, citation_coverage, numeric_support, unsupported_ratio, content_match, judge, correctness,
    conflict_recall, gap_recall.
    """
    c = F.col
    some = c("findings") > 0
    parts = F.filter(F.array(
        F.when(some, c("citation_coverage")), F.when(some, c("numeric_support")), F.when(some, 1 - c("unsupported_ratio")),
        F.when(some, F.round("content_match", 3)), c("judge"), c("conflict_recall"), c("gap_recall"),
    ), lambda x: x.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    overall = F.round(F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(0.0), 3)
    least = lambda name, floor: F.coalesce(c(name) >= floor, F.lit(True))
    passed = (
        some & (F.round("citation_coverage", 3) >= PASS_TOLERANCE) & (F.round("numeric_support", 3) >= PASS_TOLERANCE)
        & (F.round("unsupported_ratio", 3) <= 1 - PASS_TOLERANCE) & (c("overall") >= OVERALL_FLOOR)
        & (F.round("content_match", 3) >= CONTENT_FLOOR) & least("correctness", CORRECTNESS_FLOOR) & least("judge", JUDGE_FLOOR)
        & least("conflict_recall", RECALL_FLOOR) & least("gap_recall", RECALL_FLOOR)
    )
    return metrics.withColumns({"overall": overall, "components": F.size(parts)}).withColumn("passed", F.coalesce(passed, F.lit(False)))


# --- answer text -------------------------------------------------------------------------------------------------------


def link_mentions(text: Column, findings: Column) -> Column:
    """Known finding ids in prose become links; links and code stay as they are.

    ``findings``: array of (id, title). With a single finding its title is linked too.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\[[^\]]*\]\([^\s)]+\)|`[^`]*`|(?:(?!\[[^\]]*\]\([^\s)]+\)|`[^`]*`).)+)"), F.lit(1))
    quote = lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def one(piece, f):
        title = F.coalesce(f["title"], F.lit("находка"))
        label = F.coalesce(F.when(F.regexp_replace(title, r"[\[\]`\r\n]", " ") != "", F.regexp_replace(title, r"[\[\]`\r\n]", " ")), F.lit("находка"))
        mention = F.concat(F.lit(r"\[*(?:finding:)?"), quote(f["id"]), F.lit(r"\]*"))
        alone = (F.size(findings) == 1) & (title != "") & ~title.rlike(r"^\d+$")
        mention = F.when(alone, F.concat(F.lit("(?:"), mention, F.lit("|"), quote(title), F.lit(")"))).otherwise(mention)
        link = F.concat(F.lit("["), label, F.lit("](finding:"), f["id"], F.lit(")"))
        safe = F.regexp_replace(link, r"([\\$])", r"\\$1")
        return F.when(f["id"].rlike("[a-zA-Zа-яА-Я-]"), F.regexp_replace(
            piece, F.concat(F.lit(r"(?U)(?<![\w:-])"), mention, F.lit(r"(?![\w-])")), safe
        )).otherwise(piece)

    fixed = lambda p: p.rlike(r"(?s)^(\[[^\]]*\]\([^\s)]+\)|`[^`]*`)$")
    return F.array_join(F.transform(pieces, lambda p: F.when(fixed(p), p).otherwise(F.aggregate(findings, p, one))), "")


def answer_prose(text: Column, names: Column, pages: Column) -> Column:
    """Answer text without what is no measured number: numbering, link targets, ids, titles, page references, p95 names.

    ``names``: finding ids and source titles; ``pages``: cited page numbers.
    """
    t = F.regexp_replace(text, r"(?iU)\bp(?:50|90|95|99)\b", "перцентиль")
    t = F.regexp_replace(
        t, r"(?iU)\b(сравнить|проверить|предложить)\s+\d+\s+(?:альтернативн[а-я]+\s+)?(гипотез[а-я]*|объяснен[а-я]*|вариант[а-я]*)", "$1 $2"
    )
    t = F.regexp_replace(t, r"%\s*=\s*100\s*[·*×]", "% = коэффициент ·")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^\s)]+\)", "$1")
    t = F.aggregate(names, t, lambda a, n: F.when(n != "", F.replace(a, n, F.lit(""))).otherwise(a))
    t = F.aggregate(pages, t, lambda a, p: F.regexp_replace(a, F.concat(F.lit(r"(?U)(?:стр\.|с\.)\s*"), p.cast("string"), F.lit(r"\b")), F.lit("")))
    t = F.regexp_replace(t, r"(?U)(?<![\w(])\d+\)\s+", "")
    t = F.regexp_replace(t, r"(?m)^\s*(?:#{1,6}\s*)?(?:\*\*)?\d+[.)](?:\*\*)?\s+", "")
    t = F.regexp_replace(t, r"(?iU)\b(гипотеза|вариант|шаг|пункт|направление|этап)\s*(?:№\s*)?\d+\b", "$1")
    return F.regexp_replace(t, r"(?m)(?:^|(?<=[:;.]))\s*\d+\.\s+", "")


def _names(findings: Column) -> Column:
    return F.flatten(F.transform(findings, lambda f: F.concat(F.array(f["id"]), F.transform(f["evidence"], lambda e: F.coalesce(e["source_title"], F.lit(""))))))


def _pages(findings: Column) -> Column:
    return F.filter(F.flatten(F.transform(findings, lambda f: F.transform(f["evidence"], lambda e: e["page"]))), lambda p: p.isNotNull())


def ungrounded_numbers(answers: DataFrame) -> DataFrame:
    """Numbers of an answer its cited findings do not support: over the whole text, and paragraph by paragraph against the
    findings that the paragraph links.

    ``answers``: query_id, text, cited (array of findings: id, evidence, observations).
    """
    c = F.col
    held = F.transform("cited", lambda f: F.struct(f["id"].alias("id"), F.transform(supported_values(f["evidence"], f["observations"]), lambda v: v + 0.0).alias("values")))
    rows = answers.withColumns({"_names": _names(c("cited")), "_pages": _pages(c("cited")), "_held": held})
    # Numbers are compared as doubles; -0.0 + 0.0 is 0.0.
    beyond = lambda t, fs: F.array_except(X.numbers(answer_prose(t, c("_names"), c("_pages"))), F.flatten(F.transform(fs, lambda f: f["values"])))
    local = F.flatten(F.transform(F.split("text", "\n\n"), lambda p: beyond(p, U.once(X.cited_ids(p), lambda ids: F.filter("_held", lambda f: F.array_contains(ids, f["id"]))))))
    linked = F.when(F.size(X.cited_ids(c("text"))) > 0, local).otherwise(F.array().cast("array<double>"))
    missing = rows.select("query_id", X.plain_numbers(F.array_union(beyond(c("text"), c("_held")), linked)).alias("missing"))
    found = missing.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"))
    return answers.select("query_id").join(found, "query_id")


def unit_pairs(answers: DataFrame) -> DataFrame:
    """Numbers an answer and its evidence state in different units, with both units and their scales."""
    c = F.col
    held = lambda f: F.concat(
        F.filter(F.flatten(F.transform(f["evidence"], lambda e: U.unit_mentions(e["quote"]))), lambda m: m["scale"].isNotNull()),
        F.flatten(F.transform(f["observations"], lambda o: F.concat(
            _valued(o["unit"], o["value"], o["min_value"], o["max_value"]),
            _valued(o["normalized_unit"], o["normalized_value"], o["normalized_min"], o["normalized_max"]),
        ))),
    )
    evidence = answers.select("query_id", F.explode("cited").alias("f")).select("query_id", F.col("f.id").alias("fid"), F.posexplode(held(c("f"))).alias("pos", "e")).select(
        "query_id", "e.number", F.struct("fid", "pos").alias("at"), c("e.scale").alias("scale"), c("e.unit").alias("unit"), U.unit_key(c("e.unit")).alias("key")
    )
    prose = answer_prose(c("text"), _names(c("cited")), _pages(c("cited")))
    said = answers.filter(F.size("cited") > 0).select("query_id", F.explode(U.unit_mentions(prose)).alias("m")).select(
        "query_id", "m.number", c("m.scale").alias("answer_scale"), c("m.unit").alias("answer_unit")
    ).distinct().withColumn("answer_key", U.unit_key(c("answer_unit")))
    first = evidence.groupBy("query_id", "number").agg(
        F.collect_set("key").alias("keys"), F.min_by(F.struct("scale", "unit"), F.struct(c("scale").isNull(), "at")).alias("e")
    )
    return said.join(first, ["query_id", "number"]).filter(~F.array_contains("keys", c("answer_key"))).select(
        "query_id", "number", "answer_unit", "answer_scale", c("e.unit").alias("evidence_unit"), c("e.scale").alias("evidence_scale")
    )


def _valued(unit: Column, *values: Column) -> Column:
    known = F.filter(F.array(*values), lambda v: v.isNotNull() & (F.trim(unit) != ""))
    said = lambda v, scale: F.struct(X.plain_number(v).alias("number"), scale.alias("scale"), unit.alias("unit"))
    return U.once(U.unit_scale(unit), lambda scale: F.transform(known, lambda v: said(v, scale)))


def unit_conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs of known units with another scale or another dimension."""
    c = F.col
    a, b = U.unit_dimension(c("answer_unit")), U.unit_dimension(c("evidence_unit"))
    other = (c("answer_scale") != c("evidence_scale")) | F.coalesce(a != b, F.lit(False))
    return pairs.filter(c("answer_scale").isNotNull() & c("evidence_scale").isNotNull() & other)


def unit_unmatched(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("answer_scale").isNull() | F.col("evidence_scale").isNull())


def unverified_links(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Web links of an answer that are no source of its findings, sorted."""
    links = answers.select("query_id", F.explode(X.http_links(F.col("text"))).alias("url"))
    known = evidence.filter(F.col("source_url") != "").select("query_id", F.col("source_url").alias("url")).distinct()
    return links.join(known, ["query_id", "url"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("url")).alias("links"))


def answer_confidence(df: DataFrame) -> DataFrame:
    """Mean confidence times 0.85 per failed check, at most 0.5 when the answer cites nothing it had."""
    c = F.col
    value = c("mean_confidence") * F.pow(F.lit(PENALTY), c("hits"))
    return df.withColumn("confidence", F.round(F.when(c("untraced"), F.least(value, F.lit(UNTRACED_CAP))).otherwise(value), 3))


def guardrails(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """Checks of an answer against its collected findings, in one row per answer.

    ``answers``: query_id, text, language, finding_ids; ``findings``: query_id plus finding columns.
    """
    c = F.col
    packed = findings.groupBy("query_id").agg(F.collect_list(F.struct("id", "evidence", "observations", "confidence")).alias("pool"))
    rows = answers.join(packed, "query_id", "left").withColumn(
        "pool", F.coalesce("pool", F.array().cast(packed.schema["pool"].dataType))
    ).withColumn("_cited", F.array_union("finding_ids", X.cited_ids(c("text"))))
    rows = rows.withColumns({
        "unknown_ids": F.array_except("_cited", F.transform("pool", lambda f: f["id"])),
        "cited": F.filter("pool", lambda f: F.array_contains("_cited", f["id"])),
    })
    rows = rows.withColumn("untraced", (F.size("cited") == 0) & (F.size("pool") > 0) & (F.size("_cited") > 0))
    links = unverified_links(answers, findings.select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.source_url"))
    missing = ungrounded_numbers(rows.select("query_id", "text", "cited"))
    pairs = unit_pairs(rows.select("query_id", "text", "cited"))
    bad_units = unit_conflicts(pairs).groupBy("query_id").agg(F.count("*").alias("unit_conflicts"))
    out = (
        rows.join(links, "query_id", "left").join(missing, "query_id", "left").join(bad_units, "query_id", "left")
        .withColumns({
            "citation_problem": (F.size("unknown_ids") > 0) | c("links").isNotNull() | c("untraced"),
            "number_problem": F.coalesce(F.size("missing") > 0, F.lit(False)), "unit_problem": c("unit_conflicts").isNotNull(),
            "language_problem": X.language_mismatch(c("text"), c("language")),
        })
    )
    hits = sum((c(n).cast("int") for n in ("citation_problem", "number_problem", "unit_problem", "language_problem")), F.lit(0))
    used = F.when(F.size("cited") > 0, c("cited")).otherwise(F.when(c("untraced"), c("pool")).otherwise(c("cited")))
    mean = F.aggregate(used, F.lit(0.0), lambda a, f: a + f["confidence"]) / F.greatest(F.size(used), F.lit(1))
    scored = answer_confidence(out.withColumns({"hits": hits, "mean_confidence": mean}))
    return scored.select(
        "query_id", "citation_problem", "number_problem", "unit_problem", "language_problem",
        (c("citation_problem") | c("number_problem") | c("unit_problem")).alias("blocked"), "confidence",
    )


# --- runs and gates ----------------------------------------------------------------------------------------------------


def measurable_cases(gold: DataFrame) -> DataFrame:
    c = F.col
    return gold.agg(
        F.count("*").alias("cases"), F.count_if((c("expected_answer") != "") & (c("expected_answer_source") != "")).alias("verified_answers"),
        F.count_if(F.size("expected_conflicts") > 0).alias("with_conflicts"), F.count_if(F.size("expected_gaps") > 0).alias("with_gaps"),
    )


def pipeline_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Per variant: source recall, citation coverage, pass rate, latency, repairs per case, tokens."""
    c = F.col
    n = F.count("*")
    ok = (c("recall") == 1) & (c("citation_coverage") == 1) & (c("degradations") == 0)
    base = results.groupBy(*by).agg(
        n.alias("cases"), F.round(F.avg("recall"), 3).alias("source_recall"), F.round(F.avg("citation_coverage"), 3).alias("citation_coverage"),
        F.round(F.count_if(ok) / n, 3).alias("pass_rate"), F.round(F.sum("retries") / n, 3).alias("retries_per_case"), F.sum("tokens").alias("total_tokens"),
    )
    latency = latency_report(results, by, "latency_ms").select(*by, c("average").alias("average_latency_ms"), c("p95").alias("p95_latency_ms"))
    return base.join(latency, by)


def ab_decision(metrics: DataFrame, results: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """promote or reject a candidate: enough cases, no lost case, a newly passed one, no rate worse, latency <= 1.25 x."""
    c = F.col
    passed = results.filter((c("recall") == 1) & (c("citation_coverage") == 1) & (c("degradations") == 0))
    diff = case_diff(passed.filter(c("variant") == baseline), passed.filter(c("variant") == candidate)).agg(
        F.count_if(c("change") == "regression").alias("regressions"), F.count_if(c("change") == "newly_passed").alias("newly_passed")
    )
    side = lambda name, p: metrics.filter(c("variant") == name).select(
        *[c(x).alias(f"{p}_{x}") for x in ("cases", "pass_rate", "source_recall", "citation_coverage", "average_latency_ms")]
    )
    rows = diff.select("*", one_row(side(baseline, "b")).alias("_b"), one_row(side(candidate, "c")).alias("_c")).select(*diff.columns, "_b.*", "_c.*")
    good = (
        (c("c_cases") >= MIN_AB_CASES) & (c("regressions") == 0) & (c("newly_passed") > 0) & (c("c_pass_rate") >= c("b_pass_rate"))
        & (c("c_source_recall") >= c("b_source_recall")) & (c("c_citation_coverage") >= c("b_citation_coverage"))
        & (c("c_average_latency_ms") <= c("b_average_latency_ms") * AB_LATENCY_GROWTH)
    )
    return rows.select(
        c("c_cases").alias("cases"), F.round(c("c_pass_rate") - c("b_pass_rate"), 3).alias("delta_pass_rate"), "regressions", "newly_passed",
        F.when(good, "promote").otherwise("reject").alias("decision"),
    )


def acceptance(metrics: DataFrame) -> DataFrame:
    """recall@10, 95th percentile and hybrid above lexical; without a single checked criterion nothing is accepted.

    Columns: recall_at_10, p95_seconds, hybrid_mrr, lexical_mrr, require_hybrid.
    """
    c = F.col
    return metrics.withColumns({
        "recall_ok": c("recall_at_10") >= MIN_RECALL10, "latency_ok": c("p95_seconds") <= MAX_P95_SECONDS,
        "hybrid_ok": ~c("require_hybrid") | (c("hybrid_mrr") > c("lexical_mrr")),
    }).withColumn("accepted", F.coalesce(c("recall_ok") & c("latency_ok") & c("hybrid_ok"), F.lit(False)))


def regressions(current: DataFrame, baseline: DataFrame, share: float = MAX_REGRESSION) -> DataFrame:
    """Metrics more than ``share`` worse than the baseline; a zero baseline is skipped.

    (metric, value) tables; without a common metric the one row ``no_shared_metrics`` says so.
    """
    c = F.col
    both = current.join(baseline.select("metric", c("value").alias("base")), "metric")
    lower = c("metric").isin(*LOWER_IS_BETTER)
    broken = F.when(lower, c("value") > c("base") * (1 + share)).otherwise(c("value") < c("base") * (1 - share))
    worse = both.filter((c("base") > 1e-12) & broken).select("metric", "base", "value")
    none = both.agg(F.count("*").alias("n")).filter(c("n") == 0).select(
        F.lit("no_shared_metrics").alias("metric"), F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("value")
    )
    return worse.unionByName(none)


def ab_gate(proposals: DataFrame, experiments: DataFrame) -> DataFrame:
    """Proposals with a promoted experiment."""
    promoted = experiments.filter(F.col("decision") == "promote").select(F.col("proposal_id").alias("id"))
    return proposals.join(promoted, "id", "left_semi")


def reconcile_gold(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """(source, state): matched, manifest_only, benchmark_only or question_mismatch.

    ``manifest``: source, question; ``cases``: source, query.
    """
    c = F.col
    plain = lambda col: F.lower(X.squeeze(col))
    asked = cases.groupBy("source").agg(F.collect_set(plain(c("query"))).alias("queries"))
    both = manifest.select("source", plain(c("question")).alias("question")).join(asked, "source", "full_outer")
    state = (
        F.when(c("queries").isNull(), "manifest_only").when(c("question").isNull(), "benchmark_only")
        .when(~F.array_contains("queries", c("question")), "question_mismatch").otherwise("matched")
    )
    return both.select("source", state.alias("state"))


def preflight(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of the manifest without a file: with any, a run is not measured."""
    return manifest.select("source").distinct().join(files.select("source"), "source", "left_anti")
