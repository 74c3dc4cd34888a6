"""Named read operations over one pool, and hooks for user code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLAIMS_IN
from . import catalog, conflicts, graph, ingest, search

Corpus = dict[str, DataFrame]


def hybrid_search(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    return search.retrieve(requests, corpus["passages"], corpus.get("vectors"), corpus.get("query_vectors"))


def graph_traverse(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    """Requests name entities; one walk of the largest asked depth, each request keeps the levels it asked for."""
    names = requests.select("query_id", F.explode("entity_names").alias("name"))
    starts = graph.anchors(names, corpus["nodes"]).select("query_id", "id")
    walked = graph.neighbourhood(starts, corpus["nodes"], corpus["edges"], graph_depth(requests))
    return walked.join(requests.select("query_id", F.greatest(F.lit(1), F.least("max_hops", F.lit(4))).alias("hops")), "query_id").filter(
        F.col("level") <= F.col("hops")
    ).drop("hops")


def graph_depth(requests: DataFrame) -> int:
    """Largest depth asked for: one number."""
    return int(requests.agg(F.coalesce(F.max("max_hops"), F.lit(1)).alias("h")).first()["h"])


def community_search(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    from ..functions.text import query_tokens

    tokens = requests.select("query_id", F.explode_outer(query_tokens(F.col("text"))).alias("token"))
    return graph.rank_profiles(tokens, corpus["profiles"])


def numeric_filter(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    return catalog.apply_numeric_filters(corpus["pool"].join(requests.select("query_id", "numeric_filters"), "query_id"), F.col("numeric_filters"))


def conflict_scan(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    pool = corpus["pool"].join(requests.select("query_id"), "query_id", "left_semi")
    return conflicts.conflict_facts(conflicts.to_claims(evidence_pool(pool), carry=("query_id",)), "query_id")


def gap_scan(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    pool = corpus["pool"].join(requests.select("query_id"), "query_id", "left_semi")
    return conflicts.gap_report(conflicts.to_claims(evidence_pool(pool), carry=("query_id",)), ["query_id"])


def expert_lookup(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    return graph.experts(graph_traverse(spark, requests, corpus), corpus["nodes"])


def finding_lookup(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    ids = requests.select(F.explode("finding_ids").alias("finding_id")).distinct()
    return catalog.lookup_findings(ids, corpus["findings"], None)


def public_search(spark: SparkSession, requests: DataFrame, corpus: Corpus) -> DataFrame:
    """Term search over the text of stored pages."""
    found = ingest.pages_to_findings(corpus["pages"])
    return search.best_terms(requests, found, 3, "quote")


TOOLS: dict[str, Callable[[SparkSession, DataFrame, Corpus], DataFrame]] = {
    f.__name__: f for f in (
        hybrid_search, graph_traverse, community_search, numeric_filter, conflict_scan, gap_scan, expert_lookup, finding_lookup, public_search
    )
}


def evidence_pool(rounds: DataFrame, by: str = "query_id", position: str = "pos") -> DataFrame:
    """Findings of all rounds of a question, each once: the first occurrence counts."""
    return catalog.dedupe_findings(rounds, [by], position) if position in rounds.columns else rounds.dropDuplicates([by, "id"])


def extract_with(documents: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = CLAIMS_IN) -> DataFrame:
    """Claims of a user's extractor, run batch by batch over the documents."""
    return documents.mapInPandas(extractor, schema)


def register_extractor(spark: SparkSession, name: str, extract: Callable[[Row], Iterable[tuple]], schema: str) -> None:
    """Makes a user's extractor a table function for SQL: ``SELECT * FROM name(TABLE(documents))``, one call of ``extract`` per row."""

    class Extractor:
        def eval(self, row: Row):
            yield from extract(row)

    spark.udtf.register(name, F.udtf(Extractor, returnType=schema))


def register_judge(spark: SparkSession, name: str, judge: Callable) -> None:
    """Makes a user's vectorised judge of (question, answer, context) a function for SQL."""
    spark.udf.register(name, F.pandas_udf(judge, "double"))


def judge_with(answers: DataFrame, judge: Callable | None) -> DataFrame:
    """Quality given by a user's vectorised function of (question, answer, context); without one it is null, never zero."""
    if judge is None:
        return answers.withColumn("judge", F.lit(None).cast("double"))
    scored = F.pandas_udf(judge, "double")
    return answers.withColumn("judge", scored("question", "answer", "context"))
