"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, exact_dedup, jaccard, mixing, queries, toxicity
from factweave.llm.common import materialise
from factweave.sources.testdata import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; empty ones stay."""
    rows = docs.select(F.struct("*").alias("row"), "text")  # an input column named score stays what it is
    return toxicity.score(rows, queries.toxicity_model(spark, sf_dir)).filter("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_newest(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (null last), by id and text where ids repeat.

    Rows that repeat id and text are one document and stay together.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    found = jaccard.near_duplicates(docs.select(key, "text"), id_col="key").select("key", "component_id").distinct()
    ids = docs.select(key, "doc_id").distinct()
    stays = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    return docs.select(F.struct("*").alias("row"), key).join(stays.select("key"), "key", "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' targets ask."""
    return mixing.training_order(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the check that they decode to the text."""
    ranks = bpe.read_ranks(spark, queries.VOCABULARY)
    # Written between the two, or every task holds two Python workers at a time.
    done = bpe.decode(materialise(bpe.encode(docs, ranks, queries.public_tokenizers.PATTERN)), ranks)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", mix), ("byte_bpe", tokenise)]

#: The classifier and the byte-level encoding have no form in SQL; tests compare the dedup stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
