"""Files and stored JSON as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Readable suffixes (text layers only) and size limits.
SUFFIXES = (".txt", ".md", ".json")
MAX_BYTES = 20 * 1024 * 1024
MIN_TEXT = 20


def scan_corpus(
    spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, limit: int | None = None, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """Files below ``path`` with a status: unsupported, oversize, or pending; pending ones in path order up to ``limit``.

    Contents are not read here: only names and sizes are needed, and the content column is pruned from the scan. Spark's file source
    does not list files of no bytes, so they have no row.
    """
    c = F.col
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    status = F.when(~suffix.isin(*suffixes), "unsupported").when(c("length") > max_bytes, "oversize").otherwise("pending")
    marked = files.withColumn("status", status)
    if limit is None:
        return marked
    taken = marked.filter(c("status") == "pending").orderBy(F.lower("path")).limit(limit)
    return marked.filter(c("status") != "pending").unionByName(taken)


def read_text_documents(
    spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """Text and JSON files as one-fragment documents; ``error`` names why a file is refused. Files of no bytes are not listed."""
    c = F.col
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    read = files.filter(suffix.isin(*suffixes)).withColumn("text", F.when(c("length") <= max_bytes, text)).drop("content")
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    error = (
        F.when(c("length") > max_bytes, "oversize")
        .when(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) < MIN_TEXT, "too_short")
        .when((suffix == ".json") & F.try_parse_json("text").isNull(), "invalid_json")
    )
    return read.select(
        "path", name.alias("title"), "text", error.alias("error"),
        F.array(F.struct(
            c("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet"),
            F.lit(None).cast("string").alias("cell_range"), F.lit(0).alias("source_char_start"),
        )).alias("fragments"),
    )


def load_json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Stored JSON parsed against a schema: ``record`` is null and ``corrupt`` true where it does not fit."""
    fields = T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_p", parsed)
    corrupt = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    record = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in fields.fields])
    return out.withColumn("corrupt", corrupt).withColumn("record", F.when(~F.col("corrupt"), record)).drop("_p")


def salvage_items(items: Column, rule) -> Column:
    """(kept, dropped, missing): items that meet the rule; a missing section differs from an empty one."""
    kept = F.filter(items, lambda x: F.coalesce(rule(x), F.lit(False)))
    return F.struct(
        F.coalesce(kept, F.slice(items, 1, 0)).alias("kept"),
        F.coalesce(F.size(items) - F.size(kept), F.lit(0)).alias("dropped"), items.isNull().alias("missing"),
    )
