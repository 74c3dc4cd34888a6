"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.testdata import table
from . import bpe, chat, exact_dedup, html_text, jaccard, lm, mixing, periodic, prefix_trie, quality, topk, toxicity, warc
from .common import materialise, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, VOCABULARY)
    encoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op8_mixing", r"""
WITH sizes AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS ord,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
sources AS (
    SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
weighed AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight FROM sources),
filled AS (
    SELECT *, 3.0 * source_size / weight AS room,
           CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0) AS DOUBLE)
               / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS level
    FROM weighed WINDOW f AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, CAST(3 * source_size AS DOUBLE) / weight) AS level FROM filled WHERE CAST(3 * source_size AS DOUBLE) / weight > level),
targets AS (
    SELECT source, source_size, coalesce(least(weight * final.level, CAST(3 * source_size AS DOUBLE)), 0.0) AS target,
           [1.5, 1.0, 0.5][(rank - 1) % 3 + 1]::DOUBLE AS first, [0.5, 1.0, 1.5][(rank - 1) % 3 + 1]::DOUBLE AS last FROM filled LEFT JOIN final ON true),
runs AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, first, last, CAST(round(t.target) AS BIGINT) AS demand,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
done AS (
    SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (demand // source_size) * size
            + greatest(0, least(size, demand - (demand // source_size) * source_size - begun)) END AS BIGINT) AS taken,
           least(1.0::DOUBLE, CAST(begun AS DOUBLE) / greatest(target, 1.0::DOUBLE)) AS share
    FROM runs)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN share * (first + last) / (first + sqrt(first * first + (last * last - first * first) * share)) END AS position
FROM done
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.positions(mixing.curriculum(table(spark, sf_dir, "documents"), keep=("doc_id",)))
    first = placed.withColumn("position", F.get("positions", F.lit(0)))
    # the id spreads documents without a position over tasks too
    return first.orderBy(F.col("position").asc_nulls_last(), "row.doc_id").select("row.doc_id", "size", "source_size", "target", "taken", "position")


@query("op10_topk", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""")
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op4_chat_rotation", r"""
WITH turns AS (
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) AS pos,
           coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM turns WHERE speaker <> 'system'),
shown AS (
    SELECT t.conv_id, participant, CAST(pos // 512 AS BIGINT) AS part, pos, text, speaker = participant AS own,
           CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = participant THEN '<|assistant|>'
                ELSE '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' END || chr(10) AS head
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
    SELECT *, CAST(coalesce(sum(length(head) + length(text) + 8) OVER (
        PARTITION BY conv_id, participant, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS b
    FROM shown)
SELECT conv_id, participant, part, CAST(count(*) AS INTEGER) AS n_messages, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(b || '-' || (b + length(text)), ' ' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, participant, part
""")
def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["begin"], s["end"])), " ")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


#: Pages of one WARC file, and the bytes that mark, in the MD5 of a page id, the records the second replica has damaged or lost.
FILE_PAGES, DAMAGED, LOST = 1024, "00", "01"


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages as WARC files, and a copy of them with some records damaged and some lost."""
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    half = F.floor(F.length("html") / 2).cast("int")
    spoiled = F.concat(F.substr("html", F.lit(1), half), F.lit("#"), F.substr("html", half + 2))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.floor(F.col("page_id") / FILE_PAGES).alias("file"), mark.alias("mark"), warc.response_record(F.col("url"), F.col("html")).alias("record"),
        warc.response_record(F.col("url"), F.when(mark == DAMAGED, spoiled).otherwise(F.col("html"))).alias("copy"),
    )
    sized = pages.select("page_id", "file", "mark", F.octet_length("record").alias("size"), F.sha2("record", 256).alias("digest"), F.sha2("copy", 256).alias("copied"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = materialise(sized.withColumn("offset", before.cast("long")))
    return placed.select("file", "offset", "digest"), placed.filter(F.col("mark") != LOST).select("file", "offset", F.col("copied").alias("digest"))


@query("op6_warc_fixity", """
WITH p AS (
    SELECT page_id, page_id // 1024 AS file, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark, url, html,
           substr(html, 1, length(html) // 2) || '#' || substr(html, length(html) // 2 + 2) AS spoiled FROM pages),
r AS (
    SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
           chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM p),
w AS (
    SELECT file, page_id, mark, encode(head || octet_length(encode(html)) || gap || html || gap) AS a,
           encode(head || octet_length(encode(spoiled)) || gap || spoiled || gap) AS b FROM r),
o AS (
    SELECT *, CAST(coalesce(sum(octet_length(a)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM w)
SELECT CAST(file AS VARCHAR) AS file, "offset", sha256(a) AS left_digest, CASE WHEN mark = '00' THEN sha256(b) END AS right_digest,
       CASE WHEN mark = '00' THEN 'changed' ELSE 'missing' END AS kind
FROM o WHERE mark = '01' OR mark = '00' AND a <> b
""")
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit(*replicas(spark, sf_dir))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 10) == 0
    return lm.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 4) != 2)
    return quality.fit(table(spark, sf_dir, "documents"), labels)


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Most turns a rebuilt conversation takes from its base, and conversations that share one.
HEADS, SHARED = 8, 5


@query("op12_prefix_trie", """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t),
c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
               lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
    FROM named),
r AS (
    SELECT c.conv_id, 0 AS half, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (
    SELECT c.conv_id, coalesce(list(md5(md5(role) || text) ORDER BY half, pos) FILTER (half IS NOT NULL), []) AS s,
           coalesce(list(octet_length(encode(text)) ORDER BY half, pos) FILTER (half IS NOT NULL), []) AS sizes
    FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
p AS (
    SELECT conv_id, d AS depth, len(s) AS n, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes, min(conv_id) OVER (PARTITION BY d, s[1:d]) AS node
    FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s)),
nodes AS (
    SELECT node, depth, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '') AS ends
    FROM p GROUP BY node, depth),
linked AS (
    SELECT n.*, q.node AS parent FROM nodes n LEFT JOIN p q ON q.conv_id = n.node AND q.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent, depth),
whole AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON l.node = k.node AND l.depth = k.depth),
sums AS (
    SELECT q.node, q.depth, sum((w.n_convs - 1) * w.bytes) AS saved, count(*) FILTER (w.n_children = 0) AS n_leaves
    FROM whole w JOIN p q ON q.conv_id = w.node AND q.depth <= w.depth GROUP BY q.node, q.depth)
SELECT w.node AS conv_id, w.depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums s ON w.node = s.node AND w.depth = s.depth
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    return prefix_trie.trie(*prefix_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % SHARED, heads, HEADS))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), tail=periodic.tail_seed)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    # runs stand by start, then period; of the longest the first has the smallest start and period
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
