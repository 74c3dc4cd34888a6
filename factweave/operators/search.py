"""Search for many questions at once: term scores, vectors, fusion, re-ranking and finalisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as scopes
from ..functions import text as X
from . import catalog
from .lineage import written

TOP_K = 6
RRF_K = 5
K1, B = 1.5, 0.75
MODE_WEIGHTS = {
    "hybrid": {"lexical": 1.0, "chunk": 0.3, "vector": 0.6},
    "lexical": {"lexical": 1.0},
    "semantic": {"vector": 1.0},
}
WEIGHTS = {"fusion": 0.42, "lexical": 0.28, "subject": 0.09, "source": 0.09, "numeric": 0.05, "community": 0.07}
QUERY_BLOCK = 2_048
QUERY_LIMIT = 4_096
#: Scores that a task holds at once.
SCORES = 1 << 22


# --- BM25 --------------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf) of every document."""
    return docs.select("id", F.explode(X.tokenize(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) for every document that shares a term with a question; a repeated question term adds again.

    Question terms meet the index by equality. Each posting joins the number of documents of its term and the length of its
    document, both partial aggregates, so no term's list stands in one task.
    """
    c = F.col
    # Written once: lengths, frequencies and scores read it, and texts are cut into terms a single time.
    index = written(postings(docs, text)) if index is None else index
    lengths = index.groupBy("id").agg(F.sum("tf").alias("dl"))
    total = docs.agg(F.count("*").alias("n"))
    size = lengths.agg(F.sum("dl").alias("s"))
    n = total.scalar()
    avgdl = F.coalesce(size.scalar(), F.lit(0)) / F.greatest(n, F.lit(1))
    terms = queries.select("query_id", F.explode(X.tokenize(c("text"))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf")
    )
    # Where the questions' terms are few they go to the documents: partial sums of a document then meet in its own partition.
    few = F.broadcast if _small(terms) else lambda df: df
    known = few(terms.select("term").distinct())
    used = index.join(known, "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").withColumn(
        "w", F.col("qtf") * F.log((n - c("df") + 0.5) / (c("df") + 0.5) + 1)
    )
    norm = F.lit(K1) * (1 - B + F.lit(B) * c("dl") / F.greatest(avgdl, F.lit(1.0)))
    saturated = used.join(lengths, "id").select("id", "term", (c("tf") * (K1 + 1) / (c("tf") + norm)).alias("s"))
    return saturated.join(few(weighted), "term").groupBy("query_id", "id").agg(F.sum(c("s") * c("w")).alias("score"))


def ranked(scored: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """First k per question by score, ties by id."""
    return catalog.top_k(scored, ["query_id"], order or [F.desc("score"), F.col("id")], k)


def best_terms(queries: DataFrame, docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """First k per question by :func:`bm25`, compared to nine digits, so that equal documents tie whatever the order of adding."""
    return ranked(bm25(queries, docs, text), k, [F.desc(F.round("score", 9)), F.col("id")])


def lexical_leg(queries: DataFrame, findings: DataFrame, k: int) -> DataFrame:
    """Best of statement (x3) and quote, by the term score of :func:`bm25` per field, to nine digits, so that equal documents tie."""
    field = lambda name: bm25(queries, findings, name).withColumn("score", F.round("score", 9))
    both = field("statement").withColumn("score", F.col("score") * 3).unionByName(field("quote"))
    return ranked(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def chunk_leg(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best of text (x3) and title (x2) over the active chunks."""
    live = chunks.filter(F.col("superseded_by").isNull()) if "superseded_by" in chunks.columns else chunks
    text = bm25(queries, live, "text").withColumn("score", F.col("score") * 3)
    title = bm25(queries, live, "title").withColumn("score", F.col("score") * 2)
    return ranked(text.unionByName(title).groupBy("query_id", "id").agg(F.round(F.max("score"), 9).alias("score")), k)


# --- vectors -----------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _best(ids: np.ndarray, scores: np.ndarray, names: list[str], k: int) -> pd.DataFrame:
    """Best k ids per question of a block of scores (questions x vectors); ties by id."""
    parts = []
    for row, name in zip(scores, names, strict=True):
        take = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
        # Values equal to the k-th one may stand outside the partition: of them the smallest ids stay.
        take = np.flatnonzero(row >= row[take].min())
        if len(take) > k:
            take = np.array(sorted(take, key=lambda i: (-row[i], ids[i]))[:k])
        parts.append(pd.DataFrame({"query_id": name, "id": ids[take], "score": row[take]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "id": [], "score": []})


def _best_blocks(ids: np.ndarray, asked: np.ndarray, units: np.ndarray, names: list[str], k: int):
    """``_best`` of questions against vectors, for as many questions at a time as SCORES allows."""
    step = max(1, SCORES // max(1, len(units)))
    for at in range(0, len(names), step):
        yield _best(ids, asked[at:at + step] @ units.T, names[at:at + step], k)


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0, 1.0, norms)


def vector_leg(queries: DataFrame, vectors: DataFrame, k: int, classes=None, dim: int | None = None) -> DataFrame:
    """Exact top k by cosine inside the allowed classes; a question of another dimension finds nothing.

    Up to QUERY_LIMIT questions travel to every task and each batch of vectors keeps its own best k. More questions are cut
    into blocks that meet blocks of vectors by key. Only k rows per question and batch are ranked at the end.
    """
    live = vectors.filter(scopes.allowed(F.col("data_class"), classes)) if "data_class" in vectors.columns else vectors
    if dim is not None:
        queries = queries.filter(F.size("embedding") == dim)
        live = live.filter(F.size("embedding") == dim)
    schema = "query_id string, id string, score double"
    asked = queries.select("query_id", "embedding")
    few = asked.limit(QUERY_LIMIT + 1).collect()
    if not few:
        return live.sparkSession.createDataFrame([], schema + ", rank int")
    if len(few) <= QUERY_LIMIT:
        names, matrix = [r.query_id for r in few], _unit([r.embedding for r in few])

        def scan(batches):
            for batch in batches:
                if len(batch):
                    yield from _best_blocks(batch["id"].to_numpy(), matrix, _unit(batch["embedding"]), names, k)

        scored = live.select("id", "embedding").mapInPandas(scan, schema)
    else:
        scored = _block_scores(asked, live.select("id", "embedding"), k, schema)
    return ranked(scored, k)


def _block_scores(asked: DataFrame, live: DataFrame, k: int, schema: str) -> DataFrame:
    """Question blocks against vector blocks: every pair of blocks is one group of bounded size."""
    q_parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    v_parts = max(1, math.ceil(live.count() / 16_384))
    slot = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("qb", slot("query_id", q_parts)).withColumn("vb", every(v_parts))
    v = live.withColumn("vb", slot("id", v_parts)).withColumn("qb", every(q_parts))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return pd.concat(_best_blocks(right["id"].to_numpy(), _unit(left["embedding"]), _unit(right["embedding"]), list(left["query_id"]), k))

    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(pair, schema)


# --- substring hits ----------------------------------------------------------------------------------------------------


def token_hits(queries: DataFrame, texts: DataFrame, text: str, tokens: DataFrame | None = None) -> DataFrame:
    """(query_id, id, hits): how many of a question's tokens stand inside a text, as substrings.

    A token has no blank, so it stands in a text exactly when it stands in one of its words. The distinct words of the
    corpus meet the tokens through four-character grams by equality, and only matching words go back to their texts.
    Tokens below four characters meet by their own length. ``tokens`` (query_id, token) replaces the question's own.
    """
    c = F.col
    if tokens is None:
        tokens = queries.select("query_id", F.explode(X.query_tokens(c("text"))).alias("token"))
    places = texts.select("id", F.explode(F.array_distinct(X.words(F.lower(text)))).alias("word"))
    vocabulary = places.select("word").distinct()
    gram = lambda col, n: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(col) - (n - 1), F.lit(1))), lambda i: F.substr(col, i, F.lit(n))
    ))
    grams = vocabulary.select("word", F.explode(F.flatten(F.array(*[gram(c("word"), n) for n in (1, 2, 3, 4)]))).alias("gram"))
    keys = tokens.select("token").distinct().withColumn("gram", F.substring("token", 1, 4))
    # Grams of one to three characters are needed only by tokens of that length.
    short = keys.select("gram").distinct()
    # Written: where few words hold a token, the texts' words stay where they are.
    found = written(grams.join(F.broadcast(short) if _small(short) else short, "gram", "left_semi").join(keys, "gram").filter(
        c("word").contains(c("token"))
    ).select("word", "token").distinct())
    hit = places.join(found, "word").select("id", "token").distinct()
    return hit.join(tokens, "token").groupBy("query_id", "id").agg(F.count("*").alias("hits"))


def _small(df: DataFrame, limit: int = 200_000) -> bool:
    return df.limit(limit + 1).count() <= limit


def score_findings(queries: DataFrame, findings: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(query_id, id, score, statement_hits, confidence), zero scores left out.

    ``lexical`` counts statement hits; ``hybrid`` adds 0.3 per quote hit, 0.5 per title hit and 0.5 when the subject stands
    in the question. Columns of findings: id, statement, quote, source_title, subject, confidence.
    """
    c = F.col
    legs = [token_hits(queries, findings, "statement").select("query_id", "id", c("hits").alias("s"), F.lit(0).alias("e"), F.lit(0).alias("t"), F.lit(0).alias("b"))]
    if mode == "hybrid":
        legs.append(token_hits(queries, findings, "quote").select("query_id", "id", F.lit(0).alias("s"), c("hits").alias("e"), F.lit(0).alias("t"), F.lit(0).alias("b")))
        titles = findings.select(c("source_title").alias("id"), "source_title").distinct()
        by_title = token_hits(queries, titles, "source_title").withColumnRenamed("id", "source_title")
        legs.append(findings.select("id", "source_title").join(by_title, "source_title").select(
            "query_id", "id", F.lit(0).alias("s"), F.lit(0).alias("e"), c("hits").alias("t"), F.lit(0).alias("b")
        ))
        legs.append(subject_in_query(queries, findings).select("query_id", "id", F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("t"), F.lit(1).alias("b")))
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    hits = every.groupBy("query_id", "id").agg(*[F.sum(x).alias(x) for x in "setb"])
    # Tenths keep the sum exact.
    score = (c("s") * 10 + c("e") * 3 + c("t") * 5 + c("b") * 5) / 10.0
    return hits.join(findings.select("id", "confidence"), "id").select(
        "query_id", "id", score.alias("score"), c("s").alias("statement_hits"), c("e").alias("quote_hits"), c("t").alias("title_hits"),
        c("b").alias("subject_hit"), "confidence",
    ).filter(c("score") > 0)


def subject_in_query(queries: DataFrame, findings: DataFrame) -> DataFrame:
    """(query_id, id) where the subject stands in the question as a substring.

    A subject that stands in a question starts at some position of it: the question's substrings of the length of an
    existing subject, at every position, meet the distinct subjects by equality.
    """
    c = F.col
    subjects = findings.filter(F.trim("subject") != "").select("id", F.lower("subject").alias("subject"))
    sizes = F.array_sort(F.collect_set(F.length("subject")))
    lengths = subjects.select("subject").distinct().agg(sizes.alias("sizes"))
    spots = queries.withColumn("q", F.lower("text")).withColumn("sizes", lengths.scalar()).select(
        "query_id", "q", F.explode("sizes").alias("n")
    ).filter(c("n") <= F.length("q")).select(
        "query_id", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("q") - c("n") + 1), lambda i: F.substr("q", i, c("n"))
        ))).alias("subject")
    )
    return spots.join(subjects, "subject").select("query_id", "id").distinct()


def score_order() -> list[Column]:
    return [F.desc("score"), F.desc("statement_hits"), F.desc("confidence"), F.col("id")]


# --- fusion and re-ranking ---------------------------------------------------------------------------------------------


def rrf(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, id, rank) lists."""
    weights = weights or MODE_WEIGHTS["hybrid"]
    every = None
    for name, leg in legs.items():
        if name not in weights:
            continue
        part = leg.select("query_id", "id", (F.lit(weights[name]) / (k + F.col("rank"))).alias("share"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "id").agg(F.sum("share").alias("fusion"))


def rerank_signals(cands: DataFrame) -> DataFrame:
    """Signals in [0, 1] of the candidates of each question.

    Columns: query_id, text, id, fusion, statement, quote, source_title, subject, n_observations, n_units.
    """
    c = F.col
    tokens = X.query_tokens(c("text"))
    rows = cands.withColumns({"_tokens": tokens, "_s": F.lower("statement"), "_e": F.lower("quote"), "_t": F.lower("source_title"), "_b": F.trim(F.lower(F.coalesce("subject", F.lit(""))))})
    count = lambda test: F.size(F.filter("_tokens", test))
    best = F.max("fusion").over(Window.partitionBy("query_id"))
    volume = F.log(1 + c("n_observations")) / math.log(4)
    signals = {
        "s_fusion": F.when(best > 0, c("fusion") / best).otherwise(0.0),
        "s_lexical": F.least(count(lambda t: c("_s").contains(t) | c("_e").contains(t)), F.lit(5)) / 5.0,
        "s_subject": F.when(c("_b") == "", 0.0).when(F.lower("text").contains(c("_b")), 1.0).otherwise(
            F.least(count(lambda t: c("_b").contains(t)), F.lit(2)) / 2.0
        ),
        "s_source": F.least(count(lambda t: c("_t").contains(t)), F.lit(2)) / 2.0,
        "s_numeric": F.when(c("n_observations") == 0, 0.0).otherwise(
            F.least(F.lit(1.0), volume + F.when(c("n_units") > 1, 0.1).otherwise(0.0))
        ),
    }
    out = rows.withColumns(signals)
    base = sum((F.lit(WEIGHTS[n]) * c(f"s_{n}") for n in ("fusion", "lexical", "subject", "source", "numeric")), F.lit(0.0))
    return out.withColumn("base", base).drop("_tokens", "_s", "_e", "_t", "_b")


def rerank(signals: DataFrame, top_k: int = TOP_K, bonus: float = WEIGHTS["community"]) -> DataFrame:
    """Greedy selection: once a community has a member, its other candidates gain the bonus; ties by id.

    In closed form: the best of a community is its head, and every item without a community is one. A follower that beats
    its head's score with the bonus comes right behind the head, ordered among such followers; any other follower stands by
    its own score with the bonus.
    """
    c = F.col
    unit = F.coalesce(F.when(c("community") != "", F.concat(F.lit("c:"), c("community"))), F.concat(F.lit("i:"), c("id")))
    w = Window.partitionBy("query_id", "_unit").orderBy(F.desc("_base"), "id")
    # Scores compare as whole billionths, so that sums added in another order still tie.
    whole = lambda col: F.round(col * 1_000_000_000).cast("bigint")
    rows = signals.withColumns({"_unit": unit, "_base": whole(c("base"))}).withColumns({
        "_head": F.row_number().over(w) == 1, "_head_base": F.first("_base").over(w), "_head_id": F.first("id").over(w),
    })
    own = c("_base") + F.when(c("_head"), F.lit(0)).otherwise(whole(F.lit(bonus)))
    # At an equal score a follower with a smaller id than its head also waits for the head and then comes next.
    behind = ~c("_head") & ((own > c("_head_base")) | ((own == c("_head_base")) & (c("id") < c("_head_id"))))
    rows = rows.withColumns({
        "_total": own, "total": own / 1_000_000_000, "_key": F.when(behind, c("_head_base")).otherwise(own),
        "_tie": F.when(behind, c("_head_id")).otherwise(c("id")),
    })
    return catalog.top_k(
        rows, ["query_id"], [F.desc("_key"), F.col("_tie"), F.desc("_head"), F.desc("_total"), F.col("id")], top_k
    ).drop("_unit", "_head", "_head_base", "_head_id", "_key", "_tie", "_base", "_total")


def rerank_degraded(selected: DataFrame) -> DataFrame:
    """Questions whose selected candidates all have no score."""
    return selected.groupBy("query_id").agg((F.max("total") <= 0).alias("degraded"))


def candidate_window(plans: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Candidates to ask for: 3 x top_k, 6 x when the plan has limits."""
    limits = (
        (F.coalesce(F.size("numeric_filters"), F.lit(0)) > 0) | (F.coalesce(F.size("countries"), F.lit(0)) > 0)
        | F.coalesce(F.col("year_from") != 0, F.lit(False)) | F.coalesce(F.col("year_to") != 0, F.lit(False))
    )
    return plans.withColumn("window", F.when(limits, top_k * 6).otherwise(top_k * 3))


def limit_marks(cands: DataFrame) -> DataFrame:
    """Marks of the plan's limits on each candidate: ``_numeric``, ``_ok``, ``is_demo`` and those of ``enforce_scope``."""
    from ..functions.measures import numeric_filters_keep

    c = F.col
    marked = catalog.enforce_scope(cands).withColumn("_numeric", numeric_filters_keep(c("observations"), c("numeric_filters")))
    return marked.withColumns({"_ok": c("_numeric") & ~c("dropped"), "is_demo": scopes.is_demo(c("scope"))})


def finalize(cands: DataFrame, by: str, top_k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """(kept rows, report per plan): first occurrence, number limits, year and territory, demo last, then the cap.

    ``cands`` carries the plan's columns (numeric_filters, year_from, year_to, countries) and ``pos``. Marks belong to a row alone: they
    are formed before rows move, so that only columns asked of the result are moved. Candidates that carry ``limit_marks`` keep them.
    """
    c = F.col
    marked = catalog.dedupe_findings(cands if "_numeric" in cands.columns else limit_marks(cands), [by])
    w = Window.partitionBy(by).orderBy("is_demo", "pos")
    kept = marked.filter("_ok").withColumn("rank", F.row_number().over(w)).filter(c("rank") <= top_k)
    report = marked.groupBy(by).agg(
        F.count("*").alias("pool"), F.count_if(~c("_numeric")).alias("numeric_removed"),
        F.count_if(c("_numeric") & c("dropped")).alias("scope_removed"),
        F.count_if(c("_ok") & c("unknown_year")).alias("unknown_year"),
        F.count_if(c("_ok") & c("unknown_geography")).alias("unknown_geography"),
        F.count_if("_ok").alias("matching"), F.least(F.count_if("_ok"), F.lit(top_k)).alias("returned"),
        F.count_if(c("_ok") & c("is_demo")).alias("demo"), (F.count_if("_ok") == 0).alias("no_evidence"),
    )
    return kept.drop("_ok", "_numeric"), report


def hybrid_retrieval(queries: DataFrame, findings: DataFrame, k: int, keywords=X.TECH_KEYWORDS) -> DataFrame:
    """Term score of the statement, 0.3 of the quote's, 0.2 per question token whose first four characters stand in the
    title, and 0.5 x confidence per technical token shared with the statement."""
    c = F.col
    terms = queries.select("query_id", F.explode(X.tokenize(c("text"))).alias("term")).filter(F.length("term") >= 4)
    statement = bm25(queries, findings, "statement")
    quote = bm25(queries, findings, "quote").withColumn("score", c("score") * 0.3)
    # Titles repeat: each distinct one meets the distinct beginnings through its own four-character grams.
    titles = findings.select(F.lower("source_title").alias("title")).distinct()
    grams = titles.filter(F.length("title") >= 4).select("title", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("title") - 3), lambda i: F.substr("title", i, F.lit(4))
    ))).alias("g"))
    overlap = grams.join(terms.withColumn("g", F.substring("term", 1, 4)), "g").groupBy("query_id", "title").agg((F.count("*") * 0.2).alias("score"))
    by_title = findings.select("id", F.lower("source_title").alias("title")).join(overlap, "title").select("query_id", "id", "score")
    technical = F.lit(False)
    for word in keywords:
        technical = technical | c("term").contains(word) | F.lit(word).contains(c("term"))
    tech = terms.filter(technical).distinct()
    own = postings(findings, "statement").select("id", "term").join(findings.select("id", "confidence"), "id")
    entity = own.join(tech, "term").groupBy("query_id", "id").agg((F.count("*") * 0.5 * F.max("confidence")).alias("score"))
    every = statement.unionByName(quote).unionByName(by_title).unionByName(entity)
    return ranked(every.groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score")), k)


def select_relevant(queries: DataFrame, findings: DataFrame, n: int) -> DataFrame:
    """First n findings per question by statement hits, quote hits and confidence; without tokens by confidence alone."""
    c = F.col
    hits = score_findings(queries, findings, "hybrid").filter((c("statement_hits") > 0) | (c("quote_hits") > 0))
    order = [F.desc("statement_hits"), F.desc("quote_hits"), F.desc("confidence"), c("id")]
    # Written: the hits are worked out once. A question that has places left holds all its hits here, so fillers need no other list.
    best = written(catalog.top_k(hits.select("query_id", "id", "statement_hits", "quote_hits", "confidence"), ["query_id"], order, n))
    # Findings without any hit fill the places that are left, the most confident first: the same n for every question.
    # A question with fewer than n hits finds n others among the first 2n, so a list of 2n is enough.
    rest = findings.select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(2 * n).agg(
        F.collect_list(F.struct("id", "confidence"))
    )
    filler = queries.select("query_id", F.explode(rest.scalar()).alias("r")).select("query_id", "r.*").join(
        best.select("query_id", "id"), ["query_id", "id"], "left_anti"
    ).select("query_id", "id", F.lit(0).cast("bigint").alias("statement_hits"), F.lit(0).cast("bigint").alias("quote_hits"), "confidence")
    return catalog.top_k(best.drop("rank").unionByName(filler), ["query_id"], order, n)


def retrieve(queries: DataFrame, findings: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None,
             mode: str = "hybrid", top_k: int = TOP_K, classes=None) -> DataFrame:
    """Legs, fusion, signals and greedy re-ranking for all questions in one plan.

    The access rule stands before the ranking. Neighbourhood and community briefs come from the graph operators.
    """
    c = F.col
    window = top_k * 3
    visible = findings.filter(scopes.allowed(c("data_class"), classes))
    legs = {}
    if mode in ("hybrid", "lexical"):
        legs["lexical"] = ranked(score_findings(queries, visible, "hybrid"), window, score_order())
    if mode == "hybrid":
        legs["chunk"] = best_terms(queries, visible, window, "quote")
    if mode in ("hybrid", "semantic") and vectors is not None:
        legs["vector"] = vector_leg(query_vectors, vectors, window, classes)
    fused = ranked(rrf(legs, MODE_WEIGHTS[mode]).withColumn("score", c("fusion")), window).drop("score", "rank")
    cands = fused.join(visible, "id").join(queries, "query_id")
    return rerank(rerank_signals(cands), top_k)
