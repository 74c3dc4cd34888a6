"""Catalog of findings: filters, paging, retention, merging, versions, batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, scope as scopes
from .lineage import checkpoint

PAGE_MAX = 500
SCHEMA_VERSION = 3


# --- filters -----------------------------------------------------------------------------------------------------------


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_by").isNull())


def _filled(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def facts(df: DataFrame) -> DataFrame:
    """Findings with subject, predicate, object and evidence."""
    c = F.col
    return df.filter(_filled(c("subject")) & _filled(c("predicate")) & _filled(c("object")) & (F.size("evidence") > 0))


def exclude_demo(df: DataFrame) -> DataFrame:
    return df.filter(~scopes.is_demo(F.col("scope")))


def split_demo(df: DataFrame, position: str) -> DataFrame:
    """Real rows before demo rows, the given order kept inside both; ``demo_rank`` and ``is_demo``."""
    return df.withColumn("is_demo", scopes.is_demo(F.col("scope"))).orderBy("is_demo", position)


def semantic(df: DataFrame) -> DataFrame:
    """Findings with a meaning of their own: no structural chunks, active, no demo content."""
    return exclude_demo(active(df)).filter(~F.col("id").startswith("chunk-"))


def filter_findings(
    df: DataFrame, status: str | None = None, subject: str | None = None, document_id: str | None = None, text: str | None = None
) -> DataFrame:
    """Status equality, subject substring, cited document, free text over statement, subject and quotes; case ignored."""
    c = F.col
    if status:
        df = df.filter(c("status") == status)
    if subject:
        df = df.filter(F.lower("subject").contains(subject.strip().lower()))
    if document_id:
        df = df.filter(F.exists("evidence", lambda e: e["document_id"] == document_id))
    if text and text.strip():
        needle = text.strip().lower()
        df = df.filter(
            F.lower("statement").contains(needle) | F.coalesce(F.lower("subject").contains(needle), F.lit(False))
            | F.exists("evidence", lambda e: F.lower(e["quote"]).contains(needle) | F.lower(e["source_title"]).contains(needle))
        )
    return df


def filter_signals(df: DataFrame, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Kind equality and free text over statement, proposal and quotes."""
    if kind:
        df = df.filter(F.col("kind") == kind)
    if text and text.strip():
        needle = text.strip().lower()
        df = df.filter(
            F.lower("statement").contains(needle) | F.coalesce(F.lower("proposal").contains(needle), F.lit(False))
            | F.exists("evidence", lambda e: F.lower(e["quote"]).contains(needle))
        )
    return df


def filter_entities(df: DataFrame, entities: list[str]) -> DataFrame:
    """Subjects that hold one of the names as a whole word: Fe does not match Fe2O3."""
    names = [e.strip().lower() for e in entities if e.strip()]
    if not entities:
        return df
    if not names:
        return df.filter(F.lit(False))
    any_of = "|".join(re.escape(n) for n in names)
    return df.filter(F.lower("subject").rlike(rf"(?U)(?<!\w)(?:{any_of})(?!\w)"))


def apply_numeric_filters(df: DataFrame, filters: Column) -> DataFrame:
    return df.filter(measures.numeric_filters_keep(F.col("observations"), filters))


def enforce_scope(rows: DataFrame) -> DataFrame:
    """Marks of the year and territory limits of a plan joined to each row.

    Columns year_from, year_to, countries come from the plan. Adds ``dropped``, ``unknown_year``, ``unknown_geography``; an
    undocumented value keeps the row. A row dropped by its year is not asked for its territory.
    """
    c = F.col
    year, place = scopes.documented_year(c("scope")), scopes.documented_geography(c("scope"))
    wants_year = c("year_from").isNotNull() | c("year_to").isNotNull()
    wants_place = F.coalesce(F.size("countries") > 0, F.lit(False))
    marked = rows.withColumns({"_year": year, "_place": place}).withColumn(
        "_out_year", F.coalesce((c("_year") < c("year_from")), F.lit(False)) | F.coalesce(c("_year") > c("year_to"), F.lit(False))
    )
    out_place = wants_place & c("_place").isNotNull() & ~scopes.geography_matches(c("_place"), c("countries"))
    return marked.withColumns({
        "unknown_year": wants_year & c("_year").isNull(),
        "unknown_geography": wants_place & ~c("_out_year") & c("_place").isNull(),
        "dropped": c("_out_year") | F.coalesce(out_place, F.lit(False)),
    }).drop("_year", "_place", "_out_year")


def scope_report(marked: DataFrame, by: list[str]) -> DataFrame:
    return marked.groupBy(*by).agg(
        F.count("*").alias("candidates"), F.count_if("dropped").alias("dropped"),
        F.count_if("unknown_year").alias("unknown_year"), F.count_if("unknown_geography").alias("unknown_geography"),
    )


# --- windows, pages, retention -----------------------------------------------------------------------------------------


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; Spark limits each group before the shuffle, so large groups stay cheap."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def page(df: DataFrame, limit: int, offset: int, order: list[Column]) -> DataFrame:
    """One page with the total before paging; limit 1..500, offset from 0."""
    limit, offset = min(max(limit, 1), PAGE_MAX), max(offset, 0)
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def recent(log: DataFrame, limit: int, offset: int = 0, actor: str | None = None, correlation: str | None = None) -> DataFrame:
    """Newest rows first, one more than asked: it tells whether there are further pages."""
    if actor is not None:
        log = log.filter(F.col("actor_id") == actor)
    if correlation is not None:
        log = log.filter(F.col("correlation_id") == correlation)
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset(max(offset, 0)).limit(max(limit, 1) + 1)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Newest row per key."""
    return top_k(df, [key], order, 1, "_n").drop("_n")


def trim_answers(answers: DataFrame, as_of, per_owner: int = 100, total: int = 5000) -> DataFrame:
    """Unexpired answers: the last used of each owner, then the last used overall."""
    used = F.coalesce("last_accessed_at", "created_at").desc()
    alive = answers.filter(F.col("expires_at") > as_of)
    own = top_k(alive, ["owner_id"], [used, F.desc("query_id")], per_owner, "_n").drop("_n")
    return own.orderBy(used, F.desc("query_id")).limit(total)


def trim_log(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def trim_queue(queue: DataFrame, n: int) -> DataFrame:
    """Capped queue: rows that are not accepted, and the oldest, leave first."""
    return queue.orderBy((F.col("status") == "accepted").desc(), F.desc("created_at"), F.desc("id")).limit(n)


# --- merging -----------------------------------------------------------------------------------------------------------


def dedupe_findings(df: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """First occurrence of an id per list."""
    return top_k(df, [*by, "id"], [F.col(position)], 1, "_n").drop("_n")


def merge_by_id(left: DataFrame, right: DataFrame, position: str = "pos") -> DataFrame:
    """Union by id: values of the right side win, the place of the first occurrence stays (left list first)."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    row = F.struct(*left.columns)
    merged = both.groupBy("id").agg(
        F.max_by(row, F.struct("_side", position)).alias("r"), F.min(F.struct("_side", position)).alias("first")
    )
    return merged.select(
        *[F.col("r")[c].alias(c) for c in left.columns if c != position],
        F.col("first._side").alias("first_side"), F.col(f"first.{position}").alias(position),
    )


def merge_graphs(
    left: tuple[DataFrame, DataFrame, DataFrame], right: tuple[DataFrame, DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, community names) of two snapshots."""
    nodes, edges = (upsert(a, b, "id") for a, b in zip(left[:2], right[:2], strict=True))
    return nodes, edges, left[2].unionByName(right[2]).distinct()


def upsert(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch replace rows of the base with the same key."""
    return base.join(batch.select(key), key, "left_anti").select(*base.columns).unionByName(batch)


def register_new(base: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Only rows whose key is not in the base (one row per key)."""
    return batch.dropDuplicates([key]).join(base.select(key), key, "left_anti")


def set_status(df: DataFrame, updates: DataFrame) -> DataFrame:
    """New status by id; version and other fields stay."""
    new = updates.select("id", F.col("status").alias("_new"))
    return df.join(new, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def rollback_batch(nodes: DataFrame, edges: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Remove what the batch created and the edges that would lose an end."""
    gone = nodes.filter(F.col("created_by") == batch_id).select("id")
    kept = nodes.filter(~F.col("created_by").eqNullSafe(batch_id))
    left = edges.filter(~F.col("created_by").eqNullSafe(batch_id))
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return kept, left


def backfill_fields(df: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Re-derive filter fields from the stored record where the row was written under another schema version."""
    record = F.from_json(
        "finding_json", "status STRING, subject STRING, superseded_by STRING, scope MAP<STRING,STRING>"
    )
    stale = ~F.col("schema_version").eqNullSafe(version)
    new = {
        "status": F.col("_r.status"), "subject_lower": F.lower("_r.subject"), "superseded_by": F.col("_r.superseded_by"),
        "scope_text": scopes.scope_text(scopes.scope_items(F.col("_r.scope"))),
    }
    out = df.withColumn("_r", record).withColumn("_stale", stale)
    return out.withColumns({k: F.when(F.col("_stale"), v).otherwise(F.col(k)) for k, v in new.items()}).withColumns(
        {"updated": F.col("_stale"), "schema_version": F.lit(version)}
    ).drop("_r", "_stale")


def id_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids present after but not before, per kind."""
    return after.select("kind", "id").distinct().join(before.select("kind", "id"), ["kind", "id"], "left_anti")


def case_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases passed on one side only: regressions and newly passed."""
    b, c = baseline.select("case_id").distinct(), candidate.select("case_id").distinct()
    return b.join(c, "case_id", "left_anti").withColumn("change", F.lit("regression")).unionByName(
        c.join(b, "case_id", "left_anti").withColumn("change", F.lit("newly_passed"))
    )


def dedupe_requests(requests: DataFrame, by: list[str]) -> DataFrame:
    """Owner (first position) of each identical request of a plan; a duplicate inherits the owner's result."""
    key = F.xxhash64(
        "tool", F.to_json(F.col("finding_ids")), "query", F.to_json(F.col("entities")),
        F.to_json(F.array_sort("relation_types")), "max_hops",
    )
    same = ["tool", "finding_ids", "query", "entities", "_relations", "max_hops"]
    rows = requests.withColumn("_relations", F.array_sort("relation_types")).withColumn("_key", key)
    owners = rows.groupBy(*by, "_key", *same).agg(F.min("pos").alias("owner_pos"))
    return rows.join(owners, [*by, "_key", *same]).withColumn("duplicate", F.col("pos") != F.col("owner_pos")).drop("_key", "_relations")


def load_findings(ids: DataFrame, primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """Requested findings in request order without repeats; primary store first, superseded rows removed."""
    stores = primary.withColumn("_store", F.lit(0)).unionByName(fallback.withColumn("_store", F.lit(1)))
    one = top_k(active(stores), ["id"], [F.col("_store")], 1, "_n").drop("_n")
    wanted = ids.groupBy(*by, "id").agg(F.min("pos").alias("pos"))
    return wanted.join(one, "id")


# --- versions ----------------------------------------------------------------------------------------------------------


def _ends(links: DataFrame) -> DataFrame:
    """Last id reached from each linked id over ``links`` (id -> next, one a row), by pointer doubling.

    A chain of n links is walked after about log2(n) rounds; whatever has no end by then leads into a cycle, whose smallest
    id is its end.
    """
    last = links.select(F.col("next").alias("id")).distinct().join(links.select("id"), "id", "left_anti")
    state = checkpoint(
        links.select("id", F.col("next").alias("end"), F.col("next").alias("low"), F.lit(False).alias("closed"))
        .unionByName(last.select("id", F.col("id").alias("end"), F.col("id").alias("low"), F.lit(True).alias("closed")))
    )
    for _ in range(state.count().bit_length() + 1):
        if not state.filter("NOT closed").limit(1).count():
            return state.select("id", "end")
        jump = state.select(F.col("id").alias("end"), F.col("end").alias("far"), F.col("low").alias("far_low"), F.col("closed").alias("far_closed"))
        state = checkpoint(state.join(jump, "end").select(
            "id", F.col("far").alias("end"), F.least("low", "far_low").alias("low"), F.col("far_closed").alias("closed")
        ))
    inside = state.select(F.col("id").alias("end"), F.col("low").alias("cycle"))
    return state.join(inside, "end").select("id", F.when(F.col("closed"), F.col("end")).otherwise(F.col("cycle")).alias("end"))


def version_history(findings: DataFrame) -> DataFrame:
    """Version chain of every finding: (finding_id, version_id, version, position).

    The head is the last replacement that exists; from it the chain walks back, over the smallest id where several
    findings were replaced by the same one. Only replaced findings and their replacements take part in the iteration.
    """
    rows = checkpoint(findings.select("id", "version", "superseded_by"))
    links = rows.filter(F.col("superseded_by").isNotNull()).select("id", F.col("superseded_by").alias("next"))
    links = checkpoint(links.join(rows.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next"))
    first = links.groupBy("next").agg(F.min("id").alias("id")).select("id", "next")
    heads = _ends(links)
    # Another predecessor of the same replacement leads to the head but is not a member of its chain.
    branches = links.join(first, ["id", "next"], "left_anti").select("id")
    members = heads if not branches.limit(1).count() else _ends(first)
    members = members.join(branches, "id", "left_anti").select(F.col("id").alias("version_id"), "end")
    alone = rows.join(heads.select("id"), "id", "left_anti")
    chain = heads.select(F.col("id").alias("finding_id"), "end").join(members, "end")
    chain = chain.join(rows.select(F.col("id").alias("version_id"), "version"), "version_id")
    w = Window.partitionBy("finding_id").orderBy("version", "version_id")
    return chain.select("finding_id", "version_id", "version", F.row_number().over(w).alias("position")).unionByName(
        alone.select(F.col("id").alias("finding_id"), F.col("id").alias("version_id"), "version", F.lit(1).alias("position"))
    )


def supersede(findings: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, SUPERSEDES edges, refused corrections).

    A correction names ``finding_id``, ``new_statement``, ``new_confidence`` and the reviewer fields. The first correction
    of an active finding makes version n+1 with the old evidence, status, scope and class; others are refused.
    """
    c = F.col
    state = findings.select(c("id").alias("finding_id"), c("superseded_by").alias("_by"), F.lit(True).alias("_known"))
    asked = corrections.join(state, "finding_id", "left")
    w = Window.partitionBy("finding_id").orderBy("seq")
    asked = asked.withColumn("_n", F.row_number().over(w)).withColumn(
        "refused",
        F.when(c("_known").isNull(), "not_found").when(c("_by").isNotNull() | (c("_n") > 1), "already_superseded"),
    )
    good = asked.filter(c("refused").isNull()).drop("_by", "_known", "_n", "refused")
    refused = asked.filter(c("refused").isNotNull()).select("finding_id", "seq", "refused")
    new_id = F.concat(c("id"), F.lit("-v"), c("version") + 1)
    joined = findings.join(good.withColumnRenamed("finding_id", "id").withColumnsRenamed(
        {x: f"_{x}" for x in ("reviewer_id", "review_date", "review_reason")}
    ), "id")
    made = joined.withColumns({
        "_new_id": new_id, "statement": c("new_statement"), "confidence": c("new_confidence"), "version": c("version") + 1,
        "reviewer_id": c("_reviewer_id"), "review_date": c("_review_date"), "review_reason": c("_review_reason"),
    })
    edges = made.select(
        F.concat(F.lit("supersedes-"), c("_new_id")).alias("id"), c("_new_id").alias("source"), c("id").alias("target"),
        F.lit("SUPERSEDES").alias("relation"), c("new_confidence").alias("confidence"), "data_class",
    )
    nothing = F.lit(None).cast("string")
    fresh = made.withColumns({
        "id": c("_new_id"), "object": nothing, "fact_kind": nothing, "context": nothing, "superseded_by": nothing,
    }).select(*findings.columns)
    marks = good.select(c("finding_id").alias("id"), F.lit(True).alias("_hit"))
    old = findings.join(marks, "id", "left").withColumn(
        "superseded_by", F.when(c("_hit"), new_id).otherwise(c("superseded_by"))
    ).select(*findings.columns)
    return old.unionByName(fresh), edges, refused


def lookup_findings(ids: DataFrame, findings: DataFrame, classes) -> DataFrame:
    """Current version of each requested finding, inside the allowed classes."""
    history = version_history(findings)
    rows = ids.join(history, "finding_id").join(
        findings.select(F.col("id").alias("version_id"), "superseded_by", "data_class", "statement"), "version_id"
    )
    return rows.filter(F.col("superseded_by").isNull() & scopes.allowed(F.col("data_class"), classes))


# --- rollups -----------------------------------------------------------------------------------------------------------


def corpus_stats(nodes: DataFrame) -> DataFrame:
    """Documents, chunks, claims, other entities and documents with extracted facts, in one pass."""
    kind = F.col("type")
    extracted = F.coalesce(F.try_element_at("metadata", F.lit("semantic_extracted")) == "true", F.lit(False))
    return nodes.agg(
        F.count_if(kind == "publication").alias("documents"), F.count_if(kind == "chunk").alias("chunks"),
        F.count_if(kind == "claim").alias("claims"),
        F.count_if(~kind.isin("publication", "chunk", "claim")).alias("entities"),
        F.count_if((kind == "publication") & extracted).alias("semantic_documents"),
    )


def document_count(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("evidence.document_id").alias("d")).agg(F.countDistinct("d").alias("documents"))


def subject_index(findings: DataFrame) -> DataFrame:
    """Findings per subject with status counts, by name; the blank subject is last."""
    subject = F.coalesce("subject", F.lit(""))
    status = F.col("status")
    return findings.groupBy(subject.alias("subject")).agg(
        F.count("*").alias("findings"),
        *[F.count_if(status == s).alias(s) for s in ("consensus", "disputed", "hypothesis")],
    ).orderBy(F.col("subject") == "", "subject")


def dashboard(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: graph counts, evidence, conflicts and coverage gaps of one snapshot."""
    from .conflicts import gap_summary, to_claims

    gaps = gap_summary(to_claims(findings.withColumn("pool", F.lit("all")), carry=("pool",)), ["pool"])
    # A corpus without comparable numbers has no gap row at all.
    counted = gaps.agg(F.coalesce(F.max("shown"), F.lit(0)).alias("gaps"), F.coalesce(F.max("omitted"), F.lit(0)).alias("gaps_omitted"))
    found = findings.agg(
        F.count("*").alias("findings"), F.sum(F.size("evidence")).alias("evidence"),
        F.count_if(F.col("status") == "disputed").alias("conflicts"),
    )
    return corpus_stats(nodes).select(
        "documents", "claims", "entities", one_row(found).alias("f"), one_row(counted).alias("g")
    ).select("documents", "claims", "entities", "f.*", "g.*")


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value: a scalar subquery, not a join."""
    return df.select(F.struct(*df.columns)).scalar()
