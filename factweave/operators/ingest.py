"""Corpus intake: chunks, facts, graph rows, alias resolution, parts, markup pages."""

from __future__ import annotations

import json
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import fact_uuid

WINDOW, STRIDE, MIN_CHARS = 4000, 3700, 40
PART_LIMIT, PART_MINIMUM = 32_000, 20
FACTS_PER_DOCUMENT = 25


def dedup_documents(documents: DataFrame, order: str = "path") -> DataFrame:
    """SHA-256 of the text; the first document in order is created, later ones with the same text are duplicates.

    The window sees hashes and keys only, never texts.
    """
    keyed = documents.withColumn("sha", F.sha2("text", 256))
    first = keyed.groupBy("sha").agg(F.min(order).alias("_first"))
    return keyed.join(first, "sha").withColumn(
        "status", F.when(F.col(order) == F.col("_first"), "created").otherwise("duplicate")
    ).drop("_first")


def document_scope(documents: DataFrame) -> DataFrame:
    """Year and territory of a document, only when documented."""
    place = F.trim("geography")
    scope = F.map_filter(
        F.create_map(F.lit("year"), F.col("year").cast("string"), F.lit("geography"), F.when(place != "", place)),
        lambda _, v: v.isNotNull(),
    )
    return documents.withColumn("scope", scope)


def quote_start(text: Column, quote: Column) -> Column:
    """Offset of a quote: exact, else ignoring case, else null."""
    needle = F.trim(quote)
    exact = F.instr(text, needle)
    loose = F.instr(F.lower(text), F.lower(needle))
    return F.when((needle != "") & (exact > 0), exact - 1).when((needle != "") & (loose > 0), loose - 1)


def chunk_documents(documents: DataFrame, window: int = WINDOW, stride: int = STRIDE, minimum: int = MIN_CHARS) -> DataFrame:
    """Windows over the stripped fragments; offsets come from an exact search of the part in the fragment."""
    c = F.col
    fragments = documents.select(
        "document_id", "title", "data_class", "geography", "year", F.posexplode("fragments").alias("fragment_index", "f")
    ).withColumn("body", F.regexp_replace("f.text", r"(?U)^\s+|\s+$", ""))
    offsets = fragments.filter(F.length("body") > 0).withColumn(
        "offset", F.explode(F.sequence(F.lit(0), F.length("body") - 1, F.lit(stride)))
    )
    parts = offsets.withColumn(
        "text", F.regexp_replace(F.substr("body", c("offset") + 1, F.lit(window)), r"(?U)^\s+|\s+$", "")
    ).filter(F.length("text") >= minimum)
    key = F.concat_ws(":", "document_id", "fragment_index", "offset", F.substring("text", 1, 80))
    start = quote_start(c("f.text"), c("text"))
    return parts.select(
        F.concat(F.lit("chunk-"), fact_uuid(key)).alias("id"), "document_id", "title", "data_class", "geography", "year",
        "fragment_index", "offset", "text", c("f.page").alias("page"), c("f.sheet").alias("sheet"),
        c("f.cell_range").alias("cell_range"), start.alias("char_start"), (start + F.length("text")).alias("char_end"),
    )


def empty_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a single chunk: an error row each, not a created document."""
    return documents.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select(
        "document_id", F.lit("no_chunks").alias("error")
    )


def chunks_to_findings(chunks: DataFrame) -> DataFrame:
    c = F.col
    null = F.lit(None).cast("string")
    evidence = F.array(F.struct(
        "document_id", c("title").alias("source_title"), null.alias("source_url"), null.alias("retrieved_at"), "page", "sheet",
        "cell_range", "char_start", "char_end", c("text").alias("quote"),
    ))
    return document_scope(chunks).select(
        "id", c("text").alias("statement"), F.lit(0.7).alias("confidence"), evidence.alias("evidence"),
        F.lit("hypothesis").alias("status"), "scope", "data_class",
    )


def chunks_to_graph(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): publication and chunk nodes with their locators, HAS_CHUNK edges."""
    c = F.col
    doc_node = F.concat(F.lit("document-"), c("document_id"))
    keep = lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))
    publications = document_scope(documents).select(
        doc_node.alias("id"), c("title").alias("label"), F.lit("publication").alias("type"), F.lit(1.0).alias("confidence"),
        "data_class", c("scope").alias("metadata"),
    )
    locator = F.create_map(
        F.lit("page"), c("page").cast("string"), F.lit("sheet"), c("sheet"), F.lit("cell_range"), c("cell_range"),
        F.lit("char_start"), c("char_start").cast("string"), F.lit("char_end"), c("char_end").cast("string"),
    )
    pieces = chunks.select(
        "id", F.substring("text", 1, 160).alias("label"), F.lit("chunk").alias("type"), F.lit(1.0).alias("confidence"),
        "data_class", keep(locator).alias("metadata"),
    )
    edges = chunks.select(
        F.concat(doc_node, F.lit("-has-"), c("id")).alias("id"), doc_node.alias("source"), c("id").alias("target"),
        F.lit("HAS_CHUNK").alias("relation"), F.lit(1.0).alias("confidence"), "data_class",
    )
    return publications.unionByName(pieces), edges


# --- parts and samples -------------------------------------------------------------------------------------------------


_PLACES = "array<struct<piece:int,start:int,length:int,part:int>>"


def _pack(sizes: list[int], limit: int, minimum: int) -> list[tuple[int, int, int, int]]:
    """Places (piece, start, length, part) of pieces packed in order; the last part is filled up to ``minimum``."""
    parts: list[list[list[int]]] = []
    room = -1
    for i, n in enumerate(sizes):
        if parts and n + 2 <= room:
            parts[-1].append([i, 0, n])
            room -= n + 2
        else:
            parts.append([[i, 0, n]])
            room = limit - n
    total = lambda part: sum(p[2] for p in part) + 2 * max(len(part) - 1, 0)
    while len(parts) > 1 and total(parts[-1]) < minimum:
        donor, short = parts[-2], parts[-1]
        piece, start, n = donor[-1]
        need = minimum - total(short)
        whole = n <= need and total(donor[:-1]) >= minimum
        take = n if whole else min(need, n)
        short.insert(0, [piece, start + n - take, take])
        if whole:
            donor.pop()
        else:
            donor[-1][2] = n - take
        if total(donor) < minimum:
            break
    return [(i, start, n, k) for k, part in enumerate(parts) for i, start, n in part]


def semantic_parts(documents: DataFrame, limit: int = PART_LIMIT, minimum: int = PART_MINIMUM) -> DataFrame:
    """Fragments cut at ``limit`` characters and packed in order into parts of at most ``limit`` characters.

    Two characters count between pieces; a last part under ``minimum`` characters takes from the part before it. Only the
    lengths of the pieces go through Python; texts stay in the JVM.
    """
    c = F.col
    cut = lambda f: F.transform(
        F.sequence(F.lit(0), F.length(f["text"]) - 1, F.lit(limit)),
        lambda o: F.struct(
            F.substr(f["text"], o + 1, F.lit(limit)).alias("text"), f["page"].alias("page"),
            (f["source_char_start"] + o).alias("start"),
        ),
    )
    pieces = F.flatten(F.transform(F.filter("fragments", lambda f: F.length(f["text"]) > 0), cut))

    @F.pandas_udf(_PLACES)
    def places(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda row: [
            dict(zip(("piece", "start", "length", "part"), p, strict=True)) for p in _pack([int(n) for n in row], limit, minimum)
        ])

    # Marked as non-deterministic so that the optimizer evaluates it once instead of copying it into filters.
    places = places.asNondeterministic()
    cut_up = documents.select("document_id", pieces.alias("pieces")).filter(F.size("pieces") > 0)
    packed = cut_up.withColumn("places", places(F.transform("pieces", lambda p: F.length(p["text"]))))
    placed = packed.select("document_id", "pieces", F.posexplode("places").alias("pos", "x"))
    piece = F.element_at("pieces", c("x.piece") + 1)
    return placed.select(
        "document_id", "pos", c("x.part").alias("part"), F.substr(piece["text"], c("x.start") + 1, c("x.length")).alias("text"),
        piece["page"].alias("page"), (piece["start"] + c("x.start")).alias("start"),
    ).filter(F.length("text") > 0)


def sample_fragments(documents: DataFrame, k: int = 8) -> DataFrame:
    """Evenly spread fragments: positions round(i * (n-1) / (k-1)), repeats removed; k < 2 takes the first."""
    n = F.size("fragments")
    if k < 2:
        spots = F.array(F.lit(0))
    else:
        spots = F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / float(k - 1)).cast("int")
        ))
    few = F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(spots)
    return documents.filter(n > 0).select("document_id", "fragments", F.explode(few).alias("position")).select(
        "document_id", "position", F.element_at("fragments", F.col("position") + 1)["text"].alias("text")
    )


def pending_parts(parts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parts not yet in the ledger; a document whose ledger names another total is an error."""
    totals = ledger.groupBy("document_id").agg(
        F.max("total").alias("ledger_total"), F.countDistinct("part").alias("done")
    )
    here = parts.join(totals, "document_id", "left").join(
        ledger.select("document_id", "part", F.lit(True).alias("_done")), ["document_id", "part"], "left"
    )
    state = (
        F.when(F.col("ledger_total") != F.col("total"), "total_changed")
        .when(F.col("_done"), "done").otherwise("pending")
    )
    return here.withColumn("state", state).withColumn("complete", F.coalesce(F.col("done") >= F.col("total"), F.lit(False))).drop("_done")


def corpus_report(files: DataFrame) -> DataFrame:
    """Counts of a compile run over a per-file status column; coverage is processed over selected."""
    s = F.col("status")
    processed = F.count_if(s.isin("created", "duplicate"))
    selected = F.count_if(~s.isin("unsupported", "oversize"))
    return files.agg(
        F.count("*").alias("discovered"), selected.alias("eligible"), processed.alias("processed"),
        F.count_if(s == "created").alias("created"), F.count_if(s == "duplicate").alias("duplicates"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "unsupported").alias("skipped_unsupported"),
        F.count_if(s == "oversize").alias("skipped_oversize"), F.count_if(s == "no_text_layer").alias("text_layer_backlog"),
        F.round(processed / F.greatest(selected, F.lit(1)), 4).alias("coverage"),
    )


def preload_report(parts: DataFrame) -> DataFrame:
    """Per document: parts created, duplicate and failed, where oversize and missing text layers are no failures."""
    s = F.col("status")
    return parts.groupBy("document_id").agg(
        F.count("*").alias("parts"), F.count_if(s == "created").alias("created"), F.count_if(s == "duplicate").alias("duplicates"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("oversize", "no_text_layer")).alias("deferred"),
    )


# --- facts -------------------------------------------------------------------------------------------------------------


def extract_findings(
    documents: DataFrame, keywords=X.TECH_KEYWORDS, subjects=X.SUBJECT_KEYWORDS, default_subject: str = X.DEFAULT_SUBJECT,
    per_document: int = FACTS_PER_DOCUMENT,
) -> DataFrame:
    """Rule-based facts: sentences of 30 to 500 characters with two keywords, at most 25 per document by confidence."""
    c = F.col
    fragments = documents.select("document_id", "title", F.posexplode("fragments").alias("fragment_index", "f"))
    sentences = fragments.select(
        "document_id", "title", "fragment_index", c("f.page").alias("page"), c("f.text").alias("fragment"),
        F.posexplode(X.split_sentences(c("f.text"))).alias("sentence_index", "statement"),
    ).filter(F.length("statement").between(30, 500))
    hits = sentences.withColumn("hits", X.keyword_count(c("statement"), keywords)).filter(c("hits") >= 2)
    # Points of confidence in hundredths, so that sums are exact.
    points = (
        F.lit(50) + F.when(c("statement").rlike(r"\d+[,.\s]?\d*"), 10).otherwise(0)
        + F.when(c("statement").contains("%"), 5).otherwise(0) + F.when(c("statement").rlike(r"[A-Z][a-z]?\d?"), 5).otherwise(0)
        + F.least(c("hits") * 2, F.lit(15))
    )
    scored = hits.withColumn("confidence", F.least(points, F.lit(95)) / 100.0)
    w = Window.partitionBy("document_id").orderBy("fragment_index", "sentence_index")
    best = Window.partitionBy("document_id").orderBy(F.desc("confidence"), "fragment_index", "sentence_index")
    numbered = scored.withColumns({"number": F.row_number().over(w) - 1, "_rank": F.row_number().over(best)})
    quote = F.when(F.length("fragment") >= 20, F.substring("fragment", 1, 500)).otherwise(c("statement"))
    return numbered.filter(c("_rank") <= per_document).select(
        F.concat(F.lit("finding-"), c("title"), F.lit("-"), F.lpad(c("number").cast("string"), 4, "0")).alias("id"),
        "document_id", "title", "page", "statement", "confidence", quote.alias("quote"),
        X.first_subject(c("statement"), subjects, default_subject).alias("subject"), F.lit("DESCRIBES").alias("predicate"),
    )


def supported_claims(claims: DataFrame, documents: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims whose quote stands in the document's text or a fragment, and the entities those claims use."""
    c = F.col
    # Texts and quotes are lower-cased once each, not once per claim.
    texts = documents.select(
        "document_id", "text", F.lower("text").alias("_low"), F.transform("fragments", lambda f: f["text"]).alias("_texts"),
        F.transform("fragments", lambda f: F.lower(f["text"])).alias("_lows"),
    )
    quoted = claims.withColumn("_needle", F.trim("evidence_quote")).withColumn("_loose", F.lower("_needle"))
    whole = c("text").contains(c("_needle")) | c("_low").contains(c("_loose"))
    part = F.exists("_texts", lambda t: t.contains(c("_needle"))) | F.exists("_lows", lambda t: t.contains(c("_loose")))
    kept = quoted.join(texts, "document_id").filter((c("_needle") != "") & (whole | part)).select(*claims.columns)
    dropped = claims.select("document_id").exceptAll(kept.select("document_id")).distinct().withColumn("_cut", F.lit(True))
    terms = kept.select("document_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("term")).distinct()
    named = entities.withColumn("_row", F.monotonically_increasing_id()).select(
        "*", F.explode(F.array_distinct(F.transform(
            F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower
        ))).alias("term")
    )
    used = named.join(terms, ["document_id", "term"], "left_semi").select(*entities.columns).dropDuplicates(["document_id", "name", "canonical_name"])
    whole = entities.join(dropped, "document_id", "left_anti")
    return kept, used.join(dropped, "document_id", "left_semi").unionByName(whole)


def locate_evidence(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Fragment and offsets of each claim's quote: exact, else ignoring case, else the first fragment without offsets.

    A claim meets its document's fragments as one list, so no row per claim and fragment is formed, sorted or spilled.
    """
    c = F.col
    listed = documents.filter(F.size("fragments") > 0).select(
        "document_id", "title", "fragments", F.transform("fragments", lambda f: F.lower(f["text"])).alias("_low")
    )
    quoted = claims.select("document_id", "pos", c("evidence_quote").alias("quote"), F.lower("evidence_quote").alias("_loose"))
    first = lambda texts, test: F.array_position(F.transform(texts, test), F.lit(True))
    joined = quoted.join(listed, "document_id", "left").withColumn(
        "_exact", F.when(c("quote") != "", first("fragments", lambda f: f["text"].contains(c("quote"))))
    ).withColumn("_near", F.when(c("_exact") == 0, first("_low", lambda t: t.contains(c("_loose")))))
    placed = joined.select(
        "document_id", "pos", "title", "quote", "fragments", F.when(c("_exact") > 0, 0).when(c("_near") > 0, 1).otherwise(2).alias("level"),
        (F.when(c("_exact") > 0, c("_exact")).when(c("_near") > 0, c("_near")).otherwise(1) - 1).cast("int").alias("fpos"),
    ).select("document_id", "pos", "title", "quote", "level", "fpos", F.get("fragments", c("fpos")).alias("f"))
    best = placed.groupBy("document_id", "pos").agg(F.min_by(F.struct("title", "f", "level", "quote"), F.struct("level", "fpos")).alias("b"))
    start = F.when(c("b.level") < 2, quote_start(c("b.f.text"), c("b.quote")))
    return best.select(
        "document_id", "pos", c("b.title").alias("source_title"),
        F.when(c("b.f").isNull(), 1).otherwise(c("b.f.page")).alias("page"), c("b.f.sheet").alias("sheet"),
        c("b.f.cell_range").alias("cell_range"), (c("b.f.source_char_start") + start).alias("char_start"),
        (c("b.f.source_char_start") + start + F.length(F.trim("b.quote"))).alias("char_end"),
        F.when(c("b.quote") != "", c("b.quote")).otherwise(c("b.title")).alias("quote"),
    )


def resolve_aliases(
    entities: DataFrame, claims: DataFrame, resolutions: DataFrame, accepted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Canonical names of entities and of claim ends.

    An accepted merge (alias, canonical) wins over a proposed one with confidence >= 0.7; a claim end also follows the
    names and aliases of the document's entities. Names compare in lower case.
    """
    c = F.col
    proposed = resolutions.filter(c("confidence") >= 0.7).groupBy("document_id", F.lower("mention").alias("key")).agg(
        F.max("canonical_name").alias("proposed")
    )
    approved = accepted.groupBy(F.lower("alias").alias("key")).agg(F.max("canonical").alias("approved"))
    named = entities.withColumn("key", F.lower("name")).join(proposed, ["document_id", "key"], "left").join(approved, "key", "left")
    out = named.withColumn("canonical_name", F.coalesce("approved", "proposed", "canonical_name")).select(*entities.columns)
    own = out.select(
        "document_id", "canonical_name", F.explode(F.transform(
            F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower
        )).alias("key")
    ).groupBy("document_id", "key").agg(F.max("canonical_name").alias("own"))
    resolved = claims
    for end in ("subject", "object"):
        resolved = (
            resolved.withColumn("key", F.lower(end))
            .join(proposed, ["document_id", "key"], "left").join(approved, "key", "left").join(own, ["document_id", "key"], "left")
            .withColumn(end, F.coalesce("approved", "proposed", "own", end)).drop("key", "proposed", "approved", "own")
        )
    return out, resolved.select(*claims.columns)


def complete_endpoints(claims: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities for claim ends no entity names: material when the relation allows it, else the smallest allowed type.

    The first claim that needs a name decides its type.
    """
    c = F.col
    known = entities.select("document_id", F.explode(F.transform(
        F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower
    )).alias("key")).distinct()
    rel = F.broadcast(relations.select(c("name").alias("predicate"), "source_types", "target_types"))
    ends = claims.join(rel, "predicate").select(
        "document_id", "pos", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), c("subject").alias("term"), c("source_types").alias("types")),
            F.struct(F.lit(1).alias("side"), c("object").alias("term"), c("target_types").alias("types")),
        )).alias("e")
    ).withColumn("key", F.lower("e.term"))
    kind = F.when((F.size("e.types") == 0) | F.array_contains("e.types", "material"), "material").otherwise(F.array_min("e.types"))
    missing = ends.join(known, ["document_id", "key"], "left_anti")
    first = missing.groupBy("document_id", "key").agg(
        F.min_by(F.struct(c("e.term").alias("name"), kind.alias("type")), F.struct("pos", "e.side")).alias("x")
    )
    return first.select(
        "document_id", c("x.name").alias("name"), c("x.name").alias("canonical_name"), c("x.type").alias("type"),
        F.array().cast("array<string>").alias("aliases"),
    )


def claims_to_graph(
    documents: DataFrame, entities: DataFrame, claims: DataFrame, part: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings) of extracted claims; an id occurs once, its first occurrence wins."""
    c = F.col
    doc = documents.select("document_id", "title", "data_class", "geography", "year")
    doc_node = F.concat(F.lit("document-"), c("document_id"))
    entity_id = lambda name: F.concat(F.lit("entity-"), fact_uuid(F.lower(name)))
    names = entities.select(
        "document_id", entity_id(c("canonical_name")).alias("entity_id"),
        F.explode(F.array(F.lower("name"), F.lower("canonical_name"))).alias("key"),
    ).groupBy("document_id", "key").agg(F.max("entity_id").alias("entity_id"))
    key = (
        F.concat_ws(":", "document_id", part, c("pos").cast("string")) if part is not None
        else F.concat_ws(":", "document_id", c("pos").cast("string"), "statement")
    )
    rows = claims.join(doc, "document_id").withColumn("claim_id", F.concat(F.lit("claim-"), fact_uuid(key)))
    for end in ("subject", "object"):
        known = names.withColumnRenamed("entity_id", f"{end}_known")
        rows = rows.withColumn("key", F.lower(end)).join(known, ["document_id", "key"], "left").drop("key")
        rows = rows.withColumn(f"{end}_id", F.coalesce(f"{end}_known", entity_id(c(end))))
    no_meta = F.create_map().cast("map<string,string>")
    publications = document_scope(doc).select(
        doc_node.alias("id"), c("title").alias("label"), F.lit("publication").alias("type"), F.lit(1.0).alias("confidence"),
        "data_class", c("scope").alias("metadata"), F.lit(0).alias("_order"), F.lit(0).alias("_pos"),
    )
    entity_nodes = entities.join(doc, "document_id").select(
        entity_id(c("canonical_name")).alias("id"), c("canonical_name").alias("label"), "type", F.lit(1.0).alias("confidence"),
        "data_class", F.create_map(F.lit("aliases"), F.array_join("aliases", ", ")).alias("metadata"), F.lit(1).alias("_order"),
        F.lit(0).alias("_pos"),
    )
    ends = rows.select("data_class", "pos", F.explode(F.array(
        F.struct(c("subject_id").alias("id"), c("subject").alias("label"), c("subject_known").isNull().alias("new")),
        F.struct(c("object_id").alias("id"), c("object").alias("label"), c("object_known").isNull().alias("new")),
    )).alias("e")).filter("e.new").select(
        "e.id", "e.label", F.lit("material").alias("type"), F.lit(1.0).alias("confidence"), "data_class", no_meta.alias("metadata"),
        F.lit(2).alias("_order"), c("pos").alias("_pos"),
    )
    claim_nodes = rows.select(
        c("claim_id").alias("id"), c("statement").alias("label"), F.lit("claim").alias("type"), "confidence", "data_class",
        F.map_filter(F.create_map(
            F.lit("knowledge_status"), F.lit("extracted"), F.lit("subject"), c("subject"), F.lit("predicate"), c("predicate"),
            F.lit("object"), c("object"), F.lit("fact_kind"), c("fact_kind"), F.lit("context"), c("context"),
            F.lit("observations"), F.to_json("observations"),
        ), lambda _, v: v.isNotNull()).alias("metadata"), F.lit(3).alias("_order"), c("pos").alias("_pos"),
    )
    every = publications.unionByName(entity_nodes).unionByName(ends).unionByName(claim_nodes)
    body = ["label", "type", "confidence", "data_class", "metadata"]
    nodes = every.groupBy("id").agg(F.min_by(F.struct(*body), F.struct("_order", "_pos", "label", "type")).alias("n")).select("id", "n.*")
    edge = lambda suffix, source, target, relation: F.struct(
        F.concat(c("claim_id"), F.lit(suffix)).alias("id"), source.alias("source"), target.alias("target"),
        relation.alias("relation"),
    )
    edges = rows.select("confidence", "data_class", F.explode(F.array(
        edge("-asserts", c("subject_id"), c("claim_id"), F.lit("ASSERTS")),
        edge("-evidence", c("claim_id"), doc_node, F.lit("SUPPORTED_BY")),
        edge("-object", c("claim_id"), c("object_id"), c("predicate")),
    )).alias("e")).select("e.*", "confidence", "data_class")
    located = locate_evidence(claims, documents).withColumn("_e", F.struct(
        "document_id", "source_title", F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("retrieved_at"),
        "page", "sheet", "cell_range", "char_start", "char_end", "quote",
    )).select("document_id", "pos", F.array("_e").alias("evidence"))
    findings = document_scope(rows).join(located, ["document_id", "pos"]).select(
        F.concat(F.lit("finding-"), c("claim_id")).alias("id"), "statement", "confidence", "evidence",
        F.lit("hypothesis").alias("status"), "observations", "subject", "predicate", "object", "fact_kind", "context", "scope",
        "data_class",
    )
    return nodes, edges, findings


def repair_chunk_evidence(findings: DataFrame) -> DataFrame:
    """Active chunk rows with one locator whose quote begins the text: the quote becomes the text, the end follows it.

    ``outcome`` is updated, unchanged or skipped.
    """
    c = F.col
    first = F.element_at("evidence", 1)
    fits = (
        c("superseded_by").isNull() & c("id").startswith("chunk-") & (F.size("evidence") == 1)
        & c("statement").startswith(first["quote"])
    )
    end = first["char_start"] + F.length("statement")
    stale = (first["quote"] != c("statement")) | ~first["char_end"].eqNullSafe(end)
    outcome = F.when(F.coalesce(fits, F.lit(False)), F.when(stale, "updated").otherwise("unchanged")).otherwise("skipped")
    repaired = F.transform("evidence", lambda e: e.withField("quote", c("statement")).withField(
        "char_end", e["char_start"] + F.length("statement")
    ))
    return findings.withColumn("outcome", outcome).withColumn(
        "evidence", F.when(c("outcome") == "updated", repaired).otherwise(c("evidence"))
    )


# --- pages -------------------------------------------------------------------------------------------------------------

# One token of a page: a script or style element, a comment, a tag, a character reference, or text.
_TOKEN = (
    r"(?is)(<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[!?/]?[a-z][^>]*>|"
    r"<[!?/]?[a-z][^>]*$|&#?[a-z0-9]+;?|[^<&]+|[<&])"
)


def plain_markup(col: Column) -> Column:
    """Text of a page: text nodes joined by blanks, character references resolved, blanks collapsed.

    Script and style text is text, as for an HTML parser; a tag cut off at the end is none. A last text with an unfinished
    reference is left out: more input could follow it.
    """
    whole = F.regexp_replace(col, r"(?s)>[^<]*&[^\s;<]{0,33}$", ">")
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    point = lambda t: F.when(
        t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "([0-9a-fA-F]+);?$", 1), 16, 10)
    ).otherwise(F.regexp_extract(t, "([0-9]+);?$", 1)).try_cast("int")
    char = lambda t: F.decode(F.unhex(F.lpad(F.hex(point(t)), 8, "0")), "UTF-32")
    one = lambda t: (
        F.when(t.rlike(r"(?is)^<(script|style)\b.*>$"), F.concat(
            F.lit(" "), F.regexp_replace(t, r"(?is)^<(?:script|style)\b[^>]*>|</(?:script|style)\s*>$", ""), F.lit(" ")
        ))
        .when(t.rlike(r"(?is)^<([!?/]?[a-z]|!--)"), F.lit(" "))
        .when(t.rlike("^&#[xX]?[0-9a-fA-F]+;?$"), F.coalesce(char(t), t))
        .when(t.startswith("&"), F.coalesce(F.try_element_at(names, F.substr(t, F.lit(2))), t))
        .otherwise(t)
    )
    tokens = F.regexp_extract_all(whole, F.lit(_TOKEN), F.lit(1))
    return X.squeeze(F.array_join(F.transform(tokens, one), ""))


def pages_to_findings(pages: DataFrame, quote_limit: int = 6000, statement_limit: int = 500) -> DataFrame:
    """Public findings of markup pages; pages without text are dropped."""
    c = F.col
    plain = pages.withColumn("plain", plain_markup(c("html"))).filter(c("plain") != "")
    title = X.squeeze(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return plain.select(
        F.concat(F.lit("public-"), fact_uuid(c("url"))).alias("id"), X.excerpt(c("plain"), statement_limit).alias("statement"),
        X.excerpt(c("plain"), quote_limit).alias("quote"), F.when(title != "", title).otherwise(c("url")).alias("source_title"),
        "url", F.lit(0.5).alias("confidence"), F.lit("public").alias("data_class"), F.lit("hypothesis").alias("status"),
    ).filter((c("statement") != "") & (c("quote") != ""))


# --- vectors -----------------------------------------------------------------------------------------------------------


def vector_coverage(ids: DataFrame, vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(usable vectors, one-row report): vectors of a wrong dimension are removed and counted."""
    size = F.size("embedding")
    report = ids.join(vectors.select("id", "embedding"), "id", "left").agg(
        F.count_if(F.col("embedding").isNotNull() & (size == dim)).alias("indexed"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.count_if(F.col("embedding").isNotNull() & (size != dim)).alias("wrong_dimension"),
    )
    return vectors.filter(size == dim), report


def embedding_backlog(texts: DataFrame, cache: DataFrame, model: str, batch: int = 8) -> DataFrame:
    """Distinct hashes of whole texts without a cached vector, numbered in batches of ``batch`` in hash order.

    The first four hex digits make 65 536 even ranges whatever the data; a number is the rank inside the range plus the
    sizes of the ranges before, so no task sees all rows.
    """
    keyed = texts.select(F.sha2("text", 256).alias("sha")).distinct()
    open_rows = keyed.join(cache.filter(F.col("model") == model).select("sha"), "sha", "left_anti")
    ranged = open_rows.withColumn("_r", F.substring("sha", 1, 4))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ))
    w = Window.partitionBy("_r").orderBy("sha")
    return ranged.withColumn("_i", F.row_number().over(w) - 1).join(F.broadcast(before.drop("_n")), "_r").select(
        "sha", F.lit(model).alias("model"), F.floor((F.col("_i") + F.col("_before")) / batch).alias("batch")
    )
