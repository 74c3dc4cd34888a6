"""Graph operators over node and edge tables: degrees, anchors, traversal, components, communities and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as scopes
from ..functions.ids import MERGE_NAMESPACE, uuid5
from . import catalog
from .lineage import checkpoint, written
from .search import token_hits

NODE_LIMIT, EDGE_LIMIT = 600, 3000
MAX_ANCHORS, MAX_VISITED, MAX_SUBGRAPH_EDGES = 5, 200, 2000
MIN_COMMUNITY = 15
PROFILE_LIMIT, SUMMARY_LIMIT = 4, 520

# Community names that come from no member, and printed node types.
FALLBACK_COMMUNITY = "База знаний"
SMALL_COMMUNITY = "Прочие сущности"
UNNAMED_COMMUNITY = "Сообщество"
TYPE_NAMES = {
    "material": "Материалы", "process": "Технологические процессы", "equipment": "Оборудование", "condition": "Условия процесса",
    "claim": "Утверждения", "expert": "Эксперты", "publication": "Публикации", "chunk": "Фрагменты", "location": "Локации",
    "organization": "Организации", "experiment": "Эксперименты",
}
LAYERS = {"publication": "source", "chunk": "source", "claim": "claim"}


def node_layer(col: Column) -> Column:
    """Map layer of a node type: source, claim, or entity for all others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LAYERS.items() for x in p]), col), F.lit("entity"))


# --- adjacency ---------------------------------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node, multi-edges counted."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(id, neighbour, edge_id, data_class) in both directions, limited to the named relations."""
    if relations:
        edges = edges.filter(F.upper("relation").isin(*[r.upper() for r in relations]))
    ways = F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour")),
    ))
    return edges.select(ways.alias("w"), F.col("id").alias("edge_id"), "data_class").select("w.id", "w.neighbour", "edge_id", "data_class")


def edges_within(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with both ends among the nodes (of the same ``by`` group)."""
    by = by or []
    ids = nodes.select(*by, "id").distinct()
    first = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi" if not by else "inner")
    return first.join(ids.withColumnRenamed("id", "target"), [*by, "target"], "left_semi")


def graph_backbone(nodes: DataFrame, edges: DataFrame, n: int = NODE_LIMIT, m: int = EDGE_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): the best connected nodes without chunks and the edges among them."""
    c = F.col
    real = nodes.filter(c("type") != "chunk")
    ids = real.select("id")
    links = edges.filter(c("relation") != "HAS_CHUNK")
    links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    top = real.join(degrees(links), "id", "left").fillna(0, ["degree"]).orderBy(
        F.desc("degree"), F.coalesce("label", "id"), "id"
    ).limit(n)
    shown_edges = edges_within(links, top).orderBy("id", "source", "target").limit(m)
    connected = shown_edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_linked", F.lit(True))
    kept = top.join(connected, "id", "left").filter(
        c("_linked") | F.coalesce(F.try_element_at("metadata", F.lit("domain")) != "", F.lit(False)) | c("id").startswith("dom-")
    ).drop("_linked")
    report = real.agg(F.count("*").alias("nodes_total")).select(
        kept.agg(F.count("*")).scalar().alias("nodes_shown"), "nodes_total",
        shown_edges.agg(F.count("*")).scalar().alias("edges_shown"), links.agg(F.count("*")).scalar().alias("edges_total"),
    )
    return kept, shown_edges, report


def ego(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per centre: itself with its neighbours, and its edges."""
    centre = ids.select(F.col("id").alias("centre"))
    near = adjacency(edges).join(centre, F.col("id") == F.col("centre")).select("centre", "neighbour", "edge_id")
    members = near.select("centre", F.col("neighbour").alias("id")).unionByName(centre.select("centre", F.col("centre").alias("id"))).distinct()
    return members.join(nodes, "id"), near.select("centre", F.col("edge_id").alias("id")).distinct().join(edges, "id")


def connections(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of each node with direction and the other end."""
    c = F.col
    centre = ids.select(c("id").alias("node_id"))
    out = edges.join(centre, c("source") == c("node_id")).select("node_id", c("id").alias("edge_id"), "relation", F.lit("out").alias("direction"), c("target").alias("other_id"))
    into = edges.join(centre, c("target") == c("node_id")).select("node_id", c("id").alias("edge_id"), "relation", F.lit("in").alias("direction"), c("source").alias("other_id"))
    return out.unionByName(into).join(nodes.select(c("id").alias("other_id"), c("label").alias("other_label")), "other_id")


def search_nodes(nodes: DataFrame, text: str, area: str | None = None) -> DataFrame:
    """Nodes whose label or printed type holds the text; ``in_area`` marks those of the area."""
    needle = text.strip().lower()
    kinds = F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p])
    kind = F.lower(F.coalesce(F.try_element_at(kinds, F.col("type")), F.col("type")))
    found = nodes.filter(F.lower("label").contains(needle) | kind.contains(needle))
    inside = F.coalesce(F.col("community") == area, F.lit(False)) if area is not None else F.lit(True)
    return found.withColumn("in_area", inside)


def area_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community: records, claims, sources, entities and the edges inside it."""
    c = F.col
    layer = node_layer(c("type"))
    rows = nodes.groupBy("community").agg(
        F.count("*").alias("records"), F.count_if(layer == "claim").alias("claims"), F.count_if(layer == "source").alias("sources"),
        F.count_if(layer == "entity").alias("entities"),
    )
    member = nodes.select("id", "community")
    inner = (
        edges.join(member.select(c("id").alias("source"), c("community").alias("_a")), "source")
        .join(member.select(c("id").alias("target"), c("community").alias("_b")), "target")
        .filter(c("_a") == c("_b")).groupBy(c("_a").alias("community")).agg(F.count("*").alias("links"))
    )
    return rows.join(inner, "community", "left").fillna(0, ["links"]).orderBy(F.desc("claims"), F.desc("records"), "community")


# --- findings and nodes ------------------------------------------------------------------------------------------------


def finding_communities(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Community of the node named like the finding without its prefix, else of the node with the finding's own id."""
    c = F.col
    member = nodes.filter(c("community") != "").select("id", "community")
    bare = F.regexp_replace("id", "^finding-", "")
    keyed = findings.select(c("id").alias("finding_id"), F.explode(F.array_distinct(F.array(bare, c("id")))).alias("id"), bare.alias("_bare"))
    hit = keyed.join(member, "id")
    return hit.groupBy("finding_id").agg(F.min_by("community", (c("id") != c("_bare")).cast("int")).alias("community"))


def finding_nodes(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """First existing node among the finding's id, its bare id and ``claim-`` plus the bare id."""
    c = F.col
    bare = F.regexp_replace("id", "^finding-", "")
    keyed = findings.select(
        c("id").alias("finding_id"), F.posexplode(F.array(c("id"), bare, F.concat(F.lit("claim-"), bare))).alias("level", "id")
    )
    return keyed.join(nodes.select("id"), "id").groupBy("finding_id").agg(F.min_by("id", "level").alias("node_id"))


def node_findings(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of a node: named like it, or citing the document it stands for."""
    c = F.col
    bare = F.regexp_replace("id", "^finding-", "")
    own = findings.select(c("id").alias("finding_id"), "confidence", F.explode(F.array_distinct(F.array(c("id"), bare))).alias("id"))
    cited = findings.select(
        c("id").alias("finding_id"), "confidence", F.explode(F.array_distinct(F.transform("evidence", lambda e: F.concat(F.lit("document-"), e["document_id"])))).alias("id")
    )
    keys = nodes.select("id")
    return own.join(keys, "id").unionByName(cited.join(keys, "id")).select(c("id").alias("node_id"), "finding_id", "confidence").distinct()


# --- anchors and traversal ---------------------------------------------------------------------------------------------


def anchors(names: DataFrame, nodes: DataFrame, classes=None, k: int = MAX_ANCHORS) -> DataFrame:
    """Start nodes per question: exact labels first, then labels that hold a name or stand in one; chunks excluded.

    ``names``: (query_id, name). Substring matches use equality joins: a label that holds a name shares the name's first
    grams; a label inside a name is one of the name's substrings of a length some label has. ``matched`` counts both ways.
    """
    c = F.col
    live = catalog_visible(nodes.filter(c("type") != "chunk"), classes).select("id", "label", "data_class")
    order = [c("data_class"), c("label"), c("id")]
    wanted = names.filter(F.trim("name") != "").select("query_id", F.trim("name").alias("name")).distinct()
    exact = wanted.join(live, c("name") == c("label")).select("query_id", "id", "label", "data_class").distinct()
    low = wanted.select("query_id", F.lower("name").alias("name")).distinct()
    labels = live.select(F.lower("label").alias("low")).distinct().filter(c("low") != "")
    holds = labels_holding(low, labels)
    inside = labels_inside(low, labels)
    loose = holds.unionByName(inside).distinct().join(live.withColumn("low", F.lower("label")), "low").select("query_id", "id", "label", "data_class").distinct()
    counts = exact.groupBy("query_id").agg(F.count("*").alias("exact_matched"))
    picked = catalog.top_k(exact, ["query_id"], order, k, "rank").withColumn("level", F.lit(0))
    fill = catalog.top_k(loose, ["query_id"], order, k, "rank").join(counts, "query_id", "left").filter(
        c("rank") <= k - F.least(F.coalesce("exact_matched", F.lit(0)), F.lit(k))
    ).drop("exact_matched").withColumn("level", F.lit(1))
    total = exact.select("query_id").unionByName(loose.select("query_id")).groupBy("query_id").agg(F.count("*").alias("matched"))
    one = picked.unionByName(fill).groupBy("query_id", "id").agg(F.min("level").alias("level"))
    return one.join(total, "query_id")


def catalog_visible(df: DataFrame, classes) -> DataFrame:
    return df.filter(scopes.allowed(F.col("data_class"), classes))


def labels_holding(low: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, low) where the label holds the name."""
    c = F.col
    keyed = low.withColumn("gram", F.substring("name", 1, 4))
    wanted = keyed.select("gram").distinct()
    gram = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("low") - (n - 1), F.lit(1))), lambda i: F.substr(c("low"), i, F.lit(n))
    )
    grams = labels.select("low", F.explode(F.array_distinct(F.flatten(F.array(*[gram(n) for n in (1, 2, 3, 4)])))).alias("gram"))
    return grams.join(wanted, "gram", "left_semi").join(keyed, "gram").filter(c("low").contains(c("name"))).select("query_id", "low").distinct()


def labels_inside(low: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, low) where the label stands in the name."""
    c = F.col
    sizes = labels.agg(F.array_sort(F.collect_set(F.length("low")))).scalar()
    spots = low.select("query_id", "name", F.explode(sizes).alias("n")).filter(c("n") <= F.length("name"))
    parts = spots.select("query_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("name") - c("n") + 1), lambda i: F.substr("name", i, c("n"))
    ))).alias("low"))
    return parts.join(labels, "low").select("query_id", "low").distinct()


def neighbourhood(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None = None, classes=None,
    limit: int = MAX_VISITED,
) -> DataFrame:
    """(query_id, id, level): breadth-first visit from the starts, at most ``limit`` nodes per question.

    New nodes of a level enter in id order while there is room. Of a node's neighbours in id order those behind the first ``limit``
    never enter: before them stand more than are visited and have room together. So only a first page of every hub's neighbours is kept,
    and a level reads at most that page for each node of the frontier.
    """
    c = F.col
    depth = min(max(hops, 1), 4)
    seen = catalog_visible(nodes.filter(c("type") != "chunk"), classes).select(c("id").alias("neighbour"))
    ways = catalog_visible(adjacency(edges, relations), classes).select("id", "neighbour").distinct().join(seen, "neighbour", "left_semi")
    ways = written(catalog.top_k(ways, ["id"], [c("neighbour")], limit).select("id", "neighbour"))
    visited = checkpoint(starts.select("query_id", "id", F.lit(0).alias("level")).distinct())
    for level in range(1, depth + 1):
        frontier = visited.filter(c("level") == level - 1).select("query_id", "id")
        reached = frontier.join(ways, "id").select("query_id", c("neighbour").alias("id")).distinct()
        fresh = catalog.top_k(
            reached.join(visited.select("query_id", "id"), ["query_id", "id"], "left_anti"), ["query_id"], [c("id")], limit
        )
        room = visited.groupBy("query_id").agg((F.lit(limit) - F.count("*")).alias("room"))
        new = fresh.join(room, "query_id").filter(c("rank") <= c("room")).select("query_id", "id", F.lit(level).alias("level"))
        visited = checkpoint(visited.unionByName(new))
    return visited


def subgraph_edges(
    visited: DataFrame, edges: DataFrame, relations: list[str] | None = None, classes=None, limit: int = MAX_SUBGRAPH_EDGES
) -> DataFrame:
    """Edges between visited nodes of a question in id order, at most ``limit``, with the number matched."""
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    inside = edges_within(catalog_visible(edges, classes), visited, ["query_id"])
    total = inside.groupBy("query_id").agg(F.count("*").alias("matched"))
    return catalog.top_k(inside, ["query_id"], [F.col("id"), F.col("source"), F.col("target")], limit).join(total, "query_id")


def experts(visited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expert nodes of the visited subgraphs."""
    return visited.join(nodes.filter(F.col("type") == "expert").select("id", "label"), "id").select("query_id", "id", "label")


# --- components and communities ----------------------------------------------------------------------------------------


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): smallest id of each connected component.

    Every round a node takes the smallest root among its neighbours and then its root's root; minima are pre-aggregated
    per task, so a hub costs no more than its edges. Rounds end when nothing moves.
    """
    c = F.col
    ways = checkpoint(links.select(F.explode(F.array(
        F.struct(c("source").alias("id"), c("target").alias("other")), F.struct(c("target").alias("id"), c("source").alias("other"))
    )).alias("w")).select("w.id", "w.other").distinct())
    state = checkpoint(ids.select("id").distinct().select("id", c("id").alias("root")))
    while True:
        near = ways.join(state.select(c("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        step = state.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = step.select(c("id").alias("low"), c("low").alias("far"))
        moved = checkpoint(step.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("new"), "root"))
        state = moved.select("id", c("new").alias("root"))
        if not moved.filter(c("new") != c("root")).limit(1).count():
            return state


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Modularity of a partition, edge weight = confidence, parallel edges counted once by their largest weight."""
    c = F.col
    pair = edges.filter(c("source") != c("target")).groupBy(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).agg(F.max("confidence").alias("w"))
    side = lambda n: members.select(c("id").alias(n), c("community").alias(f"c{n}"))
    rows = pair.join(side("a"), "a").join(side("b"), "b")
    inside = rows.agg(F.sum("w").alias("m"), F.sum(F.when(c("ca") == c("cb"), c("w")).otherwise(0.0)).alias("inner"))
    degree = rows.select(F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("d"))
    spread = degree.agg(F.sum(c("d") * c("d"))).scalar()
    return inside.select((c("inner") / c("m") - spread / (4 * c("m") * c("m"))).alias("modularity"))


def label_communities(nodes: DataFrame, members: DataFrame, minimum: int = MIN_COMMUNITY, first: int = 64) -> DataFrame:
    """(id, name): a readable name per community, unique, larger communities first.

    Communities below the minimum share one bucket. A community takes its most frequent label (longer, then alphabetical on
    ties) that no larger one has taken, else its main type, else a number. All communities propose their best label at
    once; a label goes to the largest proposer and the others move on, which ends in the same names as going one by one.
    """
    c = F.col
    rows = nodes.select("id", F.trim(F.lower("label")).alias("label"), "type").join(members, "id")
    sizes = rows.groupBy("community").agg(F.count("*").alias("size"))
    big = sizes.filter(c("size") >= minimum)
    order = checkpoint(big.select("community", F.struct((-c("size")).alias("s"), "community").alias("order")))
    counted = rows.filter(c("label") != "").join(order, "community").groupBy("community", "order", "label").agg(F.count("*").alias("n"))
    main = rows.join(order, "community").groupBy("community", "order", "type").agg(F.count("*").alias("n")).groupBy("community", "order").agg(
        F.min(F.struct((-c("n")).alias("k"), "type"))["type"].alias("type")
    )
    kinds = F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p])
    rank_by = [F.desc("n"), F.desc(F.length("label")), c("label")]
    while True:
        listed = catalog.top_k(counted, ["community", "order"], rank_by, first).select("community", "order", "label", c("rank").alias("place"))
        last = main.select("community", "order", F.coalesce(F.try_element_at(kinds, c("type")), F.lit(UNNAMED_COMMUNITY)).alias("label"), F.lit(2**30).alias("place"))
        table = checkpoint(listed.unionByName(last))
        more = counted.groupBy("community").agg(F.count("*").alias("all")).filter(c("all") > first)
        refused = checkpoint(table.select("community", "label").limit(0))
        while True:
            left = table.join(refused, ["community", "label"], "left_anti")
            asked = left.groupBy("community", "order").agg(F.min_by("label", "place").alias("label"), F.min("place").alias("place"))
            won = asked.groupBy("label").agg(F.min("order").alias("order"))
            lost = checkpoint(asked.join(won, ["label", "order"], "left_anti").select("community", "label"))
            if not lost.limit(1).count():
                break
            refused = checkpoint(refused.unionByName(lost))
        # A community that fell back to its type although it has more labels than were listed: list more of them.
        short = asked.filter(c("place") == 2**30).join(more, "community", "left_semi")
        if not short.limit(1).count():
            break
        first *= 4
    # Number of a community that got no name: those of larger size, then those before it in its own size.
    per_size = big.groupBy("size").agg(F.count("*").alias("n"))
    before = per_size.withColumn("before", F.coalesce(
        F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )).select("size", "before")
    place = big.join(before, "size").withColumn(
        "number", c("before") + F.row_number().over(Window.partitionBy("size").orderBy("community"))
    ).select("community", F.concat_ws(" ", F.lit(UNNAMED_COMMUNITY), c("number").cast("string")).alias("numbered"))
    got = asked.select("community", "label")
    nameless = order.join(got, "community", "left_anti").select("community")
    if nameless.limit(1).count():
        got = got.unionByName(place.join(nameless, "community", "left_semi").withColumnRenamed("numbered", "label"))
    named = got.withColumnRenamed("label", "name")
    return members.join(named, "community", "left").select("id", F.coalesce("name", F.lit(SMALL_COMMUNITY)).alias("name"))


def community_profiles(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Size, type counts, central labels, claims, sources, years and territories of every community.

    ``nodes`` carries ``community``. Every list is cut per community before it is collected.
    """
    c = F.col
    rows = nodes.filter(c("community") != "").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    key = ["community"]
    place = [F.desc("degree"), c("label"), c("id")]
    size = rows.groupBy(*key).agg(F.count("*").alias("size"))
    kinds = rows.groupBy(*key, "type").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("k"), "type"))), lambda t: F.concat(t["type"], F.lit(":"), -t["k"])), ", ").alias("types")
    )

    def first_labels(df: DataFrame, k: int, name: str, label: str = "label") -> DataFrame:
        # Distinct labels by their best member, then the first k of them.
        best = df.groupBy(*key, c(label).alias("label")).agg(F.min(F.struct((-c("degree")).alias("d"), c(label).alias("l"), "id")).alias("b"))
        top = catalog.top_k(best, key, [c("b")], k)
        return top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias(name))

    labels = first_labels(rows, 8, "labels")
    sources = first_labels(rows.filter(c("type") == "publication"), 3, "sources")
    own = rows.filter(c("type") == "claim").select(*key, c("label").alias("text"), F.struct(F.lit(0).alias("s"), (-c("degree")).alias("d"), "label", "id").alias("o"))
    stated = findings.select(F.regexp_replace("id", "^finding-", "").alias("id"), c("id").alias("fid"), F.trim(F.substring("statement", 1, 160)).alias("text"))
    said = stated.join(rows.select("id", "community"), "id").select(*key, "text", F.struct(F.lit(1).alias("s"), F.lit(0).cast("bigint").alias("d"), c("fid").alias("label"), "id").alias("o"))
    said = catalog.top_k(said, key, [c("o")], 4).drop("rank")
    merged = own.unionByName(said).groupBy(*key, "text").agg(F.min("o").alias("o"))
    claims = catalog.top_k(merged, key, [c("o")], 4).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("claims")
    )
    year = F.try_element_at("metadata", F.lit("year")).try_cast("int")
    years = rows.filter(year.between(1800, 2100)).groupBy(*key).agg(F.array_sort(F.collect_set(year)).alias("years"))
    where = F.trim(F.try_element_at("metadata", F.lit("geography")))
    places = rows.filter(where != "").groupBy(*key, where.alias("g")).agg(F.min("id").alias("id"))
    places = catalog.top_k(places, key, [c("id"), c("g")], 3).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("geographies")
    )
    out = size.join(kinds, key)
    for part in (labels, sources, claims, years, places):
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({n: F.coalesce(n, empty) for n in ("labels", "sources", "claims", "geographies")}).withColumn(
        "years", F.coalesce("years", F.array().cast("array<int>"))
    )


def profile_text(profiles: DataFrame) -> DataFrame:
    """Lower-case text of a profile, used for matching."""
    kinds = F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p])
    types = F.transform(F.split("types", ", "), lambda t: F.coalesce(F.try_element_at(kinds, F.substring_index(t, ":", 1)), F.substring_index(t, ":", 1)))
    parts = F.concat(F.array("community"), "labels", "claims", "sources", "geographies", types)
    return profiles.select(F.col("community").alias("id"), "size", F.lower(F.array_join(parts, " ")).alias("haystack"))


def profile_summary(profiles: DataFrame, limit: int = SUMMARY_LIMIT) -> DataFrame:
    """Printed brief of a profile, cut at ``limit`` characters."""
    c = F.col
    kinds = F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p])
    types = F.array_join(F.transform(F.slice(F.split("types", ", "), 1, 3), lambda t: F.concat(
        F.lower(F.coalesce(F.try_element_at(kinds, F.substring_index(t, ":", 1)), F.substring_index(t, ":", 1))), F.lit(" "), F.substring_index(t, ":", -1)
    )), ", ")
    span = F.when(F.size("years") == 1, F.array_min("years").cast("string")).when(
        F.size("years") > 1, F.concat(F.array_min("years").cast("string"), F.lit("–"), F.array_max("years").cast("string"))
    )
    where = F.when(F.size("geographies") > 0, F.array_join(F.slice("geographies", 1, 2), ", "))
    period = F.concat_ws("; ", span, where)
    some = lambda name, prefix, sep: F.when(F.size(name) > 0, F.concat(F.lit(prefix), F.array_join(name, sep)))
    text = F.concat_ws(
        " · ", F.concat(F.lit("«"), c("community"), F.lit("»: "), c("size").cast("string"), F.lit(" сущностей")), types,
        some("labels", "сущности: ", ", "), some("claims", "утверждения: ", "; "),
        F.when(F.size("sources") > 0, F.concat(F.lit("источники: "), F.array_join("sources", ", "), F.when(period != "", F.concat(F.lit(", "), period)).otherwise(""))),
    )
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return profiles.select("community", F.when(F.length(text) <= limit, text).otherwise(cut).alias("summary"))


def rank_profiles(tokens: DataFrame, profiles: DataFrame, k: int = PROFILE_LIMIT) -> DataFrame:
    """First k profiles per question: distinct tokens (three characters or more) found in the text, size, name.

    ``tokens``: (query_id, token), with a null token for a question without any. Profiles without a hit come last, and only
    the largest 2k of them can.
    """
    c = F.col
    asked = tokens.select("query_id").distinct()
    good = tokens.filter(F.length("token") >= 3).select("query_id", F.lower("token").alias("token")).distinct()
    texts = profile_text(profiles)
    hits = token_hits(asked, texts, "haystack", good).join(texts.select("id", "size"), "id")
    order = [F.desc("hits"), F.desc("size"), c("id")]
    best = catalog.top_k(hits.select("query_id", "id", "hits", "size"), ["query_id"], order, k).drop("rank")
    large = texts.orderBy(F.desc("size"), "id").limit(2 * k).agg(F.collect_list(F.struct("id", "size"))).scalar()
    rest = asked.select("query_id", F.explode(large).alias("r")).select("query_id", "r.*").join(
        hits.select("query_id", "id"), ["query_id", "id"], "left_anti"
    ).select("query_id", "id", F.lit(0).cast("bigint").alias("hits"), "size")
    return catalog.top_k(best.unionByName(rest), ["query_id"], order, k).withColumnRenamed("id", "community")


# --- merge proposals ---------------------------------------------------------------------------------------------------


def proposal_id(source: Column, target: Column) -> Column:
    return uuid5(MERGE_NAMESPACE, F.concat(F.lower(source), F.lit("->"), F.lower(target)))


def register_proposals(base: DataFrame, batch: DataFrame) -> DataFrame:
    """``link`` resolutions as proposals; an accepted proposal keeps its status and takes confidence and rationale."""
    c = F.col
    fresh = batch.filter(c("action") == "link").select(
        proposal_id(c("mention"), c("canonical_name")).alias("id"), c("mention").alias("source"), c("canonical_name").alias("target"),
        "confidence", "rationale", F.lit("proposed").alias("status"), "seq",
    )
    last = catalog.top_k(fresh, ["id"], [F.desc("seq")], 1, "_n").drop("_n", "seq")
    old = base.select("id", c("status").alias("_old"))
    merged = last.join(old, "id", "left").withColumn("status", F.when(c("_old") == "accepted", "accepted").otherwise(c("status"))).drop("_old")
    return base.join(last.select("id"), "id", "left_anti").select(*merged.columns).unionByName(merged)


def review_proposals(proposals: DataFrame, log: DataFrame, nodes: DataFrame) -> DataFrame:
    """State after a review log (proposal_id, action, seq, reviewer_id).

    The last action counts. Accepting needs both names to be the id or label of a node, else the proposal stays as it was
    with an error. The smallest matching node id stands for a name.
    """
    c = F.col
    last = catalog.top_k(log, ["proposal_id"], [F.desc("seq")], 1, "_n").drop("_n").withColumnRenamed("proposal_id", "id")
    names = nodes.select("id", F.explode(F.array_distinct(F.array("id", "label"))).alias("name")).groupBy("name").agg(F.min("id").alias("node_id"))
    rows = proposals.join(last, "id", "left")
    for end in ("source", "target"):
        rows = rows.join(names.select(c("name").alias(end), c("node_id").alias(f"{end}_id")), end, "left")
    missing = (c("action") == "accept") & (c("source_id").isNull() | c("target_id").isNull())
    status = F.when(missing | c("action").isNull(), c("status")).otherwise(
        F.try_element_at(F.create_map(*[F.lit(x) for p in {"accept": "accepted", "reject": "rejected", "revert": "reverted"}.items() for x in p]), c("action"))
    )
    return rows.withColumn("error", F.when(missing, "unknown_entity")).withColumn("status", status).withColumn(
        "active", (c("status") == "accepted") & c("error").isNull()
    )


def alias_map(proposals: DataFrame) -> DataFrame:
    """(alias, canonical) of the accepted proposals, alias in lower case."""
    return proposals.filter(F.col("status") == "accepted").groupBy(F.lower("source").alias("alias")).agg(F.max("target").alias("canonical"))
