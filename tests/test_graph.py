"""Components, communities, names and version chains against plain loops."""

import random
from collections import Counter

from pyspark.sql import functions as F

from factweave.operators import catalog as C
from factweave.operators import graph as G
from factweave.operators import modularity as M
from factweave.operators import hypotheses as H

NODES = "id STRING, label STRING, type STRING, confidence DOUBLE, data_class STRING, metadata MAP<STRING,STRING>"
EDGES = "id STRING, source STRING, target STRING, relation STRING, confidence DOUBLE, data_class STRING"


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i, f"label {i}", "material", 1.0, "public", {}) for i in ids], NODES)
    edges = spark.createDataFrame([(f"{a}-{b}", a, b, "FEEDS", 1.0, "public") for a, b in pairs], EDGES)
    return nodes, edges


def test_components(spark):
    rng = random.Random(2)
    ids = [f"n{i:02d}" for i in range(60)]
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(35)] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40, 58)]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes, edges = graph(spark, ids, pairs)
    assert {r.id: r.root for r in G.components(nodes, edges).collect()} == {i: root(i) for i in ids}


def test_two_cliques_with_a_bridge(spark):
    a, b = [f"a{i:02d}" for i in range(15)], [f"b{i:02d}" for i in range(15)]
    pairs = [(x, y) for side in (a, b) for i, x in enumerate(side) for y in side[i + 1:]] + [("a14", "b00")]
    nodes, edges = graph(spark, a + b, pairs)
    first = {r.id: r.community for r in M.communities(nodes, edges).collect()}
    assert len({first[x] for x in a}) == 1 and len({first[x] for x in b}) == 1 and first["a00"] != first["b01"]
    assert first == {r.id: r.community for r in M.communities(nodes, edges).collect()}
    members = spark.createDataFrame(list(first.items()), "id STRING, community STRING")
    assert G.modularity(members, edges).first().modularity > 0.45


def test_no_single_move_gains(spark):
    rng = random.Random(8)
    ids = [f"n{i:02d}" for i in range(40)] + ["alone"]
    pairs = [(a, b) for i, a in enumerate(ids[:40]) for b in ids[i + 1 : 40] if rng.random() < (0.5 if a[1] == b[1] else 0.04)] + [("n00", "n00"), ("n00", "gone"), ("n01", "n00")]
    nodes, edges = graph(spark, ids, pairs)
    of = {r.id: r.community for r in M.communities(nodes, edges).collect()}
    near = {i: set() for i in ids}
    for a, b in pairs:
        if a != b and b in near:
            near[a].add(b)
            near[b].add(a)
    m = sum(map(len, near.values()))

    def quality(of):
        inner = sum(of[a] == of[b] for a in ids for b in near[a])
        total = {}
        for i in ids:
            total[of[i]] = total.get(of[i], 0) + len(near[i])
        return m * inner - sum(t * t for t in total.values())

    assert sorted(of) == sorted(ids) and of["alone"] == "alone" and all(min(i for i in ids if of[i] == k) == k for k in set(of.values()))
    assert all(quality({**of, i: k}) <= quality(of) for i in ids for k in {*of.values(), "new"})
    assert quality(of) >= quality({i: i[1] for i in ids})
    for k in set(of.values()):
        seen, todo = {k}, [k]
        while todo:
            new = {b for b in near[todo.pop()] if of[b] == k} - seen
            seen |= new
            todo += new
        assert seen == {i for i in ids if of[i] == k}


def test_no_edges_is_one_community(spark):
    nodes, edges = graph(spark, ["x", "y", "z"], [("x", "y")])
    assert {r.community for r in M.communities(nodes, edges.limit(0)).collect()} == {G.FALLBACK_COMMUNITY}


def test_names_are_given_one_by_one(spark):
    rng = random.Random(4)
    rows, members = [], {}
    for k in range(8):
        for i in range(15 + k if k else 3):
            rows.append((f"n{k}-{i}", rng.choice(["iron", "zinc", "water", "acid"]), "material", 1.0, "public", {}))
            members[f"n{k}-{i}"] = f"c{k}"
    labels = {r[0]: r[1] for r in rows}
    sizes = Counter(members.values())
    used, want = set(), {}
    for com, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if size < 15:
            want[com] = G.SMALL_COMMUNITY
            continue
        counts = Counter(labels[i] for i, c in members.items() if c == com)
        names = sorted(counts, key=lambda x: (-counts[x], -len(x), x))
        name = next((n for n in names if n not in used), None)
        if name is None:
            name = G.TYPE_NAMES["material"] if G.TYPE_NAMES["material"] not in used else f"Сообщество {len(used) + 1}"
        used.add(name)
        want[com] = name
    nodes = spark.createDataFrame(rows, NODES)
    out = G.label_communities(nodes, spark.createDataFrame(list(members.items()), "id STRING, community STRING"), first=2).collect()
    assert {members[r.id]: r.name for r in out} == want


def test_version_chain_with_a_cycle(spark):
    rows = [("a", 1, "b"), ("b", 2, "c"), ("c", 3, None), ("x", 1, "y"), ("y", 2, "x"), ("s", 1, None), ("g", 1, "gone")]
    out = C.version_history(spark.createDataFrame(rows, "id STRING, version INT, superseded_by STRING")).collect()
    chain = {}
    for r in sorted(out, key=lambda r: r.position):
        chain.setdefault(r.finding_id, []).append(r.version_id)
    assert chain["a"] == chain["b"] == chain["c"] == ["a", "b", "c"]
    assert chain["s"] == ["s"] and chain["g"] == ["g"]


def test_packing_of_batches(spark):
    rng = random.Random(6)
    finding = "id STRING, statement STRING, data_class STRING, evidence ARRAY<STRUCT<document_id STRING, source_title STRING, page INT, sheet STRING, cell_range STRING, quote STRING>>"
    rows = [(f"f{i:02d}", "s" * rng.randint(10, 900), "public", [("d", "t", 1, None, None, "q" * rng.randint(1, 500))] * rng.randint(1, 9)) for i in range(40)]
    f = spark.createDataFrame(rows, finding)
    groups = f.select("id", F.lit("r").alias("root"), "data_class")
    out = sorted(H.pack_batches(groups, f, limit=4000).collect(), key=lambda r: (r.id, r.part))
    batch, used = 0, 2
    for r in out:
        if used > 2 and used + r.size > 4000:
            batch, used = batch + 1, 2
        used += r.size + 1
        assert r.batch == batch
    assert {r.batch for r in H.pack_batches(groups, f, limit=4000, run_rows=5).collect()} != {0}


def test_packing_is_the_same_in_pieces(spark):
    rng = random.Random(7)
    finding = "id STRING, statement STRING, data_class STRING, evidence ARRAY<STRUCT<document_id STRING, source_title STRING, page INT, sheet STRING, cell_range STRING, quote STRING>>"
    rows = [(f"f{i:03d}", "s" * rng.randint(10, 900), "public", [("d", "t", 1, None, None, "q" * rng.choice([1, 100, 3000]))] * rng.randint(1, 9)) for i in range(150)]
    f = spark.createDataFrame(rows, finding)
    groups = f.select("id", F.when(F.col("id") < "f120", "r").otherwise("q").alias("root"), "data_class")
    for limit in (300, 4000, 40_000):
        want = {(r.root, r.id, r.part, r.batch) for r in H.pack_batches(groups, f, limit=limit).collect()}
        state, plain = {}, set()
        for r in sorted(H.pack_batches(groups, f, limit=limit, run_rows=7).collect(), key=lambda r: (r.root, r.id, r.part)):
            batch, used = state.get(r.root, (0, 2))
            if used > 2 and used + r.size > limit:
                batch, used = batch + 1, 2
            state[r.root] = batch, used + r.size + 1
            plain.add((r.root, r.id, r.part, batch))
            assert (r.batch, r.run) == (batch, 0)
        assert plain == want


def test_neighbourhood_of_hubs_against_a_plain_walk(spark):
    rng = random.Random(12)
    ids = [f"n{i:03d}" for i in range(150)]
    pairs = [("n000", i) for i in ids[1:120]] + [("n001", i) for i in ids[60:]] + [(rng.choice(ids), rng.choice(ids)) for _ in range(200)]
    nodes, edges = graph(spark, ids, pairs)
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    starts = [("q0", "n000"), ("q1", "n001"), ("q2", "n050"), ("q2", "n140"), ("q3", "n149")]
    for limit in (1, 7, 40, 500):
        want = set()
        for q in {q for q, _ in starts}:
            seen = {i: 0 for k, i in starts if k == q}
            for level in (1, 2, 3):
                fresh = sorted({b for i, at in seen.items() if at == level - 1 for b in near[i]} - set(seen))
                for b in fresh[: max(0, limit - len(seen))]:
                    seen[b] = level
            want |= {(q, i, at) for i, at in seen.items()}
        got = G.neighbourhood(spark.createDataFrame(starts, "query_id STRING, id STRING"), nodes, edges, 3, limit=limit)
        assert {tuple(r) for r in got.select("query_id", "id", "level").collect()} == want, limit
