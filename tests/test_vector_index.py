"""The inverted-file index: recall on clustered vectors, exactness over all cells, access, unusable vectors, reopening."""

import numpy as np
from factweave.operators import search as S
from factweave.operators import vector_index as V


def clustered(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(f"v{i:04d}", (centres[i % 12] + rng.normal(size=8)).tolist(), ("public", "restricted")[i % 5 == 0]) for i in range(n)]
    rows += [("none", None, "public"), ("short", [1.0], "public"), ("nan", [float("nan")] * 8, "public"), ("hole", [1.0, None] * 4, "public"), ("zero", [0.0] * 8, "public"), ("v0001", rows[1][1], "public")]
    queries = [(f"q{i}", (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(40)] + [("bad", [1.0])]
    return spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, data_class STRING"), spark.createDataFrame(queries, "query_id STRING, embedding ARRAY<FLOAT>")


def test_recall_and_exactness(spark, tmp_path):
    vectors, queries = clustered(spark)
    V.build(vectors, f"{tmp_path}/index", 8)
    index = V.VectorIndex.open(spark, f"{tmp_path}/index")
    assert index.rows.count() == 902 and 2 < len(index.centroids) <= 30
    exact = S.vector_leg(V.usable(queries, 8), index.rows, 10, {"public"}, 8)
    probes = V.probes_for(index, V.usable(queries, 8), 10, 0.9, {"public"})
    found = V.search(index, queries, 10, probes, {"public"})
    assert probes < len(index.centroids) and V.recall(found, exact) >= 0.85
    whole = V.search(index, queries, 10, len(index.centroids), {"public"}).collect()
    assert sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in whole) == sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in exact.collect())


def test_small_parts_and_blocks_give_the_same(spark, tmp_path, monkeypatch):
    vectors, queries = clustered(spark, 200)
    index = V.build(vectors, f"{tmp_path}/index", 8, cells=3)
    key = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    want = key(V.search(index, queries, 5, 2))
    monkeypatch.setattr(V, "PART_ROWS", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    assert key(V.search(index, queries, 5, 2)) == want


def test_nothing_to_index(spark, tmp_path):
    vectors, queries = clustered(spark, 20)
    index = V.build(vectors.filter("id = 'v0003'"), f"{tmp_path}/one", 8)
    assert {r.id for r in V.search(index, queries, 5, 4).collect()} == {"v0003"}
    assert V.search(index, queries.limit(0), 5, 1).count() == 0
    assert V.build(vectors.limit(0), f"{tmp_path}/none", 8).rows.count() == 0


def test_tied_scores_keep_k_rows():
    ids, scores = np.array([f"v{i:02d}" for i in range(40)][::-1]), np.ones((2, 40))
    scores[:, 7] = 2.0
    best = S._best(ids, scores, ["p", "q"], 3)
    assert [(r.query_id, r.id) for r in best.itertuples()] == [(q, v) for q in "pq" for v in ("v32", "v00", "v01")]


def test_cells_and_scores_come_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centroids, points = rng.normal(size=(16, 4)), rng.normal(size=(50, 4)).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:02d}", p.tolist()) for i, p in enumerate(points)], "id STRING, embedding ARRAY<FLOAT>").coalesce(1)
    monkeypatch.setattr(V, "REPEATED", 20)
    order = np.argsort(-(S._unit(points) @ centroids.T), axis=1, kind="stable")[:, :3]
    assert [(r.id, r.cell) for r in V.nearest_cells(rows, centroids, 3).collect()] == [(f"v{i:02d}", x) for i in range(50) for x in order[i]]
    whole = S._best(np.arange(50), S._unit(points) @ S._unit(points).T, list(range(50)), 5)
    monkeypatch.setattr(S, "SCORES", 300)
    pieces = list(S._best_blocks(np.arange(50), S._unit(points), S._unit(points), list(range(50)), 5))
    assert len(pieces) == 9 and [tuple(r[1:3]) for p in pieces for r in p.itertuples()] == [tuple(r[1:3]) for r in whole.itertuples()]
