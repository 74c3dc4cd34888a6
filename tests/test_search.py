"""Vectors, substring hits and greedy re-ranking against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import search as S


def greedy(items, k):
    left, taken, out = sorted(items), set(), []
    while left and len(out) < k:
        best = min(left, key=lambda x: (-(x[2] + (70_000_000 if x[1] and x[1] in taken else 0)), x[0]))
        left.remove(best)
        out.append(best[0])
        if best[1]:
            taken.add(best[1])
    return out


def test_rerank_equals_the_greedy_choice(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(300):
        items = [(f"i{j}", rng.choice(["", "a", "b"]), rng.choice([0, 30, 70, 100, 140, 170]) * 1_000_000) for j in range(rng.randint(1, 9))]
        want[str(q)] = greedy(items, 6)
        rows += [(str(q), i, c, b / 1e9) for i, c, b in items]
    df = spark.createDataFrame(rows, "query_id STRING, id STRING, community STRING, base DOUBLE")
    got = {}
    for r in S.rerank(df, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


@pytest.mark.parametrize("limit", [4096, 2])
def test_vector_leg_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "QUERY_LIMIT", limit)
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    vectors = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)], "id STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(q)], "query_id STRING, embedding ARRAY<FLOAT>")
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {f"q{i}": [f"v{j:03d}" for j in np.argsort(-row)[:7]] for i, row in enumerate(sims)}
    got = {}
    for r in S.vector_leg(queries, vectors, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_wrong_dimension_finds_nothing(spark):
    vectors = spark.createDataFrame([("v", [1.0, 0.0])], "id STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([("q", [1.0])], "query_id STRING, embedding ARRAY<FLOAT>")
    assert S.vector_leg(queries, vectors, 3, dim=2).count() == 0


def test_token_hits_are_substring_hits(spark):
    texts = {"a": "Ironworks, (iron)", "b": "environment iro n", "c": ""}
    queries = {"q1": "iron works environ", "q2": "(it), the of"}
    t = spark.createDataFrame(list(texts.items()), "id STRING, body STRING")
    q = spark.createDataFrame(list(queries.items()), "query_id STRING, text STRING")
    strip = ".,;:!?()[]{}«»\"'"
    want = {}
    for qid, text in queries.items():
        tokens = {w.lower().strip(strip) for w in text.split() if len(w) >= 4} - {""}
        for tid, body in texts.items():
            n = sum(tok in body.lower() for tok in tokens)
            if n:
                want[qid, tid] = n
    assert {(r.query_id, r.id): r.hits for r in S.token_hits(q, t, "body").collect()} == want


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>").select(S.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert abs(row.c - 0.5 ** 0.5) < 1e-12


def test_select_relevant_fills_places_and_reads_once(spark):
    rng = random.Random(4)
    words = ["zinc", "copper", "leaching", "tails", "slag", "kiln"]
    docs = [(f"d{i:02}", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=3)), "title", "", float(i % 4)) for i in range(30)]
    asked = [("none", "nickel only"), ("few", "kilns kiln"), ("many", "zinc copper leaching"), ("blank", "")]
    df = spark.createDataFrame(docs, "id STRING, statement STRING, quote STRING, source_title STRING, subject STRING, confidence DOUBLE")
    found = S.select_relevant(spark.createDataFrame(asked, "query_id STRING, text STRING"), df, 12)
    for q, text in asked:
        tokens = {w for w in text.split() if len(w) >= 4}
        hits = lambda t: sum(w in t for w in tokens)  # noqa: E731, B023
        want = sorted(((-hits(s), -hits(e), -c, i) for i, s, e, _, _, c in docs))[:12]
        assert [(-r.statement_hits, -r.quote_hits, -r.confidence, r.id) for r in sorted(found.filter(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # the fillers: hits are read, not worked out again
