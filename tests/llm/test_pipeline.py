"""The pipeline's stages on the smallest table: contracts between stages, and what each one drops."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from factweave.sources.testdata import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > 0.7 * counts[0] and counts[1] >= counts[2] >= counts[3] > 0.7 * counts[0]
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count() and ids.filter("ids IS NULL").count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_dedup_stages_against_brute_force_with_repeated_ids(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(8)]
    near = lambda t, k: " ".join(x if i != k else "edit" for i, x in enumerate(t.split()))
    rows = [(i % 11, t) for i, t in enumerate(base + [near(t, 3) for t in base] + [near(t, 57) for t in base[:4]] + [base[2].upper(), base[5]])]
    rows += [(3, None), (4, ""), (4, "short"), (9, "short"), (None, base[1]), (None, "only null"), (0, base[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").withColumn("score", F.lit("kept"))

    # equal texts after lower-casing A-Z: the largest id stays, null only without another
    newest = {}
    for i, t in rows:
        k = (t or "").encode().lower()
        newest[k] = max((x for x in (newest.get(k), i) if x is not None), default=None)
    exact = [(i, t) for i, t in rows if i == newest[(t or "").encode().lower()]]
    got = corpus_pipeline.drop_copies(spark, docs, SF)
    assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, exact))

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for (i, t), r, s, at in zip(rows, root, sets, range(len(rows)), strict=True):
        groups.setdefault(r if s else ("empty", at), set()).add((i, t))
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and set(r.score for r in got.collect()) == {"kept"}
    for members in groups.values():
        least = min((i is None, i or 0) for i, _ in members)
        mine = [m for m in kept if m in members]
        assert len(set(mine)) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least
    assert set(kept) <= {m for g in groups.values() for m in g}


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_ids_are_written_before_they_are_decoded(spark):
    docs = table(spark, SF, "documents").limit(20)
    plan = corpus_pipeline.tokenise(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan  # one Python worker a task
