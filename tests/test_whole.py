"""Whole-input queries against their SQL, or against a plain loop."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle_check
from factweave.plans import whole_queries as W
from factweave.plans.graph_queries import community_nodes
from factweave.sources import testdata as T

SF = "/root/testdata/sf0.001"
NAMES = ["components", "finding_communities", "hypothesis_groups", "review_proposals", "case_difference", "reconcile_gold", "rivals_whole"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("name", NAMES)
def test_whole_query_agrees_with_sql(spark, name):
    sf = SF if name != "rivals_whole" else SF.replace("0.001", "0.01")  # the smallest tables have no rivals
    ok, note, _, rows = oracle_check.compare(entry.queries()[name](spark, sf), oracle_check.duck(sf), entry.oracle_sql()[name])
    assert ok and rows, note


def test_components_of_the_whole_graph(spark):
    nodes = [r.id for r in T.nodes(spark, SF).select("id").collect()]
    links = [(r.source, r.target) for r in T.edges(spark, SF).select("source", "target").collect()]
    want = roots([(n, n) for n in nodes] + links)
    assert {tuple(r) for r in W.components(spark, SF).select("id", "root").collect()} == {(n, want[n]) for n in nodes}


def test_hypothesis_groups_of_the_whole_graph(spark):
    nodes = community_nodes(spark, SF).select("id", "community", "data_class").collect()
    links = [(f"0finding-{n.id}", f"1{n.id}") for n in nodes] + [(f"0finding-{n.id}", f"2{n.community}") for n in nodes if n.community]
    want = roots(links + [(f"1{r.source}", f"1{r.target}") for r in T.edges(spark, SF).select("source", "target").collect()])
    assert {tuple(r) for r in W.hypothesis_groups(spark, SF).select("id", "root", "data_class").collect()} == {
        (f"finding-{n.id}", want[f"0finding-{n.id}"][1:], n.data_class) for n in nodes
    }


def test_unmatched_units_beyond_barrels(spark):
    rows = W.unit_unmatched(spark, SF).collect()
    con = oracle_check.duck(SF).execute(entry.oracle_sql()["unit_unmatched"])
    at = [[d[0] for d in con.description].index(x) for x in ("query_id", "number", "answer_unit")]
    assert sorted(tuple(r) for r in rows if r.answer_unit == "barrels") == sorted(tuple(r[i] for i in at) for r in con.fetchall())
    assert {r.answer_unit for r in rows} > {"barrels"}
