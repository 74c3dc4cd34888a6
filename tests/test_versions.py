"""Version chains: ends of chains and of cycles."""

from factweave.operators import catalog


def test_chains_end_and_cycles_end_in_their_smallest_id(spark):
    links = spark.createDataFrame([*zip("abctuxypqrz", "bcaubyxqrsz", strict=True)], "id string, next string")
    ends = {r["id"]: r["end"] for r in catalog._ends(links).collect()}
    assert ends == {**dict.fromkeys("abctu", "a"), **dict.fromkeys("xy", "x"), **dict.fromkeys("pqrs", "s"), "z": "z"}


def test_history_of_a_cycle_is_finite(spark):
    rows = [("a", 1, "b"), ("b", 2, "c"), ("c", 3, "a"), ("d", 1, None)]
    findings = spark.createDataFrame(rows, "id string, version int, superseded_by string")
    got = {(r["finding_id"], r["version_id"], r["position"]) for r in catalog.version_history(findings).collect()}
    assert got == {(f, v, p) for f in "abc" for p, v in enumerate("abc", 1)} | {("d", "d", 1)}
