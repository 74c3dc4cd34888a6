"""Gap reports and files against what must come out of them by hand."""

from factweave.operators import catalog, conflicts, tools
from factweave.sources import corpus
from pyspark.sql import functions as F

CLAIMS = "pool STRING, finding_id STRING, subject_id STRING, property_name STRING, scope MAP<STRING,STRING>"


def test_gap_report_states_what_it_rests_on(spark):
    """Gaps, a full matrix, a pool without dimensions, and a null pool."""
    scoped = lambda pool, f, a, b: (pool, f, "s", "p", {"geo": a, "year": b})
    rows = [scoped("open", "f1", "x", "1"), scoped("open", "f1", "y", "2"), scoped("open", "f2", "x", "1")]
    rows += [scoped("full", "f1", a, b) for a in "xy" for b in "12"]
    rows += [("flat", "f1", "s", "p", {}), ("flat", "f2", "s", "p", None)]
    got = {r.pool: r for r in conflicts.gap_report(spark.createDataFrame(rows, CLAIMS), ["pool"]).collect()}
    assert set(got) == {"open", "full", "flat"}
    assert (got["open"].status, got["open"].claims, got["open"].findings, got["open"].uncovered, got["open"].gaps) == ("success", 3, 2, 2, "geo=x, year=2 | geo=y, year=1")
    assert (got["full"].status, got["full"].uncovered, got["full"].shown) == ("warning", 0, 0)
    assert (got["flat"].status, got["flat"].claims, got["flat"].dimensions) == ("warning", 2, None)
    assert conflicts.gap_report(spark.createDataFrame([], CLAIMS), ["pool"]).count() == 0


def test_nine_tools(spark):
    assert sorted(tools.TOOLS) == sorted(
        ["hybrid_search", "graph_traverse", "community_search", "numeric_filter", "conflict_scan", "gap_scan", "expert_lookup", "finding_lookup", "public_search"]
    )


def test_signals_by_kind_and_text(spark):
    rows = [("a", "numeric", "One", None, [("Long Quote",)]), ("b", "numeric", "two 50%", "Propose", []), ("c", "cause", "one", None, None), ("d", None, None, None, [(None,)])]
    df = spark.createDataFrame(rows, "id STRING, kind STRING, statement STRING, proposal STRING, evidence ARRAY<STRUCT<quote: STRING>>")
    ids = lambda **kw: sorted(r.id for r in catalog.filter_signals(df, **kw).collect())
    assert ids(kind="numeric") == ["a", "b"] and ids(text=" ONE ") == ["a", "c"] and ids(text="quote") == ["a"]
    assert ids(text="propose") == ["b"] and ids(text="50%") == ["b"] and ids(kind="cause", text="two") == [] and ids() == ["a", "b", "c", "d"]


def test_files_of_a_corpus(spark, tmp_path):
    """Statuses, limits in path order, and every reason to refuse a file."""
    long = "long enough to be a document"
    files = {
        "b/One.TXT": long.encode(), "a/two.md": b"\xef\xbb\xbf" + long.encode(), "a/ok.json": b'{"key": "long enough to be read"}', "a/bad.json": b'{"key": long enough to be',
        "short.txt": b" \n too short \n", "big.txt": b"x" * 500, "c/skip.pdf": b"%PDF", "c/none": b"plain", "bom.md": b"\xef\xbb\xbf",
    }
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    tail = F.regexp_extract("path", rf"{tmp_path.name}/(.*)$", 1)
    scanned = {r.name: r.status for r in corpus.scan_corpus(spark, str(tmp_path), 400).select(tail.alias("name"), "status").collect()}
    assert scanned == {n: "unsupported" if n in ("c/skip.pdf", "c/none") else "oversize" if n == "big.txt" else "pending" for n in files}
    first = [r.name for r in corpus.scan_corpus(spark, str(tmp_path), 400, limit=2).filter("status = 'pending'").select(tail.alias("name")).collect()]
    assert sorted(first) == ["a/bad.json", "a/ok.json"]
    read = {r.name: r for r in corpus.read_text_documents(spark, str(tmp_path), 400).withColumn("name", tail).collect()}
    assert {n: r.error for n, r in read.items()} == {
        "b/One.TXT": None, "a/two.md": None, "a/ok.json": None, "a/bad.json": "invalid_json", "short.txt": "too_short", "bom.md": "too_short", "big.txt": "oversize",
    }
    assert read["a/two.md"].text == long and read["b/One.TXT"].title == "One" and read["big.txt"].text is None and read["a/two.md"].fragments[0].page == 1
