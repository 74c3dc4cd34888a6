"""Files, parts, markup, sinks."""

import json
from html.parser import HTMLParser

from pyspark.sql import functions as F

from factweave.operators import ingest as I  # noqa: E741
from factweave.schemas import DOCUMENTS
from factweave.sources import corpus, sinks


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("﻿A text that is long enough to keep.", encoding="utf-8")
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"key": "value of some length"}), encoding="utf-8")
    (tmp_path / "c.json").write_text('{"key": "broken and long enough"', encoding="utf-8")
    (tmp_path / "d.txt").write_text("short", encoding="utf-8")
    (tmp_path / "e.pdf").write_bytes(b"x")
    scan = {r.path.rsplit("/", 1)[1]: r.status for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert scan == {"a.txt": "pending", "b.json": "pending", "c.json": "pending", "d.txt": "pending", "e.pdf": "unsupported"}
    assert corpus.scan_corpus(spark, str(tmp_path), limit=2).filter("status = 'pending'").count() == 2
    read = {r.title: r for r in corpus.read_text_documents(spark, str(tmp_path)).collect()}
    assert read["a"].text.startswith("A text") and read["a"].error is None and read["b"].error is None
    assert read["c"].error == "invalid_json" and read["d"].error == "too_short"


def test_parts_keep_the_text_and_fill_the_tail(spark):
    lines = ["x" * 30, "y" * 45, "", "z" * 95, "ab"]
    fragments, at = [], 0
    for i, line in enumerate(lines):
        fragments.append((line, i + 1, None, None, at))
        at += len(line) + 1
    doc = spark.createDataFrame([("d", "t", "\n".join(lines), "en", None, None, "public", fragments)], DOCUMENTS)
    rows = sorted(I.semantic_parts(doc, limit=80, minimum=20).collect(), key=lambda r: r.pos)
    assert "".join(r.text for r in rows) == "".join(lines)
    text = "\n".join(lines)
    assert all(text[r.start:r.start + len(r.text)] == r.text for r in rows)
    parts = {}
    for r in rows:
        parts.setdefault(r.part, []).append(len(r.text))
    totals = [sum(p) + 2 * (len(p) - 1) for _, p in sorted(parts.items())]
    assert all(n <= 80 for n in totals[:-1]) and totals[-1] >= 20


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def test_markup_like_an_html_parser(spark):
    pages = [
        "<p>a&nbsp;b &lt;c&gt; &#233;&#x41;</p><!-- no --><script>var t='</p>';</script>d",
        "<div class='x'>one<br>two</div> three &copy; &unknown; <b", "<p>1 < 2</p>", "text only",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i INT, html STRING")
    got = {r.i: r.t for r in df.select("i", I.plain_markup(F.col("html")).alias("t")).collect()}
    for i, page in enumerate(pages):
        parser = Plain()
        parser.feed(page)
        assert got[i].replace(" ", "") == "".join(" ".join(parser.parts).split()), page


def test_markdown_sections(spark):
    row = ("q", "Q?", "S", 0.5, "none", [], ["c"], [], [], [])
    schema = (
        "query_id STRING, question STRING, summary STRING, confidence DOUBLE, model_mode STRING, findings ARRAY<STRUCT<id STRING, statement STRING, confidence DOUBLE, status STRING, version INT,"
        " evidence ARRAY<STRUCT<source_title STRING, page INT, sheet STRING, source_url STRING, retrieved_at STRING, quote STRING>>,"
        " observations ARRAY<STRUCT<property_name STRING, raw_text STRING, normalized_unit STRING>>>>, conflicts ARRAY<STRING>, knowledge_gaps ARRAY<STRING>, recommendations ARRAY<STRING>, trace ARRAY<STRING>"
    )
    df = spark.createDataFrame([row], schema)
    lines = sinks.export_markdown(df).first().value.split("\n")
    assert [x for x in lines if x.startswith("#")] == [sinks.TITLE + "Q?", sinks.SUMMARY, sinks.CONFLICTS, sinks.META]
    assert json.loads(sinks.export_jsonld(df).first().value)["claim:conflicts"] == ["c"]


def test_salvage_tells_missing_from_empty(spark):
    df = spark.createDataFrame([(1, [1, -1]), (2, []), (3, None)], "i INT, x ARRAY<INT>")
    got = {r.i: r.s for r in df.select("i", corpus.salvage_items(F.col("x"), lambda v: v > 0).alias("s")).collect()}
    assert (got[1].kept, got[1].dropped) == ([1], 1) and not got[2].missing and got[3].missing
