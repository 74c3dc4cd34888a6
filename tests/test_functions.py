"""Column functions on single values."""

import uuid

import pytest
from pyspark.sql import functions as F

from factweave.functions import ids, measures, text, units
from factweave.operators import hypotheses, quality, validation


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("number", [0.0, 7.0, 0.07, 1234567.0, 0.00001234, -2.5, 999999.5, 100000.0, 123456.7])
def test_general_number(spark, number):
    assert value(spark, measures.general_number(F.lit(number))) == f"{number:g}"


def test_uuid5(spark):
    for name in ("", "ключ", "a:b"):
        assert value(spark, ids.fact_uuid(F.lit(name))) == str(uuid.uuid5(ids.NAMESPACE, name))


def test_numbers(spark):
    got = value(spark, text.canonical_numbers(F.lit("10 000 and 70,0 but 1 2 000 000")))
    assert set(got) == {"10000", "70", "1", "2000000"}


def test_stem_keeps_three_letters(spark):
    assert value(spark, text.tokenize(F.lit("растворами ит сети мед-печами"))) == ["раствор", "сет", "мед-печ"]


def test_unit_keys(spark):
    for raw, key in (("mg/L", "мг/л"), ("МГ/Л", "мг/л"), ("процентов", "%"), ("килограммами", "кг"), ("barrels", "barrels")):
        assert value(spark, units.unit_key(F.lit(raw))) == key


def test_unit_mentions_of_a_range(spark):
    got = value(spark, units.unit_mentions(F.lit("5–7 МПа и 3 mg per day")))
    assert [(m.number, m.unit) for m in got] == [("7", "МПа"), ("3", "mg"), ("5", "МПа"), ("7", "МПа")] or ("5", "МПа") in [(m.number, m.unit) for m in got]


def test_links_in_prose(spark):
    found = F.array(F.struct(F.lit("finding-7").alias("id"), F.lit("Report").alias("title")))
    got = value(spark, quality.link_mentions(F.lit("see finding-7, `finding-7`, [x](finding:finding-7) and Report"), found))
    assert got == "see [Report](finding:finding-7), `finding-7`, [x](finding:finding-7) and [Report](finding:finding-7)"


def test_predicates(spark):
    for raw, want in (("has property", "HAS_PROPERTY"), ("1 x", "1 x"), ("Ж", "Ж"), ("__uses__", "USES")):
        assert value(spark, validation.canonical_predicate(F.lit(raw))) == want


def test_signal_id_ignores_form_and_order(spark):
    schema = "k INT, statement STRING, evidence ARRAY<STRUCT<document_id STRING, page INT, sheet STRING, cell_range STRING, char_start INT, char_end INT, quote STRING>>"
    a, b = ("d1", 1, None, None, None, None, "ﬁne"), ("d2", 2, None, None, None, None, "q")
    df = spark.createDataFrame([(1, "Some  Text", [a, b]), (2, "some text", [b, (*a[:6], "fine")]), (3, "some text", [a])], schema)
    got = {r.k: r.id for r in hypotheses.signal_ids(df).collect()}
    assert got[1] == got[2] != got[3]


def test_unit_mentions_like_the_pattern(spark):
    """Against the two patterns in Python, and each text is searched once a pattern."""
    import re

    from factweave.functions import units as U

    letters = "[а-яёА-ЯЁa-zA-Z°/%²³]+"
    texts = [
        "at 12,5 mg/L and 3–4\t%, 5 -6,50 °C; 7\n%", "1.2.3 kg 4,5,6т 7 — 8 мг в сутки 9 mg per day", "line 3: 40", "0,50г/м³ 10-20-30 m 1e5 x2 кг/т", "", None,
        "5 тонн, 6 килограмм 7 Мегапаскалей 8 %% 9 - 9 Percent",
    ]
    show = lambda t: str(int(t)) if t == int(t) else repr(t)
    value = lambda t: show(float(t.replace(",", ".")))
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", U.unit_mentions(F.col("t")).alias("m")).collect()}
    for text in texts:
        if text is None:
            assert got[text].m is None
            continue
        s = re.sub(r"\b(мг|mg)\s+(?:в\s+сутки|в\s+день|per\s+day)\b", r"\1/day", text, flags=re.I)
        want = [(value(n), u) for n, u in re.findall(rf"(\d+(?:[.,]\d+)?)\s*({letters})", s)]
        for a, b, u in re.findall(rf"(\d+(?:[.,]\d+)?)\s*[–—-]\s*(\d+(?:[.,]\d+)?)\s*({letters})", s):
            want += [(value(a), u), (value(b), u)]
        assert [(m.number, m.unit) for m in got[text].m] == want
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(U.unit_mentions(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("regexp_extract_all") == 2
