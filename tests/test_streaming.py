"""Streams over files, in several batches, against their batch forms."""

import datetime as dt

from factweave.operators import logs
from factweave.streaming import streams as R


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_intake_over_batches_and_replay(spark, tmp_path):
    schema, source = "id BIGINT, text STRING", tmp_path / "in"
    log = R.BatchLog(spark, str(tmp_path / "log"), R.FIRST_SEEN)
    assert R.first_seen(log).count() == 0
    run = R.intake_batch(log, "id")
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")], [(6, None), (7, "")]):
        write(spark, rows, schema, source)
        R.run_available(R.read_stream(spark, schema, str(source)), str(tmp_path / "work"), run)
    want = [(1, 1), (3, 1), (5, 0), (6, 1)]
    seen = lambda without=(): sorted((r.first_id, r.duplicates) for r in R.first_seen(log, without).collect())
    assert seen() == want
    # A batch again, as after a lost driver; and one that never was.
    run(spark.createDataFrame([(4, "b"), (5, "c")], schema), 1)
    assert seen() == want and seen((0,)) == [(4, 0), (5, 0), (6, 1)]


def test_upsert_and_rollback(spark, tmp_path):
    log = R.BatchLog(spark, str(tmp_path / "t"), "id STRING, label STRING, seq BIGINT")
    run = R.upsert_batch(log, "id", ["seq"])
    run(spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "id STRING, label STRING, seq BIGINT"), 0)
    run(spark.createDataFrame([("a", "z", 3), ("b", "n", 4)], "id STRING, label STRING, seq BIGINT"), 1)
    run(spark.createDataFrame([("b", "m", 1)], "id STRING, label STRING, seq BIGINT"), 2)
    rows = lambda without=(): {(r.id, r.label, r.created_by) for r in R.latest_rows(log, "id", ["seq"], without).collect()}
    assert rows() == {("a", "z", "batch-0"), ("b", "m", "batch-1")}
    assert rows((1,)) == {("a", "y", "batch-0"), ("b", "m", "batch-2")} and rows((1, 2)) == {("a", "y", "batch-0")}


def test_view_of_batches_is_the_whole_view(spark, tmp_path):
    log = R.BatchLog(spark, str(tmp_path / "v"), R.VIEW)
    run = R.view_batch(log, "k", "v", "ts", "item")
    rows = [(f"k{i % 3}", i / 7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 40) for i in range(300)]
    for b in range(3):
        run(spark.createDataFrame(rows[b * 100 : b * 100 + 100], "k STRING, v DOUBLE, ts TIMESTAMP, item BIGINT"), b)
    run(spark.createDataFrame(rows[100:200], "k STRING, v DOUBLE, ts TIMESTAMP, item BIGINT"), 1)
    got = {r.key: r for r in R.view(log).collect()}
    for k in range(3):
        mine = rows[k::3]
        assert (got[f"k{k}"].rows, got[f"k{k}"].latest) == (100, mine[-1][2]) and abs(float(got[f"k{k}"].amount) - sum(r[1] for r in mine)) < 1e-3
        assert abs(got[f"k{k}"].distinct_items - len({r[3] for r in mine})) <= 2


def test_copies_fall_within_the_watermark(spark, tmp_path):
    schema, source = "id BIGINT, ts TIMESTAMP, text STRING", tmp_path / "in"
    day = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(([(0, "a"), (1, "a"), (1, "b")], [(2, "b"), (3, "c")], [(4, "c")])):
        write(spark, [(10 * i + j, day + dt.timedelta(minutes=m), t) for j, (m, t) in enumerate(rows)], schema, source)
        out = R.run_available(R.dedup_within_watermark(R.read_stream(spark, schema, str(source)), "ts", "1 hour"), str(tmp_path / "work"))
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_late_rows_fall_to_the_watermark(spark, tmp_path):
    schema, source = "id BIGINT, ts TIMESTAMP, schema_name STRING, value DOUBLE, outcome STRING, tokens INT", tmp_path / "in"
    day = dt.datetime(2024, 1, 1)
    for i, hours in enumerate(([0, 1], [30], [2, 31], [60])):
        write(spark, [(i * 10 + j, day + dt.timedelta(hours=h), "s", 1.0, "success", 1) for j, h in enumerate(hours)], schema, source)
        live = R.windowed_metrics(R.read_stream(spark, schema, str(source)), "ts", "schema_name", "value", "1 day", "1 hour")
        out = R.run_available(live, str(tmp_path / "work"))
    got = {r.window_start.day: r.calls for r in spark.read.parquet(out).collect()}
    assert got[1] == 2  # the row of hour 2 came after its day was closed


def test_throttle_in_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    seconds = [(0, False), (10, False), (20, False), (25, True), (30, False), (40, False), (50, False), (2000, False)]
    rows = [(i, "k", t0 + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate(seconds)]
    df = spark.createDataFrame(rows, "id BIGINT, key STRING, ts TIMESTAMP, success BOOLEAN")
    got = {r.id: r.retry_after for r in logs.throttle(df, 3, 900).collect()}
    assert got == {0: None, 1: None, 2: 880, 4: None, 5: None, 6: 880, 7: None}
