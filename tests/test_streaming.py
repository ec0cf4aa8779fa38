from datetime import datetime as D

from lorespan.streaming import jobs


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def events(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(folder)
    return jobs.event_stream(spark, folder, "ts timestamp, event_type string, value double")


def test_day_counts_are_final_behind_the_watermark(spark, tmp_path):
    rows = [(D(2025, 1, 1, h), "a", 1.0) for h in range(3)] + [(D(2025, 1, 10), "a", 1.0)]
    got = run(spark, jobs.day_counts(events(spark, str(tmp_path / "in"), rows)), "days")
    assert [(r.day, r.events) for r in got] == [(D(2025, 1, 1), 3)]


def test_trailing_groups(spark, tmp_path):
    rows = [(D(2025, 1, 1), "a", 2.0), (D(2025, 1, 3), "a", 3.0), (D(2025, 2, 1), "a", 1.0)]
    got = {r.began: (r.events, r.value) for r in run(spark, jobs.trailing_groups(events(spark, str(tmp_path / "in"), rows)), "spans")}
    assert got[D(2025, 1, 1)] == (2, 5.0) and got[D(2024, 12, 26)] == (1, 2.0)


def test_queue_writes_each_batch_once(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), [(D(2025, 1, 1), "a", 2.0)])
    for _ in range(2):
        jobs.run_queue(stream, lambda batch, n: batch.selectExpr("event_type", "value * 2 AS done"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.done for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [4.0]


def test_gate_counts_and_cools_down(spark, tmp_path):
    rows = [(D(2025, 1, 1, h), "a", 1.0) for h in range(5)] + [(D(2025, 1, 2, 1), "a", 1.0), (D(2025, 1, 2, 2), "a", 1.0), (D(2025, 1, 2, 3), "b", 1.0)]
    got = run(spark, jobs.gate(events(spark, str(tmp_path / "in"), rows), ["event_type"], "ts", 3, 24), "gate")
    assert sorted((r.event_type, r.at, r.waiting) for r in got) == [("a", D(2025, 1, 1, 2), 3), ("a", D(2025, 1, 2, 2), 7)]
