"""Streams over small folders."""

import datetime as dt

from pyspark.sql import functions as F

from kilnwork.streaming import ledger


def events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), i % 3, "purchase" if i % 5 == 0 else "view", float(i)) for i in range(40)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows + rows[:4], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(path)
    return path


def test_streams(spark, tmp_path):
    path = events(spark, tmp_path)
    s = ledger.read(spark, path)
    assert ledger.run(ledger.tumbling(s, "1 hour", ["event_type"]), "complete").agg(F.sum("n")).first()[0] == 44
    assert ledger.run(ledger.distinct(ledger.read(spark, path), ["event_id"], "30 days")).count() == 40
    out = ledger.run(ledger.latest_rounds(ledger.read(spark, path).select("user_id", "event_type", "ts"), "user_id", "event_type", "purchase"), "update", ["user_id"])
    assert out.count() == 3


def test_update_keeps_keys_of_earlier_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "many.parquet")
    for k, users in enumerate(((1, 2), (2, 3), (4,))):
        rows = [(u, base + dt.timedelta(days=k), "purchase" if k == 0 else "view") for u in users]
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(path)
    s = ledger.read(spark, path, files=1)
    got = {r["user_id"]: r for r in ledger.run(ledger.latest_rounds(s, "user_id", "event_type", "purchase"), "update", ["user_id"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[2]["last_any"] == base + dt.timedelta(days=1) and got[2]["last_evidence"] == base and got[3]["last_evidence"] is None
    n = ledger.run(ledger.tumbling(ledger.read(spark, path, files=1).withColumn("value", F.lit(1.0)), "1 day", ["event_type"]), "complete")
    assert n.agg(F.sum("n")).first()[0] == 5


def test_rollup_levels(spark, tmp_path):
    df = spark.read.parquet(events(spark, tmp_path))
    got = ledger.rollup(df)
    assert got.where("level = 3").first()["n"] == 44 and got.where("level = 0").agg(F.sum("n")).first()[0] == 44
