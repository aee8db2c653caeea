"""The live state machine against the check of the finished log."""

from datetime import datetime, timedelta

import pytest
from bidloom.operators import keyed
from bidloom.plans.logs import LEGAL
from bidloom.streaming import runs
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, runs.STATE_STORE)
    yield
    spark.conf.unset(key)


def run(spark, stream, sink, checkpoint):
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return query


def test_batches_give_the_rows_of_the_finished_log(spark, store, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 40")
    want = sorted((r.event_id, r.previous, r.event_type) for r in keyed.illegal_transitions(events, "user_id", ["ts", "event_id"], "event_type", LEGAL).collect())
    folder = str(tmp_path / "in")
    for batch in range(4):  # in order of time; the third batch is sent twice
        part = events.withColumn("b", F.ntile(4).over(Window.orderBy("ts", "event_id"))).filter(F.col("b") == batch + 1).drop("b")
        for again in range(2 if batch == 2 else 1):
            part.coalesce(1).write.mode("append").parquet(folder)
            stream = runs.transitions(spark.readStream.schema(events.schema).parquet(folder), "user_id", "ts", "event_id", "event_type", LEGAL)
            run(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert want and sorted((r.event_id, r.previous, r.status) for r in got.collect()) == want and {r.kind for r in got.collect()} == {"ILLEGAL"}


def test_silent_runs_and_nulls(spark, store, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "k long, ts timestamp, id long, s string"
    folder = str(tmp_path / "in")
    told = []
    for rows in ([(1, at(0), 1, "a"), (2, at(0), 2, "a"), (1, None, 3, "b"), (1, at(1), 4, None)], [(2, at(50), 5, "b"), (2, at(50), 5, "b")], [(2, at(100), 6, "b"), (3, at(99), 7, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = runs.transitions(spark.readStream.schema(schema).parquet(folder), "k", "ts", "id", "s", [("a", "b")], timedelta(minutes=60))
        run(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
        told.append(sorted((r.key, r.kind, r.previous, r.status) for r in spark.read.schema(runs.OUTPUT).parquet(str(tmp_path / "out")).collect()))
    assert told[-1] == [(1, "STALLED", "a", None), (2, "ILLEGAL", "b", "b")]
