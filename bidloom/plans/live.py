"""Streams over given tables, run until all that is there is read."""

from __future__ import annotations

import uuid

from bidloom.plans.logs import LEGAL
from bidloom.plans.registry import ORACLES, QUERIES
from bidloom.sources.lineage import shared_folder
from bidloom.streaming import decisions, runs


def live_transitions(spark, sf_dir):
    """The illegal transitions of the event log, found by the live state machine; as the check of the finished log finds them."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events}}.parquet")
    found = runs.transitions(stream, "user_id", "ts", "event_id", "event_type", LEGAL)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, runs.STATE_STORE)
    try:
        decisions.run_available(found, f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(runs.OUTPUT).parquet(f"{folder}/out").selectExpr("event_id", "previous", "status as event_type")


QUERIES["live_transitions"] = live_transitions
ORACLES["live_transitions"] = ORACLES["transition_check"]
