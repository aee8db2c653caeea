"""Operators against loops over small random inputs, and sources and streaming end to end."""

import random

import pytest
from bidloom.operators import keyed, matching, sequences
from bidloom.sources import tables
from bidloom.streaming import decisions
from pyspark.sql import functions as F


def test_anchored_islands_equal_a_loop(spark):
    draw = random.Random(1)
    rows, want = [], set()
    for key in range(150):
        lines = [(key, s, draw.random() < 0.7, draw.random() < 0.6, draw.random() < 0.6) for s in range(draw.randrange(1, 9))]
        a = draw.randrange(len(lines))
        rows += [(*line, line[1] == a) for line in lines]
        own, s = {a}, a - 1
        while s >= 0 and all(lines[s][2:]):
            own.add(s)
            s -= 1
        s = a + 1
        while s < len(lines) and lines[s][2] and not (lines[s][3] and not lines[s][4]):
            own.add(s)
            s += 1
        want |= {(key, x) for x in own}
    df = spark.createDataFrame(rows, "k int, seq int, same boolean, has boolean, m boolean, anchor boolean")
    got = sequences.anchored_islands(df, ["k"], "seq", F.col("anchor"), F.col("same"), F.col("has"), F.col("m"))
    assert {(r.k, r.seq) for r in got.collect()} == want


def test_cheapest_tie_and_single(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.004), (2, 1, 5.0), (3, 1, 1.0), (3, 2, 3.0)], "p int, o int, t double")
    got = {r.p: (r.o, r.is_unique, r.saving) for r in matching.cheapest(df, "p", "o", "t").collect()}
    assert got == {1: (1, False, 0.0), 2: (1, True, None), 3: (1, True, 2.0)}


def test_scope_ladder_truth_table(spark):
    df = spark.createDataFrame(
        [("NOT_COVERED", "X", True, True, True, True, True), ("COVERED_WITHOUT_OFFER", "X", True, True, True, True, True), ("PRESENT", "CONFIRMED_DEVIATION", True, True, True, True, True), ("PRESENT", "OK", False, True, True, True, True), ("PRESENT", "OK", True, True, False, True, True), ("PRESENT", "UNRESOLVED", True, True, True, True, True), ("PRESENT", "OK", True, False, True, True, True), ("PRESENT", "OK", True, True, None, True, True), ("PRESENT", "OK", True, True, True, True, False), ("PRESENT", "OK", True, True, True, True, True)],
        "a string, t string, s boolean, p boolean, q boolean, u boolean, x boolean",
    )
    got = [r[0] for r in df.select(matching.scope_status(*map(F.col, "atspqux"))).collect()]
    assert got == ["NOT_COVERED", "UNKNOWN", "TECHNICALLY_DEVIATING", "PARTIAL_MATERIAL_SCOPE", "PARTIAL_MATERIAL_SCOPE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "COMPLETE_MATERIAL_SCOPE"]


def test_live_status_and_backtest_ladders(spark):
    df = spark.createDataFrame([("SELECTED", True, 0), (None, True, 0), (None, False, 0), (None, False, 2)], "d string, e boolean, n int")
    assert [r[0] for r in df.select(matching.live_status(F.col("d"), F.col("e"), F.lit(True), F.lit(False), F.col("n"), F.lit(False))).collect()] == ["MANUAL_DECIDED", "PROCESSING_ERROR", "NO_COMPARABLE_OFFER", "MANUAL_DECISION_REQUIRED"]
    b = spark.createDataFrame([(None, 0, True, 1.0, 1, 1), (None, 2, True, 1.0, 1, 1), (None, 2, True, 1.0, 2, 1), (None, 2, False, None, None, None), ("DEFERRED", 2, True, 1.0, 1, 1), (None, 2, False, 1.0, None, None)], "d string, p int, a boolean, h double, m int, s int")
    got = [r[0] for r in b.select(matching.backtest(*map(F.col, "dpahms"), F.lit(False))).collect()]
    assert got == ["NO_OFFER", "AUTO_CONFIRMED_BY_HISTORY", "AUTO_LOWEST_BUT_HISTORY_DIFFERS", "HISTORICAL_EK_UNRESOLVED", "MANAGER_PENDING", "NOT_COMPARABLE"]


def test_link_kinds_and_reachability_with_cycles(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (2, 2)], "b int, o int")
    assert [r[0] for r in df.select(matching.link_kind(F.col("b"), F.col("o"))).collect()] == ["ONE_TO_ONE", "MANY_TO_ONE", "ONE_TO_MANY", "MANY_TO_MANY"]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r.start, r.node, r.depth) for r in keyed.reachable(edges, spark.createDataFrame([(1,)], "node long"), 10).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.pdf").write_bytes(b"one")
    (tmp_path / "in/b.pdf").write_bytes(b"two")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    files = tables.document_files(spark, str(tmp_path / "in"))
    assert files.count() == 2 and all(len(r.document_id) == 16 for r in files.collect())
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.append_immutable(None, old, str(tmp_path / "t"), ["k"], ["v"])
    tables.append_immutable(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t"), ["k"], ["v"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        tables.append_immutable(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(1, "x")], "k int, v string"), str(tmp_path / "t"), ["k"], ["v"])
    detected = spark.createDataFrame([(1, "x", "LOW"), (2, "y", "LOW")], "id int, kind string, confidence string")
    got = tables.overlay(detected, spark.createDataFrame([(1, "z")], "id int, kind string"), "id", ["kind"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "z", "OPERATOR"), (2, "y", "LOW")]


def test_page_modes_and_packages(spark):
    item = lambda n: [("i", "r", "x" * n, 0, None)]
    pages = spark.createDataFrame([("d", 1, 1.0, 1.0, 0, item(90)), ("d", 2, 1.0, 1.0, 1, item(90)), ("d", 3, 1.0, 1.0, 1, item(5)), ("d", 4, 1.0, 1.0, 0, [])], tables.PARSED_PAGE)
    assert [r.mode for r in tables.page_modes(pages).orderBy("page_number").collect()] == ["DIGITAL", "HYBRID", "SCAN", "UNREADABLE"]
    assert '"page_number":4' in tables.package_json(pages, ["page_number"]).filter("page_number = 4").first().package


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = decisions.deduplicated(decisions.event_stream(spark, source))
    decisions.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    decisions.run_available(decisions.windowed_counts(decisions.event_stream(spark, source)), str(tmp_path / "w"), str(tmp_path / "cw"))
    closed = spark.read.parquet(str(tmp_path / "w"))
    assert closed.count() > 0 and closed.agg(F.sum("n")).first()[0] <= events.count()
    got = {r.user_id: r.event_id for r in decisions.latest(events).collect()}
    want = {r.user_id: r.event_id for r in keyed.last_wins(events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).collect()}
    assert got == want


def test_pages_number_rows_over_many_partitions(spark):
    from bidloom.operators.sequences import pages_of

    rows = spark.range(1000).repartition(7).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("wide"))
    got = pages_of(rows, [F.desc("k")], 30).collect()
    assert sorted((r.row_number, r.k, r.page) for r in got) == [(i + 1, 999 - i, i // 30 + 1) for i in range(1000)]


def test_new_documents_are_processed_alone_unless_a_basis_is_new(spark):
    from bidloom.operators.views import documents_to_process

    docs = spark.createDataFrame([(1, 1, False), (1, 2, False), (2, 3, False), (2, 4, True), (3, 5, False), (4, 6, True)], "p int, d int, basis boolean")
    done = spark.createDataFrame([(1, 1), (2, 3), (4, 6), (4, 6)], "p int, d int")
    got = {(r.p, r.d): r.incremental for r in documents_to_process(docs, done, "p", "d", "basis").collect()}
    assert got == {(1, 2): True, (2, 3): False, (2, 4): False, (3, 5): False, (4, 6): False}


def test_a_document_is_searched_once_for_each_pattern(spark):
    from bidloom.operators import documents

    d = spark.createDataFrame([("Angebot Angebotsposition 10 LVNR 1.2.3", 90, 0, 1, 1), (None, 90, 0, 1, 1)], "text string, chars int, ocr_chars int, pages_with_text int, pages int")
    found = documents.classified(d, "text", [("A", ["Alpha"])])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Angebotsposition") == 1
    assert [(r.document_type, r.n_positions, r.signals) for r in found.collect()][0] == ("UNKNOWN", 0, ["Angebot", "Preisstruktur"])


def test_levels_of_a_closure_are_not_sent_through_the_driver(spark, monkeypatch):
    from bidloom.operators import keyed

    plans, cut = [], keyed.cut
    monkeypatch.setattr(keyed, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    got = sorted(tuple(r) for r in keyed.reachable(edges, spark.createDataFrame([(1,)], "node long"), 9).select("start", "node", "depth").collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_best_versions_carry_only_what_is_kept(spark):
    from bidloom.operators import evidence

    d = spark.createDataFrame([("a", 1, ["e"]), ("a", 3, ["e", "e"]), ("a", 2, ["e", "e"]), ("b", 5, [])], "k string, seq long, proof array<string>")
    got = evidence.best_versions(d, "k", "proof", "seq", ["seq"])
    assert got.columns == ["k", "seq", "occurrences"] and sorted(map(tuple, got.collect())) == [("a", 2, 3), ("b", 5, 1)]
    assert evidence.best_versions(d, "k", "proof", "seq").columns == ["k", "seq", "proof", "occurrences"]
