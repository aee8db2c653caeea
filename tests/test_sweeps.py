"""Sweeps over pages, ranges as dyadic blocks, index lookups, orders: against loops."""

import random
import time

from bidloom.functions import text
from bidloom.operators import documents, matching, sequences
from pyspark.sql import functions as F


def test_ranges_of_any_width_meet_every_position_once(spark):
    draw = random.Random(1)
    ranges = [(i, draw.choice("ab"), *sorted((draw.randrange(80), draw.randrange(80)))) for i in range(60)] + [(900, "a", 0, 2**40), (901, "b", 7, 7), (902, "a", 2**40, 2**40 + 1), (903, "c", 0, 5), (904, "a", 9, 3), (905, None, 0, 9)]
    points = [(i, draw.choice("ab"), draw.randrange(90)) for i in range(120)] + [(500, "a", 2**40), (501, "a", 2**40 + 1), (502, None, 3)]
    b, o = spark.createDataFrame(points, "p int, prefix string, first long"), spark.createDataFrame(ranges, "o int, prefix string, low long, high long")
    got = sorted((r.p, r.o) for r in matching.reference_matches(b, o).collect())
    assert got == sorted((p, r) for p, a, x in points for r, c, lo, hi in ranges if a is not None and a == c and lo <= x <= hi)
    wide = o.filter("o = 900").select(F.size(matching._dyadic(F.col("low"), F.col("high"))).alias("n")).first().n
    assert wide <= 82
    assert matching.reference_matches(b, o.limit(0)).count() == 0 == matching.reference_matches(b.limit(0), o).count()


def overlap_loop(items, share=0.5):
    lines, out = [], {}
    for seq, y, x, h in sorted(items, key=lambda r: (r[1], r[2], r[0])):
        for k in range(len(lines) - 1, -1, -1):
            if any(min(b, y + h) - max(t, y) >= min(b - t, h) * share for t, b in lines[k]):
                break
        else:
            lines.append([])
            k = len(lines) - 1
        lines[k].append((y, y + h))
        out[seq] = k + 1
    return out


def test_overlapping_lines_equal_a_loop(spark):
    draw = random.Random(2)
    pages = {k: [(i, draw.randrange(0, 40) / 4, draw.random(), draw.choice([0.5, 1.0, 2.0, 6.0])) for i in range(draw.randrange(1, 60))] for k in range(25)}
    rows = [(k, *r) for k, items in pages.items() for r in items]
    got = sequences.overlapping_lines(spark.createDataFrame(rows, "k int, seq long, y double, x double, height double"), ["k"]).collect()
    assert {(r.k, r.seq): r.line for r in got} == {(k, s): n for k, items in pages.items() for s, n in overlap_loop(items).items()}


def test_pages_of_many_items_take_linear_time(spark):
    n = 60_000
    items = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") / 3).alias("y"), F.col("id").cast("double").alias("x"), F.lit(1.2).alias("height"))
    began = time.perf_counter()
    assert sequences.overlapping_lines(items, ["k"]).count() == n and sequences.clustered_lines(items.select("k", "seq", "y"), ["k"], 0.4).count() == n
    assert time.perf_counter() - began < 60


def test_medians_and_running_sums(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice([None, *range(9)])) for k in "aabbbbcccccd" for _ in range(3)] + [("e", None), ("f", 4)]
    got = {r.k: r.median for r in sequences.upper_median(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    values = {k: sorted(v for a, v in rows if a == k and v is not None) for k in "abcdef"}
    assert got == {k: v[len(v) // 2] for k, v in values.items() if v}
    sums = sequences.running_before(spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "o int, v int").repartition(5), [F.col("o")], "v", "before").orderBy("o").collect()
    total = 0
    for r in sums:
        assert r.before == total
        total += r.v


def test_mentions_of_missing_positions(spark):
    pages = spark.createDataFrame([("d", 3, "1.02. 3 und 1.2.3"), ("d", 1, "zu 1.2.3."), ("d", 2, "12.3"), ("e", 1, "1.2.3"), ("d", 4, None)], "document string, page int, content string")
    missing = spark.createDataFrame([(1, "01.2.3", "d"), (2, "1.2.4", "d"), (3, "1.2.3", "f"), (4, None, "d")], "position int, reference string, document string")
    got = documents.missing_but_mentioned(missing, documents.postings(pages, r"[0-9]+(?:\.\s?[0-9]+)+")).collect()
    assert [(r.position, r.document, r.pages) for r in got] == [(1, "d", [1, 3])]


def test_german_order(spark):
    names = ["Zange", "äpfel", "apfel", "Apfel", "Straße", "Strasse", "Straßen", "Öl", "ofen", "Teil 10", "Teil 9", "teil 9", "Teil 009a", ""]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in d.orderBy(text.german_order(F.col("n"))).collect()] == ["", "apfel", "Apfel", "äpfel", "ofen", "Öl", "Strasse", "Straße", "Straßen", "Teil 009a", "Teil 10", "teil 9", "Teil 9", "Zange"]
    numeric = [r.n for r in d.filter("n like '%eil%'").orderBy(text.german_order(F.col("n"), numeric=True)).collect()]
    assert numeric == ["teil 9", "Teil 9", "Teil 009a", "Teil 10"]
