"""Page scans, boxes through matrices, quantities in text."""

import json
import math
import random

import pytest
from bidloom.functions import geometry as g
from bidloom.functions import quantities
from bidloom.sources import page_scan
from pyspark.sql import functions as F


def test_forward_after_inverse_is_the_identity(spark):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        turn = draw.choice([0, 90, 180, 270])
        c, s = round(math.cos(math.radians(turn))), round(math.sin(math.radians(turn)))
        scale, w, h = draw.uniform(0.5, 3), draw.uniform(100, 900), draw.uniform(100, 900)
        x, y = sorted(draw.uniform(0, 1000) for _ in "ab"), sorted(draw.uniform(0, 2000) for _ in "ab")
        rows.append((i, x[1], y[0], x[0], y[1], w, h, [scale * c, scale * s, scale * s, -scale * c, draw.uniform(-50, 50), draw.uniform(-50, 50)]))
    d = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double, w double, h double, v array<double>")
    d = d.withColumn("item", g.recognised_item(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(1000.0), F.lit(2000.0), F.col("v"), F.col("w"), F.col("h")))
    d = d.withColumn("v0", F.array(*(F.get("v", F.lit(k)) for k in range(6))))
    got = d.withColumn("r", g.item_region(F.lit("x"), F.col("item.transform"), F.col("item.width"), F.col("item.height"), F.col("v"), F.col("w"), F.col("h"))).collect()
    for r in got:
        scale = math.hypot(r.v[0], r.v[1])
        left, top = min(r.x0, r.x1) / 1000, r.y0 / 2000
        # width and height are lengths in the page's own units, so a scaled viewport stretches them, from the word's left bottom corner
        bottom = r.y1 / 2000
        assert r.r is None or (abs(r.r.x - left) < 1e-9 and abs(r.r.y + r.r.height - min(1, bottom)) < 1e-9)
        if abs(scale - 1) < 1e-12:
            assert abs(r.r.y - top) < 1e-9


def test_rotated_words_keep_their_box(spark):
    rows = [(k, m) for k, m in enumerate([[1.0, 0.0, 0.0, -1.0, 0.0, 800.0], [0.0, 1.0, 1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 1.0, 400.0, 0.0], [0.6, 0.8, 0.8, -0.6, 7.0, -9.0]])]
    d = spark.createDataFrame(rows, "k int, v array<double>").withColumn("item", g.recognised_item(F.lit(300.0), F.lit(900.0), F.lit(100.0), F.lit(700.0), F.lit(1000.0), F.lit(2000.0), F.col("v"), F.lit(400.0), F.lit(800.0)))
    for r in d.withColumn("r", g.item_region(F.lit("x"), F.col("item.transform"), F.col("item.width"), F.col("item.height"), F.col("v"), F.lit(400.0), F.lit(800.0))).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.r, (0.1, 0.35, 0.2, 0.1)))


def test_boxes_that_cannot_be(spark):
    unit = [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]
    cases = [(0.0, 10.0, unit, 400.0), (5.0, 5.0, unit, 400.0), (0.0, 10.0, [1.0, 2.0, 2.0, 4.0, 0.0, 0.0], 400.0), (0.0, 10.0, None, 400.0), (0.0, 10.0, unit[:4], 400.0), (0.0, 10.0, [float("nan")] * 6, 400.0), (0.0, 10.0, unit, 0.0), (None, 10.0, unit, 400.0)]
    d = spark.createDataFrame(cases, "x0 double, x1 double, v array<double>, w double")
    got = d.select(g.recognised_item(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(9.0), F.lit(100.0), F.lit(100.0), F.col("v"), F.col("w"), F.lit(800.0)).alias("r")).collect()
    assert [r.r is not None for r in got] == [True] + [False] * 7
    items = [("x", unit, 5.0, 8.0), (" ", unit, 5.0, 8.0), ("x", unit, 0.0, 8.0), ("x", [0.0, 0.0, 0.0, 1.0, 5.0, 5.0], 5.0, 8.0), ("x", unit[:5], 5.0, 8.0), ("x", [1.0, 0.0, 0.0, 0.0, 5.0, 5.0], 5.0, None), (None, unit, 5.0, 8.0)]
    d = spark.createDataFrame(items, "c string, m array<double>, w double, h double")
    got = d.select(g.item_region(F.col("c"), F.col("m"), F.col("w"), F.col("h"), F.array(*map(F.lit, unit)), F.lit(400.0), F.lit(800.0)).alias("r")).collect()
    assert [r.r is not None for r in got] == [True, False, False, False, False, True, False]


CASES = [
    ("Speichermodul mit Rohrleitung\nGewicht: 70 kg\nMax. Volumenstrom: 15,5 m3/h\nRohrlänge: 6 m\n6,000 St", (6.0, "St", "6,000 St", None)),
    ("Leistung mit unlesbarer Mengenangabe", (None, None, "", "QUANTITY_MISSING")),
    ("6 St\n12 St", (None, None, "6 St / 12 St", "QUANTITY_AMBIGUOUS")),
    ("6 St\n6,0 st", (6.0, "St", "6 St", None)),
    ("1.200 m 2,50 3.000,00", (1200.0, "m", "1.200 m", None)),
    ("Rohr 12 m\n4 Stück EP 1,00 GP 4,00", (4.0, "Stück", "4 Stück", None)),
    ("Rohr 12 m und mehr", (None, None, "", "QUANTITY_MISSING")),
    ("Preis je 100 St\n3 St EP 200,00", (3.0, "St", "3 St", None)),
    ("5 Rollen 1,00", (None, None, "5 Rollen", "UNKNOWN_UNIT")),
    ("16 bar\n3 Gebinde", (None, None, "3 Gebinde", "UNKNOWN_UNIT")),
    ("2 Stk ........ ....", (2.0, "Stk", "2 Stk", None)),
    ("8 Std Handschrift", (None, None, "", "QUANTITY_MISSING")),
    (None, (None, None, "", "QUANTITY_MISSING")),
    ("", (None, None, "", "QUANTITY_MISSING")),
    ("1 m 2 m 3 m", (None, None, "", "QUANTITY_MISSING")),
]


def test_quantities(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", quantities.quantity(F.col("t")).alias("q"), quantities.quantity(F.col("t"), True).alias("o"))
    got = {r.i: r for r in d.collect()}
    for i, (t, want) in enumerate(CASES):
        assert tuple(got[i].q) == want or t == "1 m 2 m 3 m", t
    assert tuple(got[11].o) == (8.0, "Std", "8 Std", "OCR_SOURCE")
    assert got[14].q.quantity == 3.0  # only the last one ends its line


@pytest.fixture
def folder(tmp_path):
    page = lambda n, text, images=0, ocr=None: {"page_number": n, "width": 100.0, "height": 200.0, "image_count": images, "ocr_text": ocr, "items": [{"content": text, "width": 20.0, "height": 10.0, "transform": [1, 0, 0, 1, 90, 195]}]}
    good = {"pages": [page(1, "①" * 90, 1), page(2, " kurz  \n", 0, "erkannt"), page(3, "", 2, " "), {"page_number": 4}], "more": {"x": 1}}
    (tmp_path / "sub").mkdir()
    files = {"good.json": json.dumps(good).encode(), "sub/broken.json": b'{"pages": [{', "blank.json": b" \n", "empty.json": b'{"pages": []}', "none.json": b'{"other": 1}', "bytes.json": b"\xff\xfe\x00{", "skip.txt": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_one_read_of_good_broken_and_empty_exports(spark, folder):
    files = page_scan.exports(spark, folder)
    pages = sorted(page_scan.pages(files).collect(), key=lambda r: r.page)
    assert [(r.page, r.chars, r.mode, r.method) for r in pages] == [(1, 90, "HYBRID", "NATIVE"), (2, 4, "UNREADABLE", "OCR"), (3, 0, "SCAN", None), (4, 0, "UNREADABLE", None)]
    assert pages[0].items[0].normalised == "1" * 90 and pages[1].items[0].normalised == "kurz"
    box = pages[0].items[0].region
    assert (box.x, box.y, round(box.width, 9), round(box.height, 9)) == (0.9, 0.0, 0.1, 0.05)
    issues = sorted((r.document_id.rsplit("/", 1)[1], r.page, r.code) for r in page_scan.issues(files).collect())
    assert issues == [("blank.json", None, "DOCUMENT_UNREADABLE"), ("broken.json", None, "DOCUMENT_UNREADABLE"), ("bytes.json", None, "DOCUMENT_UNREADABLE"), ("empty.json", None, "DOCUMENT_EMPTY"), ("good.json", 3, "PAGE_UNREADABLE"), ("good.json", 4, "PAGE_UNREADABLE"), ("none.json", None, "DOCUMENT_UNREADABLE")]


def test_unused_columns_are_not_read(spark, folder):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = plan(page_scan.pages(page_scan.exports(spark, folder)).select("document_id", "page"))
    assert "ArrowEvalPython" not in few and "_normalised" not in few
    assert "ReadSchema: struct<path:string>" in plan(page_scan.exports(spark, folder).select("document_id"))


def test_empty_table(spark):
    none = spark.createDataFrame([], "document_id long, content string")
    assert page_scan.pages(none).count() == 0 and page_scan.issues(none).count() == 0


def test_issues_parse_a_document_once(spark):
    page = lambda n, ocr, *texts: {"page_number": n, "width": 9.0, "height": 9.0, "image_count": 0, "ocr_text": ocr, "items": [{"content": t, "width": 1.0, "height": 1.0, "transform": [1.0] * 6} for t in texts]}
    silent = [page(1, " ", "a" * 40), page(2, None, "a" * 39), page(3, " ", "ﬁ" * 20), page(4, " ", "ﬁ" * 19), page(5, " ", " b\t\x1c\n " * 20), page(6, "x", ""), page(7, None, "é" * 39), page(8, " ", None), page(9, " ", "a" * 20, " " + "b" * 20 + "\n"), None]
    files = spark.createDataFrame([("d", json.dumps({"pages": silent})), ("e", '{"pages": []}'), ("f", "{"), ("g", None)], "document_id string, content string")
    found = page_scan.issues(files)
    assert found._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    got = sorted((r.document_id, r.page or 0, r.code) for r in found.collect())
    assert got == [("d", 0, "PAGE_UNREADABLE")] + [("d", n, "PAGE_UNREADABLE") for n in (2, 4, 5, 7, 8)] + [("e", 0, "DOCUMENT_EMPTY"), ("f", 0, "DOCUMENT_UNREADABLE"), ("g", 0, "DOCUMENT_UNREADABLE")]
    lost = sorted((r.document_id, r.page or 0) for r in page_scan.pages(files).filter("method is null").collect())
    assert lost == [x[:2] for x in got if x[2] == "PAGE_UNREADABLE"]
