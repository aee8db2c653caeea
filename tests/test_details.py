"""Prices in text, brands in order, furniture of pages, filters of a view."""

from bidloom.functions import prices, text
from bidloom.operators import documents, matching, views
from pyspark.sql import functions as F

PRICES = [
    ("Positionsnetto 80,00 480,00\nEP 1,00", (80.0, 480.0)),
    ("Positionsnetto 480,00", (None, 480.0)),
    ("Positionsnetto", (None, None)),
    ("EP 1.234,50 GP 2.469,00", (1234.5, 2469.0)),
    ("Einzelpreis: 12", (12.0, None)),
    ("Gesamtpreis 3,5", (None, 3.0)),  # money has two decimals
    ("  1,00 2,00 3,00", (1.0, 2.0)),
    ("-7,00 Rohr 9,00", (None, 7.0)),
    ("Rohr 7,00", (None, None)),
    ("", (None, None)),
    (None, (None, None)),
]
BASES = [("Einzelpreis je 100 St", (True, 100.0)), ("(per 1.000m)", (True, 1000.0)), ("Preis je ???", (True, None)), ("EUR/10 und EP pro 10", (True, 10.0)), ("EUR/10 und EP pro 100", (True, None)), ("EP je 0", (True, None)), ("super 5", (False, None)), (None, (False, None))]


def test_stated_prices_and_bases(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, t string").select("i", prices.stated_prices(F.col("t")).alias("p"))
    assert {r.i: tuple(r.p) for r in d.collect()} == {i: want for i, (_, want) in enumerate(PRICES)}
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BASES)], "i int, t string").select("i", prices.stated_basis(F.col("t")).alias("b"))
    assert {r.i: tuple(r.b) for r in d.collect()} == {i: want for i, (_, want) in enumerate(BASES)}


def test_an_earlier_brands_alias_wins(spark):
    registry = spark.createDataFrame([("Acme", "A", 1, 0), ("Nova", "A", 1, 1), ("Nova", "N", 2, 0), ("Nova GmbH", "N", 2, 0)], "name string, brand string, brand_seq int, kind int").withColumn("key", text.brand_key(F.col("name")))
    names = spark.createDataFrame([("ACME AG",), ("nova",), ("Other",), ("",), (None,)], "name string")
    got = {r.name: (r.brand, r.confidence) for r in matching.resolve_brand(names, "name", registry).collect()}
    assert got == {"ACME AG": ("A", "EXACT"), "nova": ("A", "ALIAS"), "Other": ("unknown:other", "UNKNOWN"), "": ("unknown:empty", "UNKNOWN"), None: ("unknown:empty", "UNKNOWN")}


def test_furniture_of_one_document(spark):
    body = "\n".join(f"body {i}" for i in range(12))
    pages = [("d", 1, f"Kopf  (A)\n{body}\nSeite"), ("d", 2, f"kopf a\n{body} x\nSeite"), ("d", 3, None), ("e", 1, "Kopf a\nSeite\nSeite")]
    got = {(r.document, r.line, r.n_pages) for r in documents.page_furniture(spark.createDataFrame(pages, "document string, page int, content string")).collect()}
    assert ("d", "kopf a", 2) in got and ("d", "seite", 2) in got and ("d", "body 0", 2) in got and ("d", "body 7", 2) not in got and not any(d == "e" for d, _, _ in got)


def test_filters(spark):
    positions = spark.createDataFrame([(1, "1.1", "Rohr", True), (2, "1.2", "Bogen", None), (3, "2.1", None, False)], "position_id int, number string, description string, selected boolean")
    lines = spark.createDataFrame([(1, "S", "Stahlrohr", "A-1"), (2, "T", None, None), (2, "S", "Knie", "A-2")], "position_id int, supplier string, description string, article string")
    warned = spark.createDataFrame([(2,), (2,)], "position_id int")
    left = lambda *f: sorted(r.position_id for r in views.searched_positions(positions, lines, warned, *f).collect())
    assert left("", None, "ALL") == [1, 2, 3] and left(" STAHL", None, "ALL") == [1] and left("a-2", None, "ALL") == [2] and left("", "T", "ALL") == [2]
    assert left("", None, "SELECTED") == [1] and left("", None, "UNSELECTED") == [2, 3] and left("", "S", "WARNINGS") == [2] and left("none", None, "ALL") == []


def test_versioned_changes(spark):
    from bidloom.operators import keyed

    rows = spark.createDataFrame([(1, 3, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, None)], "k int, version int, v string")
    changes = [(1, 1, 2, "UPDATE", "x"), (1, 2, 3, "UPDATE", "y"), (1, 3, 3, "UPDATE", "z"), (2, 4, 1, "DELETE", None), (3, 5, 0, "INSERT", "n"), (9, 6, 0, "INSERT", "new"), (8, 7, 1, "UPDATE", "q"), (4, 8, None, "UPDATE", "q"), (7, 9, 1, "INSERT", "q")]
    after, told = keyed.versioned_changes(rows, spark.createDataFrame(changes, "k int, seq int, expected int, action string, v string"), "k", "v")
    assert sorted(map(tuple, after.collect())) == [(1, 4, "y"), (3, 1, "c"), (4, 2, None), (9, 1, "new")]
    assert {r.seq: (r.outcome, r.actual) for r in told.collect()} == {1: ("CONFLICT", 3), 2: ("DONE", None), 3: ("CONFLICT", 3), 4: ("DONE", None), 5: ("CONFLICT", 1), 6: ("DONE", None), 7: ("MISSING", 0), 8: ("CONFLICT", 2), 9: ("CONFLICT", 0)}
    empty, none = keyed.versioned_changes(rows.limit(0), spark.createDataFrame([], "k int, seq int, expected int, action string, v string"), "k", "v")
    assert empty.count() == none.count() == 0
