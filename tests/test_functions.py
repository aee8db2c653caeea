"""Scalar functions on small tables of cases."""

import pytest
from bidloom.functions import geometry, numbers, references, text
from pyspark.sql import functions as F


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (references.normalize_reference, {"01.002.003.004": "1.2.3.4", "01.020": "1.20", "1.2.10-1.2.30": "1.2.10-30", "1.2.10-2.3.30": None, "Artikel 1.2.10": None, "1-2-3": "1.2.3", " 2.3.10. ": "2.3.10", "7": None, "": None, None: None, "1.2.10 – 30": "1.2.10-30", "1 2 3": "1.2.3"}),
        (numbers.german_number, {"1.234,56": 1234.56, "1,234.56": 1234.56, "1.234": 1.234, "1.234.567": 1234567.0, "12,5 €": 12.5, "-3,5": -3.5, "": None, "abc": None, None: None, "1,2,3": None, "5": 5.0, "1.2,3,4": None}),
        (numbers.strict_number, {"1.234": 1234.0, "1.234,5": 1234.5, "x": None, None: None}),
        (numbers.quantity_number, {"1.234": 1234.0, "2.5": 2.5, "3,5": 3.5, None: None}),
        (numbers.price_basis, {"12,00 per 100": "100", "je 10 pro 100": "unreadable", "12,00": "1", "per 7": "unreadable", None: "1"}),
        (text.canonical_unit, {"St.": "piece", "Stück": "piece", "LFM": "meter", "kg": "kilogram", "psch": "psch", "": None, None: None}),
        (text.match_normalize, {"Ärger, groß!": "arger groß", "  A--b ": "a b", None: ""}),
        (text.type_identifier, {"Ventil Typ: AB 12 Fabrikat X": "AB 12", "kein": None}),
        (text.article_number, {"Rohr Art.-Nr.: AB-1234 x": "AB-1234", "Rohr": None, None: None}),
        (text.date_hints, {"vom 3.10.2024, 3.10.2024 und 24/12/24": ["3.10.2024", "24/12/24"], "45.13.2024": [], "1.1.24 2.1.24 3.1.24 4.1.24 5.1.24 6.1.24": ["1.1.24", "2.1.24", "3.1.24", "4.1.24", "5.1.24"], None: []}),
        (text.collapse_repeats, {"a\na\nb b c": "a\nb c", None: ""}),
        (text.initials, {"Müller & Söhne GmbH": "MS", "": ""}),
    ],
)
def test_cases(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_diameters_and_attributes(spark):
    found = apply(spark, text.nominal_diameters, ["DN 25 und 1/2 Zoll", 'Muffe 1"', "1 1/4 Anschluss", "nichts", None])
    assert [sorted(x) for x in found] == [[15, 25], [25], [32], [], []] or sorted(found[0]) == [15, 25]
    df = spark.createDataFrame([("DN 20", "Rohr DN 20"), ("DN 20", "Rohr 1/2 Zoll"), ("rot", "Ein ROTES Rohr"), ("blau", "Rohr")], "a string, b string")
    assert [r[0] for r in df.select(text.attribute_match(F.col("a"), F.col("b"))).collect()] == ["MATCH", "MISMATCH", "MATCH", "UNRESOLVED"]


def test_references_and_versions(spark):
    df = spark.createDataFrame([("1.2.10-30",), (None,), ("1.9",)], "v string")
    assert [tuple(r.x) if r.x else None for r in df.select(references.parse_reference(F.col("v")).alias("x")).collect()] == [("1.2", 10, 30), None, ("1", 9, 9)]
    assert [r.v for r in spark.createDataFrame([("1.10.2",), ("1.9.3",), ("1.9",)], "v string").orderBy(references.version_key(F.col("v"))).collect()] == ["1.9", "1.9.3", "1.10.2"]


def test_tolerances(spark):
    row = spark.range(1).select(
        numbers.prices_close(F.lit(3.0), F.lit(100.0), F.lit(300.0)).alias("a"), numbers.prices_close(F.lit(3.0), F.lit(100.0), F.lit(400.0)).alias("b"), numbers.prices_close(F.lit(3.0), F.lit(100.0), F.lit(3.0), F.lit(100)).alias("c"), numbers.prices_close(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0)).alias("d"),
        numbers.cents(F.lit(-0.125)).alias("e"), numbers.quantity_close(F.lit(100.0), F.lit(101.0)).alias("f"), numbers.token_cost(F.lit(1_000_000), F.lit(0), F.lit(1_000_000)).alias("g"),
    ).first()
    assert tuple(row) == (True, False, True, False, -0.12, True, 35.0)


def test_money_and_quantities(spark):
    assert apply(spark, numbers.money_values, ["2 x 1.234,50 = 2.469,00", "none"]) == [[1234.5, 2469.0], []]
    got = apply(spark, numbers.quantity_with_unit, ["12,5 m Rohr", "3 Stk und 4 Stk", "ohne"])
    assert tuple(got[0]) == (12.5, "m") and got[1] is None and got[2] is None


def test_boxes(spark):
    m = F.array(*(F.lit(float(v)) for v in (10, 0, 0, 10, 60, 780)))
    box = spark.range(1).select(geometry.from_transform(m, F.lit(60.0), F.lit(600.0), F.lit(800.0)).alias("b")).select("b", geometry.is_valid(F.col("b")).alias("ok"), geometry.pad(F.col("b"), 0.1).alias("p")).first()
    assert (round(box.b.x, 6), round(box.b.y, 6), round(box.b.width, 6), round(box.b.height, 6), box.ok) == (0.1, 0.0125, 0.1, 0.0125, True)
    assert box.p.x == 0 and box.p.y == 0


def test_german_format(spark):
    assert apply(spark, numbers.german_format, [1234.5, 1234.0, 0.05, -1234567.891, 100.0, None], "double") == ["1.234,5", "1.234", "0,05", "-1.234.567,89", "100", "—"]


def test_german_number_names_its_text_once(spark):
    raw = ["1.234,50", "1,234.50", "1.234.567", "12.5", "1,2,3", "EUR -7,00", "", None, "x", "+.5", "5.", ",5", "1.000,", "--1"]
    d = spark.createDataFrame([(r,) for r in raw], "raw string").select(numbers.german_number(F.col("raw")).alias("n"))
    assert [r.n for r in d.collect()] == [1234.5, 1234.5, 1234567.0, 12.5, None, -7.0, None, None, None, 0.5, 5.0, 0.5, 1000.0, None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("[^0-9,.") <= 1
