"""Supplier layouts on small documents."""

from bidloom.operators.records import layouts, supplier_records, unsupported

DOCS = {
    "gc": ["POS 10 LVNR 02 01 0010 Pumpe", "ART1 Pumpe fein 4 ST 42,75 1,71", "per 100", "Zwischensumme 1,71", "noch Text", "POS 11 LVNR 2 1 10", "ART2 Zubehör 1 ST 5,00 5,00", "2 1 20-30 Bauseits", "2 1 40 siehe vorige Pos"],
    "pm": ["Angebotsposition 2.1.10", "1 A-1 3 Stück 100,00 300,00", "Ventil DN 20", "Optional bieten wir", "2 A-2 1 St 50,00 50,00", "Angebotsposition 2.1.20", "Diese Position können wir nicht anbieten."],
    "sp": ["7 zu LV-Pos.: 1.2.3", "12345678 2 ST 10,00 20,00", "Kundenrabatt 10", "Positionsnetto 9,00 18,00", "Regler kompakt", "8 zu LV-Pos.: 1.2.3", "12345679 1 ST 3,00 3,00"],
    "re": ["Materialnr. LV.Pos.", "10 x 1234567 Rohr verzinkt 5 M 2,00 10,00", "01.02.0030", "20 ** bauseits", "30 x 7654321 Bogen 2 ST 1,50 3,00", "Endbetrag 13,00"],
    "no": ["nichts davon"],
}


def test_layouts_and_records(spark):
    lines = [(d, i, 1, 0.05 + 0.02 * i, c) for d, content in DOCS.items() for i, c in enumerate(content)]
    df = spark.createDataFrame(lines, "document_id string, seq long, page int, y double, content string")
    assert {r.document_id: r.layout for r in layouts(df).collect()} == {"gc": "GC_LVNR", "pm": "P_AND_M", "sp": "SPECIALIZED_LV_POS", "re": "REISSER_LV_POS", "no": "UNSUPPORTED"}
    got = {}
    for r in supplier_records(df).collect():
        got.setdefault(r.document_id, set()).add((r.reference, r.article, r.quantity, r.unit, r.unit_price, r.total_price, r.price_basis, r.role))
    assert got == {
        "gc": {("2.1.10", "ART1", 4.0, "St", 42.75, 1.71, 100, "PRIMARY"), ("2.1.10", "ART2", 1.0, "St", 5.0, 5.0, 1, "MANDATORY_COMPONENT"), ("2.1.20-30", None, None, None, None, None, 1, "PROVIDED_BY_OTHERS"), ("2.1.40", None, None, None, None, None, 1, "NOT_OFFERED")},
        "pm": {("2.1.10", "A-1", 3.0, "St", 100.0, 300.0, 1, "PRIMARY"), ("2.1.10", "A-2", 1.0, "St", 50.0, 50.0, 1, "OPTIONAL"), ("2.1.20", None, None, None, None, None, 1, "NOT_OFFERED")},
        "sp": {("1.2.3", "12345678", 2.0, "St", 9.0, 18.0, 1, "PRIMARY"), ("1.2.3", "12345679", 1.0, "St", 3.0, 3.0, 1, "MANDATORY_COMPONENT")},
        "re": {("1.2.30", "1234567", 5.0, "M", 2.0, 10.0, 1, "PRIMARY"), ("1.2.30", None, None, None, None, None, 1, "PROVIDED_BY_OTHERS"), ("1.2.30", "7654321", 2.0, "St", 1.5, 3.0, 1, "MANDATORY_COMPONENT")},
    }
    described = {r.article: r.description for r in supplier_records(df).collect()}
    assert described["ART1"] == "Pumpe fein per 100" and described["A-1"] == "Ventil DN 20" and described["12345678"] == "Regler kompakt"


SCHEMA = "document_id string, seq long, page int, y double, content string"


def read(spark, **documents):
    """Records of documents, ten lines a page; a line after '|' stands in the footer."""
    lines = [(d, i, i // 10 + 1, 0.95 if c and c[0] == "|" else 0.4, c and c.lstrip("|")) for d, content in documents.items() for i, c in enumerate(content)]
    return spark.createDataFrame(lines, SCHEMA)


def test_modes_footers_and_pages(spark):
    pm = ["Angebotsposition 2.1.10", "Vorwort", "1 A-1 3 Stück 1,00 3,00", "Ventil alternativ", "|Seite 1", "2 A-2 1 St 2,00 2,00", "3 A-3 1 Stk. 2,00", "kein Text von A-2", "Optional bieten wir an", "Alternativ dazu:"]
    pm += ["4 A-4 1 m 5,00 5,00", "Angebotsposition 2.1.20 alternativ", "5 A-5 1 kg 5,00 5,00", "Angebotsposition ohne Nummer", "Angebotsposition 2.1.30", "6 A-6 1 L 1,00 1,00", "Angebotsposition 2.1.40-50", "wir können es nicht anbieten", "7 A-7 1 St 1,00 1,00"]
    got = {r.article: (r.reference, r.role, r.description, r.continuation) for r in supplier_records(read(spark, pm=pm)).collect()}
    assert got == {
        "A-1": ("2.1.10", "PRIMARY", "Ventil alternativ", False),
        "A-2": ("2.1.10", "MANDATORY_COMPONENT", "A-2", False),
        "A-4": ("2.1.10", "OPTIONAL", "A-4", True),
        "A-5": ("2.1.20", "ALTERNATIVE", "Angebotsposition ohne Nummer", False),
        "A-6": ("2.1.30", "PRIMARY", "A-6", False),
        None: ("2.1.40-2.1.50", "NOT_OFFERED", "Diese Ausschreibungsposition können wir Ihnen nicht anbieten.", False),
    }


def test_choices_stops_and_carried_references(spark):
    re = ["Materialnr. LV.Pos.", "10 x 1234567 Rohr 5 M 2,00 10,00", "Text", "Summe Positionen 10,00", "9.9.9", "20 Wahlweise bieten wir an:", "01.02.0030", "y 7654321 Bogen 2 ST 1,50", "Stat. WarenNr 1", "lang", "25 Wahlweise bieten wir an", "nichts", "30 x 1234568 Knie 1 ST 1,00 1,00"]
    one_sign = ["LV.Pos.", "10 x 1234567 Rohr 5 M 2,00 10,00"]
    frame = read(spark, re=re, half=one_sign, none=[None, ""])
    got = [(r.position, r.article, r.reference, r.role, r.description, r.total_price) for r in sorted(supplier_records(frame).collect(), key=lambda r: r.position)]
    assert got == [("10", "1234567", None, "PRIMARY", "Rohr Text", 10.0), ("20", "7654321", "1.2.30", "ALTERNATIVE", "Bogen lang", None), ("30", "1234568", "1.2.30", "PRIMARY", "Knie", 1.0)]
    assert sorted(r.document_id for r in unsupported(frame).collect()) == ["half", "none"]


def test_net_prices_and_lost_rows(spark):
    sp = ["7 zu LV-Pos.: 1.2.3", "12345678 2 ST 10,00 20,00", "Regler", "12345679 1 ST 1,00 1,00", "8 zu LV-Pos.: 1.2.4", "kein Artikel", "9 zu LV-Pos.: (1 2 5 )", "Positionsnetto 1,00 2,00", "12345670 2 ST 9,00 9,00"]
    gc = ["POS 1 LVNR 1 2 3 alternativ", "A1 Rohr 1.000 M 1,00 9,00", "alternativ per 100", "POS 2 LVNR 1 2 3", "kein Preis", "A9 Rohr 1 M 1,00 9,00", "POS 3 LVNR 1 2 3", "A3 Rohr 1,5 KG 1,00 9,00", "1 2 4 Bauseits geliefert", "A4 Rohr 1 M 1,00 1,00"]
    got = {r.article: (r.reference, r.role, r.description, r.quantity, r.unit_price, r.price_basis) for r in supplier_records(read(spark, sp=sp, gc=gc)).collect()}
    assert got == {
        "12345678": ("1.2.3", "PRIMARY", "Regler 12345679 1 ST 1,00 1,00", 2.0, 10.0, 1),
        "12345670": ("1.2.5", "PRIMARY", "12345670", 2.0, 1.0, 1),
        "A1": ("1.2.3", "ALTERNATIVE", "Rohr alternativ per 100", 1000.0, 1.0, 100),
        "A3": ("1.2.3", "PRIMARY", "Rohr", 1.5, 1.0, 1),
    }


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert supplier_records(empty).count() == 0 and unsupported(empty).count() == 0


def test_lines_are_shuffled_once_also_with_the_failures(spark):
    frame = read(spark, gc=DOCS["gc"], none=[None, ""])
    plan = supplier_records(frame, failures=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = [(r.document_id, r.description, r.role, r.price_basis, r.page) for r in supplier_records(frame, failures=True).filter("layout = 'UNSUPPORTED'").collect()]
    assert got == [("none", "No supported deterministic supplier layout signature found.", "ERROR", None, None)]
