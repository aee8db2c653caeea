"""Page scans, recognised words and quantities in text; their inputs are written from the columns of given tables, and the SQL works from those columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import geometry as g
from bidloom.functions import quantities
from bidloom.operators import keyed
from bidloom.plans.offers import LINE, LINE_SQL
from bidloom.plans.registry import query
from bidloom.sources import page_scan


def exports(t):
    """One export an order, a page of two items a line; some broken, blank or without pages."""
    d = keyed.versions(t.lineitem, "l_orderkey", [F.col(c) for c in LINE], "rn")
    n, part, q = F.col("rn"), F.col("l_partkey"), F.col("l_quantity")
    item = lambda content, y: F.struct(content.alias("content"), (q + 20).alias("width"), F.lit(8.0).alias("height"), F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), (q * 12).cast("double"), y.cast("double")).alias("transform"))
    long = F.when(part % 3 == 0, F.repeat(F.lit("Maß ①, "), 12)).when(part % 3 == 1, F.repeat(F.lit(" ﬁ x\n "), 10)).otherwise("")
    page = F.struct(n.alias("page_number"), F.lit(400.0).alias("width"), F.lit(800.0).alias("height"), (F.col("l_linenumber") % 2).alias("image_count"), F.when(part % 2 == 0, F.lit("erkannt")).otherwise(" ").alias("ocr_text"), F.array(item(F.concat(F.lit("  Artikel "), part.cast("string")), q * 20), item(long, F.lit(-5.0))).alias("items"))
    whole = d.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    content = F.to_json(F.struct("pages"))
    k = F.col("document_id") % 7
    broken = F.when(k == 3, F.substring(content, F.lit(1), F.length(content) - 5)).when(k == 5, F.lit("  ")).when(k == 6, F.lit('{"pages": []}')).otherwise(content)
    return whole.select("document_id", broken.alias("content"))


SCANNED = f"""
WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS rn FROM lineitem),
p AS (SELECT l_orderkey AS document_id, rn::INTEGER AS page, l_linenumber % 2 AS images, l_partkey AS part, l_quantity AS q,
  length('Artikel ' || l_partkey) + CASE l_partkey % 3 WHEN 0 THEN 12 * 7 - 1 WHEN 1 THEN 10 * 5 - 1 ELSE 0 END AS chars FROM i WHERE l_orderkey % 7 NOT IN (3, 5, 6))
"""


@query(f"""
{SCANNED}
SELECT document_id, page, images AS image_count, chars::INTEGER AS chars, CASE WHEN chars >= 80 THEN CASE WHEN images > 0 THEN 'HYBRID' ELSE 'DIGITAL' END WHEN images > 0 THEN 'SCAN' ELSE 'UNREADABLE' END AS mode,
  CASE WHEN chars >= 40 THEN 'NATIVE' WHEN part % 2 = 0 THEN 'OCR' END AS method, 'Artikel ' || part AS first_text, CASE part % 3 WHEN 0 THEN 'Maß 1, Maß 1' WHEN 1 THEN 'fi x fi x fi' ELSE '' END AS second_text,
  round(least(1, q * 12 / 400), 6)::DOUBLE AS x, round(greatest(0, 1 - (q * 20 + 8) / 800), 6)::DOUBLE AS y, round(least(1 - least(1, q * 12 / 400), (q + 20) / 400), 6)::DOUBLE AS width,
  round(least(1 - greatest(0, 1 - (q * 20 + 8) / 800), 12 / 800.0::DOUBLE), 6)::DOUBLE AS height FROM p
""")
def scanned_pages(t):
    d = page_scan.pages(exports(t))
    first, second = F.get("items", F.lit(0)), F.get("items", F.lit(1))
    boxed = [F.round(first["region"][c], 6).alias(c) for c in ("x", "y", "width", "height")]
    return d.select("document_id", "page", "image_count", "chars", "mode", "method", first["normalised"].alias("first_text"), F.substring(second["normalised"], 1, 12).alias("second_text"), *boxed)


@query(f"""
{SCANNED}
SELECT DISTINCT l_orderkey AS document_id, NULL::INTEGER AS page, CASE WHEN l_orderkey % 7 = 6 THEN 'DOCUMENT_EMPTY' ELSE 'DOCUMENT_UNREADABLE' END AS code FROM lineitem WHERE l_orderkey % 7 IN (3, 5, 6)
UNION ALL SELECT document_id, page, 'PAGE_UNREADABLE' FROM p WHERE chars < 40 AND part % 2 = 1
""")
def scan_failures(t):
    return page_scan.issues(exports(t))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x, l_suppkey % 700 AS y, l_quantity + 1 AS w, 10 + l_linenumber AS h, l_orderkey % 6 AS turn FROM lineitem)
SELECT l_orderkey, l_linenumber, x, y, turn, CASE WHEN turn < 4 THEN round(x / 1000.0, 6) END::DOUBLE AS "left", CASE WHEN turn < 4 THEN round(y / 2000.0, 6) END::DOUBLE AS top,
  CASE WHEN turn < 4 THEN round(w / 1000.0, 6) END::DOUBLE AS width, CASE WHEN turn < 4 THEN round(h / 2000.0, 6) END::DOUBLE AS height FROM w
""")
def recognised_words(t):
    """Words of page images, taken back through viewports of four turns and two singular ones, and seen through them again."""
    turned = [[1, 0, 0, -1, 0, 800], [0, 1, 1, 0, 0, 0], [-1, 0, 0, 1, 400, 0], [0, -1, -1, 0, 400, 800], [1, 2, 2, 4, 0, 0], [0, 0, 0, 0, 5, 5]]
    k = (F.col("l_orderkey") % 6).cast("int")
    viewport = F.get(F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in turned)), k)
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 700
    d = t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), k.alias("turn"), viewport.alias("v"), (x + F.col("l_quantity") + 1).alias("x1"), (y + 10 + F.col("l_linenumber")).alias("y1")).withColumn("turn", F.col("turn").cast("bigint"))
    size = [F.lit(v) for v in (1000.0, 2000.0)]
    page = [F.lit(v) for v in (400.0, 800.0)]
    d = d.withColumn("item", g.recognised_item(F.col("x1"), F.col("y"), F.col("x"), F.col("y1"), *size, F.col("v"), *page))
    d = d.withColumn("r", g.item_region(F.lit("word"), F.col("item.transform"), F.col("item.width"), F.col("item.height"), F.col("v"), *page))
    return d.select("l_orderkey", "l_linenumber", "x", "y", "turn", F.round("r.x", 6).alias("left"), F.round("r.y", 6).alias("top"), F.round("r.width", 6).alias("width"), F.round("r.height", 6).alias("height"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::INTEGER AS q, (l_orderkey + l_linenumber) % 9 AS k FROM lineitem)
SELECT l_orderkey, n AS l_linenumber, k, CASE k WHEN 0 THEN n WHEN 3 THEN q WHEN 4 THEN n WHEN 8 THEN q END::DOUBLE AS quantity, CASE k WHEN 0 THEN 'St' WHEN 3 THEN 'Stk' WHEN 4 THEN 'Stk' WHEN 8 THEN 'kg' END AS unit,
  CASE k WHEN 0 THEN n || ',000 St' WHEN 2 THEN q || ' St / ' || (q + 6) || ' St' WHEN 3 THEN q || ' Stk' WHEN 4 THEN n || ' Stk' WHEN 5 THEN q || ' Rollen' WHEN 8 THEN q || ' kg' ELSE '' END AS raw,
  CASE k WHEN 1 THEN 'QUANTITY_MISSING' WHEN 2 THEN 'QUANTITY_AMBIGUOUS' WHEN 5 THEN 'UNKNOWN_UNIT' WHEN 6 THEN 'QUANTITY_MISSING' WHEN 7 THEN 'QUANTITY_MISSING' END AS reason,
  CASE k WHEN 0 THEN n WHEN 3 THEN q WHEN 4 THEN n WHEN 7 THEN q WHEN 8 THEN q END::DOUBLE AS ocr_quantity, CASE k WHEN 1 THEN 'QUANTITY_MISSING' WHEN 2 THEN 'QUANTITY_AMBIGUOUS' WHEN 5 THEN 'UNKNOWN_UNIT' WHEN 6 THEN 'QUANTITY_MISSING' WHEN 7 THEN 'OCR_SOURCE' END AS ocr_reason FROM x
""")
def asked_quantities(t):
    """Blocks of text of nine kinds, each with its line's own numbers."""
    n, q, k = F.col("l_linenumber"), F.col("l_quantity").cast("int"), (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    texts = [
        F.format_string("Speicher %s\nGewicht: %d kg\n%d,000 St", "l_returnflag", q, n),
        F.format_string("Max. Volumenstrom: %d,5 m3/h\nRohrlänge: %d m", q, q),
        F.format_string("Leistung\n%d St\n%d St", q, q + 6),
        F.format_string("Leistung %s %d Stk 12,50 1.%d,00", "l_returnflag", q, n + 100),
        F.format_string("Kabel %d m\n%d Stk 1,00 ....", q, n),
        F.format_string("%d Rollen EP 12,00", q),
        F.format_string("%d bar", q),
        F.format_string("%d Std geprueft", q),
        F.format_string("%d kg\nText\n%d KG GP 1,00", q, q),
    ]
    d = t.lineitem.select("l_orderkey", "l_linenumber", k.alias("k"), F.get(F.array(*texts), k.cast("int")).alias("c"))
    d = d.select("*", quantities.quantity(F.col("c")).alias("x"), quantities.quantity(F.col("c"), True).alias("o"))
    return d.select("l_orderkey", "l_linenumber", "k", "x.quantity", "x.unit", "x.raw", "x.reason", F.col("o.quantity").alias("ocr_quantity"), F.col("o.reason").alias("ocr_reason"))
