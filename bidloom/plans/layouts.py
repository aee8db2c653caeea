"""Supplier documents of several layouts, read record by record.

The documents are the orders: each line item is written in the words of one of four
layouts, or of none, with optional and alternative offers, refusals, net prices,
notes, lines in the page's footer and records that run over pages.  The SQL works the
records out from the columns that the lines were written from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.operators import keyed, records
from bidloom.plans.offers import LINE, LINE_SQL
from bidloom.plans.registry import query


def supplier_lines(t):
    """document_id, seq, page, y, content: four slots a line item, of which some stay empty."""
    d = keyed.versions(t.lineitem, "l_orderkey", [F.col(c) for c in LINE], "rn").withColumn("k", F.col("l_orderkey") % 5)
    d = d.withColumns(
        {
            "total": F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"),
            "up": F.format_string("%d,%02d", "l_suppkey", "l_linenumber"),
            "q": F.col("l_quantity").cast("int"),
        }
    )
    n, part = F.col("rn"), F.col("l_partkey")
    priced = n % 5 != 4
    text = F.format_string("Ausführung %s%d", "l_linestatus", "l_linenumber")
    gc = [
        F.when(priced, F.format_string("POS %d LVNR 01 %d %d %s", "rn", F.col("l_linenumber") % 3, part % 4, F.when(n % 7 == 3, "alternativ").otherwise("Los")))
        .when(n % 2 == 0, F.format_string("1 %d %d Bauseits", "l_suppkey", "rn"))
        .otherwise(F.format_string("1 %d %d-%d siehe vorige Pos", "l_suppkey", "rn", n + 2)),
        F.when(priced & (part % 9 == 8), F.format_string("A%d ohne Preis", "l_suppkey")).when(priced, F.format_string("A%d Artikel %d %d ST %s %s", "l_suppkey", "l_partkey", "q", "up", "total")),
        F.when(priced, text),
        F.when(priced & (F.col("q") % 3 == 0), F.lit("per  100")),
    ]
    pm = [
        F.when(n % 3 == 1, F.format_string("Angebotsposition 2.%d.%d%s", part % 5, "rn", F.when(part % 4 == 0, " alternativ").otherwise(""))),
        F.when(n % 3 == 0, F.lit("Optional bieten wir Ihnen an")),
        F.format_string("%d A-%d %d Stück %s %s", "rn", "l_suppkey", "q", "up", "total"),
        F.when((n % 3 == 1) & (part % 6 == 5), F.lit("Leider können wir das nicht anbieten")).otherwise(F.format_string("Ventil %s%d alternativ", "l_returnflag", "l_linenumber")),
    ]
    sp = [
        F.format_string("%d zu LV-Pos.: 3.%d.%d", "rn", F.col("l_linenumber") % 2, part % 3),
        F.format_string("%d %d ST %s %s", part + 10_000_000, "q", "up", "total"),
        F.when(n % 2 == 0, F.format_string("Positionsnetto %d,50 %d,25", "l_suppkey", "l_partkey")),
        F.format_string("Regler %s%d", "l_returnflag", "l_linenumber"),
    ]
    re = [
        F.when(n == 1, F.lit("Materialnr.   LV.Pos.")),
        F.when(n % 4 == 0, F.format_string("%d ** bauseits", n * 10))
        .when(n % 4 == 3, F.format_string("%d Wahlweise bieten wir an:", n * 10))
        .otherwise(F.format_string("%d x %d Rohr %s %d M %s %s", n * 10, part + 1_000_000, "l_returnflag", "q", "up", "total")),
        F.when(n % 4 == 3, F.format_string("y %d Bogen %d ST %s", part + 2_000_000, "q", "up")).when((n % 4 > 0) & (part % 2 == 0), F.format_string("04.%d.%d", F.col("l_suppkey") % 3, "l_linenumber")),
        F.when(n % 2 == 1, F.lit("Alte Materialnr 5")).otherwise(F.format_string("Muster %s", "l_linestatus")),
    ]
    other = [F.format_string("Brief %d", "l_partkey"), *([F.lit(None).cast("string")] * 3)]
    slots = []
    for j in range(4):
        content = F
        for k, lines in enumerate((gc, pm, sp, re, other)):
            content = content.when(F.col("k") == k, lines[j])
        slots.append(F.struct((n * 4 + j).alias("seq"), content.alias("content")))
    d = d.select(F.col("l_orderkey").alias("document_id"), F.explode(F.array(*slots)).alias("x")).filter("x.content is not null")
    seq = F.col("x.seq")
    return d.select("document_id", seq.alias("seq"), (F.floor(seq / 10) + 1).cast("int").alias("page"), F.when(seq % 10 == 9, 0.95).otherwise(0.5).alias("y"), "x.content")


@query(f"""
WITH i AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS rn FROM lineitem
), v AS (
  SELECT l_orderkey AS d, l_orderkey % 5 AS k, rn, l_partkey AS part, l_suppkey AS supp, l_linenumber AS ln, l_returnflag AS flag, l_linestatus AS st, l_quantity::INTEGER AS q,
    l_extendedprice AS total, (l_suppkey || '.' || lpad(l_linenumber::VARCHAR, 2, '0'))::DOUBLE AS up, (4 * rn + 3) % 10 <> 9 AS seen,
    first_value(l_partkey) OVER b AS head_part, first_value(rn) OVER b AS head, 4 * rn // 10 + 1 AS page0
  FROM i WINDOW b AS (PARTITION BY l_orderkey, (rn - 1) // 3 ORDER BY rn)
), re AS (
  SELECT *, last_value(CASE WHEN rn % 4 IN (1, 2) AND part % 2 = 0 THEN '4.' || supp % 3 || '.' || ln END IGNORE NULLS) OVER (PARTITION BY d ORDER BY rn) AS ref FROM v WHERE k = 3
), r AS (
  SELECT d, rn, 'GC_LVNR' AS layout, '1.' || ln % 3 || '.' || part % 4 AS reference, rn::VARCHAR AS position, 'A' || supp AS article,
    'Artikel ' || part || CASE WHEN (4 * rn + 2) % 10 <> 9 THEN ' Ausführung ' || st || ln ELSE '' END || CASE WHEN q % 3 = 0 AND seen THEN ' per 100' ELSE '' END AS description, q::DOUBLE AS quantity, 'St' AS unit, up AS unit_price, total AS total_price,
    CASE WHEN q % 3 = 0 AND seen THEN 100 ELSE 1 END AS price_basis, CASE WHEN rn % 7 = 3 THEN 'ALTERNATIVE' END AS role, page0 AS page, false AS continuation, NULL AS scope FROM v WHERE k = 0 AND rn % 5 <> 4 AND part % 9 <> 8
  UNION ALL
  SELECT d, rn, 'GC_LVNR', '1.' || supp || '.' || rn || CASE WHEN rn % 2 = 0 THEN '' ELSE '-' || (rn + 2) END, NULL, NULL, CASE WHEN rn % 2 = 0 THEN 'Bauseits' ELSE 'siehe vorige Pos' END,
    NULL, NULL, NULL, NULL, 1, CASE WHEN rn % 2 = 0 THEN 'PROVIDED_BY_OTHERS' ELSE 'NOT_OFFERED' END, page0, false, NULL FROM v WHERE k = 0 AND rn % 5 = 4
  UNION ALL
  SELECT d, rn, 'P_AND_M', '2.' || head_part % 5 || '.' || head, rn::VARCHAR, 'A-' || supp, CASE WHEN seen THEN 'Ventil ' || flag || ln || ' alternativ' ELSE 'A-' || supp END, q, 'St', up, total, 1,
    CASE WHEN rn % 3 = 0 THEN 'OPTIONAL' WHEN head_part % 4 = 0 THEN 'ALTERNATIVE' END, (4 * rn + 2) // 10 + 1, (4 * rn + 2) // 10 <> 4 * head // 10, head FROM v WHERE k = 1 AND head_part % 6 <> 5
  UNION ALL
  SELECT d, rn, 'P_AND_M', '2.' || part % 5 || '.' || rn, NULL, NULL, '{records.REFUSAL_TEXT}', NULL, NULL, NULL, NULL, 1, 'NOT_OFFERED', page0, false, head FROM v WHERE k = 1 AND rn = head AND part % 6 = 5
  UNION ALL
  SELECT d, rn, 'SPECIALIZED_LV_POS', '3.' || ln % 2 || '.' || part % 3, rn::VARCHAR, (10000000 + part)::VARCHAR, CASE WHEN seen THEN 'Regler ' || flag || ln ELSE (10000000 + part)::VARCHAR END, q, 'St',
    CASE WHEN rn % 2 = 0 THEN supp + 0.5 ELSE up END, CASE WHEN rn % 2 = 0 THEN part + 0.25 ELSE total END, 1, NULL, page0, 4 * rn // 10 <> (4 * rn + 3) // 10, NULL FROM v WHERE k = 2
  UNION ALL
  SELECT d, rn, 'REISSER_LV_POS', ref, (10 * rn)::VARCHAR, CASE WHEN rn % 4 = 3 THEN 2000000 + part WHEN rn % 4 > 0 THEN 1000000 + part END::VARCHAR,
    CASE WHEN rn % 4 = 3 THEN 'Bogen' WHEN rn % 4 = 0 THEN 'bauseits' ELSE 'Rohr ' || flag || CASE WHEN rn % 4 = 2 THEN ' Muster ' || st ELSE '' END END,
    CASE WHEN rn % 4 > 0 THEN q END, CASE WHEN rn % 4 = 3 THEN 'St' WHEN rn % 4 > 0 THEN 'M' END, CASE WHEN rn % 4 > 0 THEN up END, CASE WHEN rn % 4 IN (1, 2) THEN total END, 1,
    CASE rn % 4 WHEN 3 THEN 'ALTERNATIVE' WHEN 0 THEN 'PROVIDED_BY_OTHERS' END, (4 * rn + 1) // 10 + 1, false, CASE WHEN ref IS NULL THEN -rn END FROM re
)
SELECT d AS document_id, layout, reference, position, article, description, quantity, unit, unit_price, total_price, price_basis::INTEGER AS price_basis,
  coalesce(role, CASE WHEN row_number() OVER (PARTITION BY d, scope, CASE WHEN layout <> 'P_AND_M' THEN reference END, role IS NULL ORDER BY rn) = 1 THEN 'PRIMARY' ELSE 'MANDATORY_COMPONENT' END) AS role,
  page::INTEGER AS page, continuation FROM r
UNION ALL
SELECT DISTINCT d, 'UNSUPPORTED', NULL, NULL, NULL, '{records.UNSUPPORTED_TEXT}', NULL::DOUBLE, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::INTEGER, 'ERROR', NULL::INTEGER, NULL::BOOLEAN FROM v WHERE k = 4
""")
def supplier_layouts(t):
    return records.supplier_records(supplier_lines(t), failures=True).drop("n_lines")
