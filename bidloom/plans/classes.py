"""Queries on classification, validity and page columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import geometry as g
from bidloom.operators import classify, keyed, records
from bidloom.plans.offers import LINE, LINE_SQL, OPTIONS, options
from bidloom.plans.registry import query

WORDS = ["Heizungsinstallation", "Trinkwasserinstallation", "Wärmepumpe", "Waschtisch", "Geberit ProPlanner", "Rohr"]
TITLES = ["Angebot Nr. 12", "Leistungsverzeichnis", "Preisspiegel", "Heizlast", "Preisblatt", "Brief", "Kalkulation (gesamt) Montagezeit"]


def pick(words, k):
    return F.get(F.array(*map(F.lit, words)), k.cast("int"))


@query("""
WITH w AS (SELECT p_partkey, p_partkey % 6 AS a, p_size % 6 AS b FROM part), s AS (SELECT *, [5, 0, 3, 0, 0, 0][a + 1] + [5, 0, 3, 0, 0, 0][b + 1] AS h, [0, 5, 0, 1, 1, 0][a + 1] + [0, 5, 0, 1, 1, 0][b + 1] AS w FROM w)
SELECT p_partkey, CASE WHEN (a = 4 OR b = 4) AND a > 1 AND b > 1 THEN 'INSTALLATIONSSYSTEME' WHEN h >= w + 4 THEN 'HEIZUNG' WHEN w >= h + 4 THEN 'SANITAER' WHEN h > 0 AND w > 0 THEN 'MULTI' ELSE 'UNKNOWN' END AS discipline FROM s
""")
def document_discipline(t):
    c = F.concat_ws(" ", pick(WORDS, F.col("p_partkey") % 6), pick(WORDS, F.col("p_size") % 6))
    return t.part.select("p_partkey", classify.discipline(c)["discipline"].alias("discipline"))


@query("""
SELECT p_partkey, ['SUPPLIER_OFFER', 'BASIS_LV', 'HISTORICAL_CALCULATION', 'MANUFACTURER_CALCULATION', 'MANUAL_PRICE_TABLE', 'UNKNOWN', 'MANUFACTURER_CALCULATION'][p_partkey % 7 + 1] AS type,
  ['HIGH', 'HIGH', 'HIGH', 'MEDIUM', 'MEDIUM', 'LOW', 'HIGH'][p_partkey % 7 + 1] AS confidence FROM part
""")
def corpus_type(t):
    return t.part.withColumn("c", classify.corpus_type(F.concat_ws(" ", pick(TITLES, F.col("p_partkey") % 7), "p_name"))).select("p_partkey", "c.type", "c.confidence")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS n FROM orders
""")
def position_inventory(t):
    content = F.concat(F.lit("LV-Pos. 1.2."), F.col("o_custkey").cast("string"), F.lit(" x 1 . 2 . "), F.col("o_custkey").cast("string"), F.lit(" y 9.8."), F.col("o_orderkey").cast("string"), F.lit(" z"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "BASIS_LV").when(F.col("o_orderkey") % 3 == 1, "SUPPLIER_OFFER").otherwise("UNKNOWN")
    return t.orders.select("o_orderkey", classify.position_inventory(content, kind).alias("n"))


@query("""
SELECT CASE WHEN p_size = 1 THEN 'DESCRIPTION_ONLY' WHEN p_partkey % 17 = 0 THEN 'UNCLEAR_STRUCTURE' WHEN p_partkey % 5 = 0 THEN 'ALTERNATIVE_REQUIREMENT' WHEN p_size < 10 THEN 'SINGLE_ITEM' WHEN p_partkey % 2 = 0 THEN 'PACKAGE_REQUIREMENT' ELSE 'MULTI_COMPONENT_REQUIREMENT' END AS type, count(*) AS n FROM part GROUP BY 1
""")
def basis_structure(t):
    p = F.col("p_partkey")
    described = F.when(p % 2 == 0, F.concat("p_name", F.lit(", Komplett"))).otherwise(F.col("p_name"))
    kind = classify.structure_type(F.col("p_size") == 1, F.col("p_size"), F.lit("Stk"), p % 17 != 0, p % 5 == 0, F.when(F.col("p_size") < 10, 1).otherwise(3), described)
    return t.part.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN l_partkey % 23 = 0 OR l_linenumber > 5 THEN 'INVALID' WHEN l_suppkey % 4 > 0 THEN 'EXACT' ELSE 'PAGE_CONTEXT' END AS target, count(*) AS n FROM lineitem GROUP BY 1
""")
def source_targets(t):
    box = g.region(F.lit(0.1), F.lit(0.1), F.when(F.col("l_suppkey") % 4 > 0, 0.5).otherwise(0.95), F.lit(0.1))
    target = classify.source_target(F.when(F.col("l_partkey") % 23 != 0, "r1"), F.lit(5), F.col("l_linenumber"), box)
    return t.lineitem.groupBy(target.alias("target")).agg(F.count("*").alias("n"))


@query(f"""
WITH {OPTIONS}, v AS (SELECT CASE WHEN option % 23 = 0 THEN 'NO_RELEVANT_DOCUMENT' WHEN option % 7 = 0 THEN 'EXPLICIT_NO_OFFER' WHEN option % 5 = 0 THEN 'MATCHING_REVIEW_REQUIRED' WHEN quantity < 5 OR option % 3 = 0 THEN 'UNASSIGNED_SUPPLIER' WHEN total < 3000 THEN 'REAL_OPTION_PRICE_MISSING' ELSE 'REAL_SELECTABLE_OPTION' END AS validity FROM o)
SELECT validity, validity IN ('REAL_SELECTABLE_OPTION', 'REAL_OPTION_PRICE_MISSING') AS selectable, count(*) AS n FROM v GROUP BY 1, 2
""")
def option_validity(t):
    o = F.col("option")
    v = classify.option_validity(o % 23 != 0, o % 7 == 0, o % 5 != 0, F.col("quantity") >= 5, o % 3 != 0, F.col("total") >= 3000)
    return options(t).groupBy(v.alias("validity")).agg(F.count("*").alias("n")).withColumn("selectable", classify.selectable(F.col("validity")))


@query(f"""
WITH {OPTIONS}, p AS (SELECT position, count(*) AS present, count(*) FILTER (WHERE option % 3 = 0) AS reliable FROM o GROUP BY 1)
SELECT CASE WHEN position % 7 = 0 THEN 'SELECTED' WHEN position % 11 = 0 THEN 'MATCH_REJECTED' WHEN position % 2 = 0 THEN 'NOT_SELECTED' WHEN reliable = 0 THEN 'MATCH_UNCLEAR' ELSE 'NOT_SELECTED' END AS status, count(*) AS n FROM p GROUP BY 1
""")
def export_status(t):
    p = options(t).groupBy("position").agg(F.count("*").alias("present"), F.count_if(F.col("option") % 3 == 0).alias("reliable"))
    k = F.col("position")
    return p.groupBy(classify.export_status(k % 7 == 0, k % 11 == 0, k % 2 == 0, F.col("present"), F.col("reliable")).alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, merged FROM (SELECT event_id, event_type, coalesce(event_type = 'view' AND lead(event_type) OVER w = 'click', false) AS merged, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE NOT (event_type = 'click' AND coalesce(p = 'view', false))
""")
def marker_pairs(t):
    d = t.events.withColumnRenamed("event_type", "kind")
    return classify.merged_pairs(d, ["user_id"], [F.col("ts"), F.col("event_id")], "view", "click").select("event_id", "merged")


@query(f"""
WITH {OPTIONS}, r AS (SELECT position, option AS label, total, row_number() OVER (PARTITION BY position ORDER BY total, option) AS rn FROM o WHERE n_lines = 1) SELECT position, label, total FROM r WHERE rn = 1
""")
def cheapest_labelled(t):
    d = options(t).withColumnRenamed("option", "label")
    return classify.cheapest_labelled(d, "position", "label", F.when(F.col("n_lines") == 1, F.col("total")))


@query("""
SELECT l_orderkey, round(least(1, sum(0.01 * (l_linenumber * l_linenumber)))::DOUBLE, 6) AS share FROM lineitem GROUP BY 1
""")
def raster_coverage(t):
    size = F.col("l_linenumber") * 0.1
    none = F.array().cast("array<double>")
    m = F.array(size, F.lit(0.0), F.lit(0.0), size, F.lit(0.3), F.lit(0.2))
    ops = F.array(*(F.struct(F.lit(o).alias("op"), (m if o == "TRANSFORM" else none).alias("m")) for o in ("SAVE", "TRANSFORM", "PAINT", "RESTORE")))
    d = t.lineitem.groupBy("l_orderkey").agg(F.flatten(F.collect_list(ops)).alias("ops"))
    return d.select("l_orderkey", F.round(classify.raster_coverage(F.col("ops"), F.lit(1.0)), 6).alias("share"))


@query("""
WITH m AS (SELECT DISTINCT user_id AS k, event_id AS seq, event_id % 3 AS c FROM events), n AS (SELECT k, c, count(*) AS n FROM m GROUP BY 1, 2),
b AS (SELECT a.k, a.c, max(o.c) FILTER (WHERE o.c < a.c AND o.n >= 2) AS l, min(o.c) FILTER (WHERE o.c > a.c AND o.n >= 2) AS r FROM n a JOIN n o USING (k) GROUP BY 1, 2)
SELECT k, seq, round(coalesce((l + c) / 2.0 * 0.3 + 0.1, 0)::DOUBLE, 6) AS "left", round(coalesce((r + c) / 2.0 * 0.3 + 0.1, 1)::DOUBLE, 6) AS "right" FROM m JOIN b USING (k, c)
""")
def column_bounds(t):
    markers = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), ((F.col("event_id") % 3) * 0.3 + 0.1).alias("x"))
    return classify.column_bounds(markers, ["k"]).select("k", "seq", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS rn FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY rn) AS nth FROM s)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE nth = 1) AS n_primary, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM r GROUP BY 1
""")
def supplier_records(t):
    d = keyed.versions(t.lineitem, "l_orderkey", [F.col(c) for c in LINE], "rn")
    german = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    anchor = F.format_string("POS %d LVNR 01 2 %d Text", "rn", "l_partkey")
    row = F.concat(F.format_string("A%d Artikel %d ST 1,00 ", "l_suppkey", F.col("l_quantity").cast("int")), german)
    pair = F.explode(F.array(F.struct((F.col("rn") * 2).alias("seq"), anchor.alias("content")), F.struct((F.col("rn") * 2 + 1).alias("seq"), row.alias("content"))))
    lines = d.select(F.col("l_orderkey").alias("document_id"), pair.alias("x")).select("document_id", "x.seq", F.lit(1).alias("page"), F.lit(0.5).alias("y"), "x.content")
    r = records.supplier_records(lines)
    return r.groupBy(F.col("document_id").alias("l_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "PRIMARY").alias("n_primary"), F.sum("quantity").alias("quantity"), F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("total"))
