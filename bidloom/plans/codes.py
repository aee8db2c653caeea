"""Queries on documents, texts, lines and options with their rule codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import wording
from bidloom.operators import documents as docs
from bidloom.operators import review
from bidloom.plans.registry import query


def pick(words, key):
    """One of the words by a key."""
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def pick_sql(words, key):
    return "([" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + f"])[({key}) % {len(words)} + 1]"


def codes_sql(rules):
    """SQL list of the codes whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {holds} THEN '{code}' END" for code, holds in rules) + "], lambda x: x IS NOT NULL)"


# Made-up wordings that the text queries read, by order key.
HEADS = ["Angebotsaufforderung LV-Daten LV-Bezeichnung LV-Nummer: AB-12", "Referenzangebot Kundennummer 7", "Angebot Nr. 1234567 Einzelpreis", "wir sehen von einem Angebot ab", "leider kein Angebot", "Kalkulation (Gesamt)", "Datenblatt", "Begleitschreiben", "Anhang", "Inhaltsverzeichnis", "plain words",
         "erhalten Sie anbei das ausgefüllte Leistungsverzeichnis zurück Preisbindung"]
MIDS = ["1.2.3. Rohr DN 50 1.2.4. Bogen", "LVNR 1.2.3 Gesamtpreis LV-Pos. 1 . 2 . 4", "Angebotsposition 10 Angebotsposition 20 Angebotsposition 10", "nothing here", "02.03.001 and 2.3.1 end"]
TAILS = ["Musterwerk AG", "von Alpha  Rohr geliefert", "alpharohr", "(BETA)", "Gültig bis morgen", "Lieferung"]
ALIASES = [("ALPHA", ["Alpha Rohr", "Alpha-R."]), ("MUSTER", ["Musterwerk", "MW & Co"]), ("BETA", ["Beta"])]


def order_texts(t):
    """One text an order.  Keys are dealt out before texts are made of them: a file of keys has few splits, and the texts' patterns are the work."""
    k = F.col("o_orderkey")
    keys = t.orders.select("o_orderkey")
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    body = F.concat_ws(" ", pick(HEADS, k), pick(MIDS, F.floor(k / 3)), pick(TAILS, F.floor(k / 7)))
    return dealt.select(k.alias("doc"), body.alias("text"), (k % 9 * 10).alias("chars"), (k % 4 * 20).alias("ocr_chars"), (k % 5).alias("pages_with_text"), (k % 3 + 1).alias("pages"))


ORDER_TEXTS = f"d AS (SELECT o_orderkey AS doc, {pick_sql(HEADS, 'o_orderkey')} || ' ' || {pick_sql(MIDS, 'o_orderkey // 3')} || ' ' || {pick_sql(TAILS, 'o_orderkey // 7')} AS text, o_orderkey % 9 * 10 AS chars, o_orderkey % 4 * 20 AS ocr_chars, o_orderkey % 5 AS pages_with_text, o_orderkey % 3 + 1 AS pages FROM orders)"


def _match(pattern):
    return f"regexp_matches(text, '{pattern}')"


def _numbers(pattern):
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda x: lower(regexp_replace(regexp_replace(x, '\\s*\\.\\s*|\\s+', '.', 'g'), '^\\.|\\.$', '', 'g'))), lambda x: x <> ''))"


CLASSES = f"""
{ORDER_TEXTS}, c0 AS (SELECT *, CASE WHEN chars < 40 THEN CASE WHEN ocr_chars >= 40 THEN 'OCR_AVAILABLE' ELSE 'OCR_REQUIRED' END WHEN pages_with_text < pages THEN 'PARTIAL_TEXT' ELSE 'TEXT_AVAILABLE' END AS scan_state,
  CASE WHEN text LIKE '%Alpha  Rohr%' OR text LIKE '%Alpha Rohr%' THEN 'ALPHA' WHEN text LIKE '%Musterwerk%' THEN 'MUSTER' WHEN text LIKE '%(BETA)%' THEN 'BETA' END AS supplier, CASE WHEN text LIKE '%1234567%' THEN '1234567' END AS offer_number,
  {' + '.join(f"CASE WHEN {_match(p)} THEN {n} ELSE 0 END" for _, p, n in docs.BASIS_SIGNALS)} AS bp, {' + '.join(f"CASE WHEN {_match(p)} THEN {n} ELSE 0 END" for _, p, n in docs.OFFER_SIGNALS)} AS op,
  {codes_sql([(name, _match(p)) for name, p, _ in docs.BASIS_SIGNALS + docs.OFFER_SIGNALS])} AS signals,
  {_numbers(docs.EXPLICIT_LV)} AS ex, {_numbers(docs.OFFER_POSITION)} AS po, {_numbers(docs.BARE_LV)} AS ba FROM d),
c1 AS (SELECT *, greatest(len(ex), len(po), len(ba)) AS np FROM c0),
c2 AS (SELECT *, CASE WHEN scan_state = 'OCR_REQUIRED' THEN 'SCAN_OCR_REQUIRED|HIGH' WHEN {_match(docs.NO_BID)} OR ({_match(docs.NO_OFFER_WORDS)} AND np = 0) THEN 'EXPLICIT_NO_BID|' || CASE WHEN supplier IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN {_match(docs.CALCULATION)} THEN 'TECHNICAL_CALCULATION|HIGH' WHEN {_match(docs.RETURNED)} AND {_match(docs.RETURNED_WITH)} THEN 'SUPPLIER_OFFER|MEDIUM' WHEN bp >= 12 AND bp >= op + 5 THEN 'BASIS_LV|HIGH'
  WHEN op >= 8 OR (op >= 4 AND supplier IS NOT NULL AND offer_number IS NOT NULL) THEN 'SUPPLIER_OFFER|' || CASE WHEN supplier IS NOT NULL AND offer_number IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END
  {' '.join(f"WHEN {_match(p)} THEN '{kind}|{sure}'" for kind, p, sure in docs.OTHER_ROLES)} ELSE 'UNKNOWN|LOW' END AS ks FROM c1),
c3 AS (SELECT *, split_part(ks, '|', 1) AS document_type, CASE WHEN scan_state = 'OCR_AVAILABLE' AND split_part(ks, '|', 2) <> 'LOW' THEN 'MEDIUM' ELSE split_part(ks, '|', 2) END AS confidence FROM c2),
classes AS (SELECT doc, scan_state, document_type, confidence, CASE WHEN document_type <> 'BASIS_LV' THEN supplier END AS supplier, CASE WHEN document_type <> 'BASIS_LV' THEN offer_number END AS offer_number, signals,
  {codes_sql([("OCR_REQUIRED", "document_type = 'SCAN_OCR_REQUIRED'"), ("ROLE_UNCERTAIN", "document_type = 'UNKNOWN'"), ("OCR_USED", "scan_state = 'OCR_AVAILABLE'"), ("SUPPLIER_UNCERTAIN", "document_type = 'SUPPLIER_OFFER' AND supplier IS NULL")])} AS warnings,
  CASE document_type WHEN 'BASIS_LV' THEN len(list_distinct(list_concat(ba, ex))) WHEN 'SUPPLIER_OFFER' THEN np ELSE 0 END AS n_positions FROM c3)
"""


@query(f"""
WITH {CLASSES} SELECT doc, scan_state, document_type, confidence, supplier, offer_number, array_to_string(signals, ',') AS signals, array_to_string(warnings, ',') AS warnings, n_positions::INTEGER AS n_positions FROM classes
""")
def document_classes(t):
    d = docs.classified(order_texts(t), "text", ALIASES)
    return d.select("doc", "scan_state", "document_type", "confidence", "supplier", "offer_number", F.array_join("signals", ",").alias("signals"), F.array_join("warnings", ",").alias("warnings"), "n_positions")


@query(f"""
WITH {CLASSES} SELECT doc FROM classes WHERE document_type = 'BASIS_LV' AND scan_state <> 'OCR_REQUIRED' AND supplier IS NULL AND offer_number IS NULL AND n_positions > 0
  AND len(list_filter(signals, lambda x: x IN ({', '.join(f"'{s}'" for s in docs.BASIS_PROOF)}))) >= 2
""")
def plausible_tenders(t):
    d = docs.classified(order_texts(t), "text", ALIASES)
    c = F.col
    return d.filter(docs.plausible_tender(c("document_type"), c("document_type"), c("scan_state"), c("supplier"), c("offer_number"), c("signals"), c("n_positions"))).select("doc")


TYPES = ["UNKNOWN", "SCAN_OCR_REQUIRED", "BASIS_LV", "SUPPLIER_OFFER"]


@query(f"""
WITH {CLASSES}, b AS (SELECT doc, 'OCR_REQUIRED' AS ss, {pick_sql(TYPES, 'doc')} AS dt, CASE WHEN doc % 3 = 0 THEN 'UNKNOWN' ELSE 'HEIZUNG' END AS di, CASE WHEN doc % 7 = 0 THEN 'KNOWN' END AS su, doc % 11 = 0 AS manual FROM d),
r AS (SELECT * FROM classes WHERE doc % 10 < 8), j AS (SELECT b.*, r.scan_state, r.document_type, r.supplier, r.offer_number, b.dt IN ('UNKNOWN', 'SCAN_OCR_REQUIRED') AND NOT manual AND r.doc IS NOT NULL AS settled FROM b LEFT JOIN r ON r.doc = b.doc)
SELECT doc, coalesce(scan_state, ss) AS scan_state, CASE WHEN settled THEN document_type ELSE dt END AS document_type, CASE WHEN settled AND di = 'UNKNOWN' THEN 'SANITAER' ELSE di END AS discipline,
  CASE WHEN settled THEN coalesce(su, supplier) ELSE su END AS supplier, CASE WHEN settled THEN offer_number END AS offer_number, settled FROM j
""")
def classification_overlay(t):
    k = F.col("doc")
    known = order_texts(t).select("doc", F.lit("OCR_REQUIRED").alias("scan_state"), pick(TYPES, k).alias("document_type"), F.when(k % 3 == 0, "UNKNOWN").otherwise("HEIZUNG").alias("discipline"), F.when(k % 7 == 0, "KNOWN").alias("supplier"), F.lit(None).cast("string").alias("offer_number"), (k % 11 == 0).alias("manual"))
    run = docs.classified(order_texts(t).filter(k % 10 < 8), "text", ALIASES).withColumn("discipline", F.lit("SANITAER"))
    return docs.overlaid(known, run, "doc")


EVIDENCE = ["VERIFIED_NATIVE", "VERIFIED_VISUAL", "MISSING", "CONFLICTING", "VISUAL_ONLY_UNCONFIRMED"]
STATES = ["TEXT_AVAILABLE", "PARTIAL_TEXT", "OCR_REQUIRED", "OCR_AVAILABLE"]
QUALITY_RULES = [
    ("PARTIAL_TEXT_LAYER", "scan_state = 'PARTIAL_TEXT'"), ("CLASSIFICATION_REVIEW_REQUIRED", "doubtful"), ("EXCLUDED_FROM_PROCESSING", "k % 23 = 0"), ("FULL_DOCUMENT_SCAN_INCOMPLETE", "run AND k % 19 = 0"), ("NO_POSITIONS_EXTRACTED", "extracted = 0"),
    ("POSITION_COUNT_MISMATCH", "extracted < wanted"), ("OCR_SOURCE", "run AND k % 5 > 0"), ("MULTI_PAGE_POSITION", "run AND k % 7 = 0"), ("OCR_FAILED", "run AND k % 13 = 0"), ("OCR_REQUIRED", "run AND k % 17 = 0"), ("EVIDENCE_MISSING", "missing_evidence > 0"), ("EVIDENCE_UNCONFIRMED", "unconfirmed_evidence > 0"),
]


@query(f"""
WITH l AS (SELECT l_orderkey AS k, {pick_sql(EVIDENCE, 'l_suppkey // 7')} AS e FROM lineitem WHERE l_orderkey % 3 > 0),
n AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE e LIKE 'VERIFIED%') AS verified, count(*) FILTER (WHERE e IN ('VISUAL_ONLY_UNCONFIRMED', 'CONFLICTING')) AS un, count(*) FILTER (WHERE e = 'MISSING') AS mi FROM l GROUP BY 1),
d AS (SELECT o_orderkey AS k, {pick_sql([*TYPES, 'MANUFACTURER_OFFER'], 'o_orderkey')} AS document_type, o_orderkey % 4 > 0 AS in_scope, {pick_sql(STATES, 'o_orderkey // 5')} AS scan_state, CASE WHEN o_orderkey % 8 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, o_orderkey % 6 > 0 AS run FROM orders),
j AS (SELECT d.*, greatest(CASE WHEN run THEN k % 5 ELSE 0 END, coalesce(n.n, 0)) AS extracted, coalesce(verified, 0) AS verified, greatest(CASE WHEN run AND k % 29 = 0 THEN 2 ELSE 0 END, coalesce(mi, 0)) AS missing_evidence, coalesce(un, 0) AS unconfirmed_evidence,
  CASE WHEN run THEN k % 6 ELSE k % 4 END AS wanted, document_type IN ('BASIS_LV', 'SUPPLIER_OFFER', 'MANUFACTURER_OFFER') AND in_scope AS part, confidence <> 'HIGH' OR document_type = 'UNKNOWN' AS doubtful FROM d LEFT JOIN n USING (k)),
q AS (SELECT *, scan_state = 'OCR_REQUIRED' AND NOT coalesce(run AND k % 5 > 0, false) AND extracted = 0 AS unread, {codes_sql(QUALITY_RULES)} AS codes FROM j)
SELECT k AS doc, extracted, verified, missing_evidence, unconfirmed_evidence, CASE WHEN unread THEN 'UNSUPPORTED' WHEN NOT part THEN CASE WHEN doubtful THEN 'REVIEW_REQUIRED' ELSE 'SUPPORTED' END WHEN len(codes) > 0 THEN 'REVIEW_REQUIRED' ELSE 'SUPPORTED' END AS status,
  CASE WHEN unread THEN 'OCR_REQUIRED' WHEN NOT part AND doubtful THEN 'CLASSIFICATION_REVIEW_REQUIRED' WHEN NOT part THEN 'NOT_IN_COMPARISON_SCOPE' ELSE array_to_string(codes, ',') END AS reasons FROM q
""")
def document_quality_codes(t):
    k = F.col("o_orderkey")
    run = k % 6 > 0
    when_run = lambda x: F.when(run, x)
    d = t.orders.select(
        k.alias("doc"), pick([*TYPES, "MANUFACTURER_OFFER"], k).alias("document_type"), (k % 4 > 0).alias("in_scope"), pick(STATES, F.floor(k / 5)).alias("scan_state"), F.when(k % 8 == 0, "LOW").otherwise("HIGH").alias("confidence"), (k % 23 == 0).alias("excluded"),
        F.lit(10).alias("pages"), (k % 4).alias("preliminary"), when_run(F.when(k % 19 == 0, 9).otherwise(10)).alias("inspected"), when_run(k % 6).alias("candidates"), when_run(k % 5).alias("found"), when_run(F.when(k % 29 == 0, 2).otherwise(0)).alias("missing_regions"),
        when_run(k % 5).alias("ocr_pages"), when_run(F.when(k % 13 == 0, 1)).alias("ocr_failed"), when_run(F.when(k % 17 == 0, 1)).alias("ocr_required"), when_run(F.when(k % 7 == 0, 1)).alias("multi_page"),
    )
    lines = t.lineitem.filter(F.col("l_orderkey") % 3 > 0).select(F.col("l_orderkey").alias("doc"), pick(EVIDENCE, F.floor(F.col("l_suppkey") / 7)).alias("evidence_status"))
    return docs.quality(d, lines, "doc").withColumn("reasons", F.array_join("reasons", ","))


READY_RULES = [
    ("INVALID_METRICS", "supported + in_review + unsupported <> controlled OR controlled > total_files OR correct > matched OR exact > evidence"), ("DOCUMENT_CRASH", "crashed > 0"), ("UNCONTROLLED_FILES", "controlled < total_files"), ("SILENT_POSITION_OMISSION", "fn > 0"),
    ("EVIDENCE_NEIGHBOUR_CONTAMINATION", "contaminated > 0"), ("WRONG_HIGH_CONFIDENCE_MATCH", "wrong > 0"), ("UNROUTED_UNQUALIFIED_RESULT", "routed < unqualified"), ("PERSISTENCE_FAILED", "c % 31 = 0"), ("REVIEWED_EXPORT_FAILED", "c % 37 = 0"),
    ("SUPPORTED_POSITION_NOT_EVALUATED", "tp + fp = 0"), ("SUPPORTED_POSITION_PRECISION_TOO_LOW", "tp + fp > 0 AND tp / (tp + fp) < 0.99"), ("EXACT_EVIDENCE_NOT_EVALUATED", "evidence = 0"), ("EXACT_EVIDENCE_RATE_TOO_LOW", "evidence > 0 AND exact / evidence < 0.95"),
    ("AUTOMATIC_MATCH_NOT_EVALUATED", "matched = 0"), ("AUTOMATIC_MATCH_SAMPLE_TOO_SMALL", "matched > 0 AND matched < 2"), ("AUTOMATIC_MATCH_ACCURACY_TOO_LOW", "matched >= 2 AND correct / matched < 0.99"),
]


def readiness_counts(t):
    """Counts of each customer's orders as a demonstration's metrics."""
    n = lambda test: F.count_if(test)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupBy(F.col("o_custkey").alias("c")).agg(
        F.count("*").alias("total_files"), n(F.col("o_orderkey") % 41 > 0).alias("controlled"), n((F.col("o_orderkey") % 41 > 0) & (status == "F")).alias("supported"), n((F.col("o_orderkey") % 41 > 0) & (status == "O")).alias("in_review"), n((F.col("o_orderkey") % 41 > 0) & (status == "P")).alias("unsupported"),
        n(F.col("o_orderkey") % 53 == 0).alias("crashed"), n(status != "P").alias("true_positive"), n(F.col("o_orderkey") % 17 == 0).alias("false_positive"), n(F.col("o_orderkey") % 59 == 0).alias("false_negative"), n((status == "F") & (F.col("o_orderkey") % 13 > 0)).alias("exact"), n(status == "F").alias("evidence"),
        n(F.col("o_orderkey") % 61 == 0).alias("contaminated"), n((priority == "1-URGENT") & (F.col("o_orderkey") % 7 > 0)).alias("correct"), n(priority == "1-URGENT").alias("matched"), n(F.col("o_orderkey") % 67 == 0).alias("wrong_sure"), n(status == "P").alias("unqualified"), n((status == "P") & (F.col("o_orderkey") % 19 > 0)).alias("routed"),
    ).withColumns({"least_sample": F.lit(2), "persisted": F.col("c") % 31 != 0, "exported": F.col("c") % 37 != 0})


@query(f"""
WITH m AS (SELECT o_custkey AS c, count(*) AS total_files, count(*) FILTER (WHERE o_orderkey % 41 > 0) AS controlled, count(*) FILTER (WHERE o_orderkey % 41 > 0 AND o_orderstatus = 'F') AS supported, count(*) FILTER (WHERE o_orderkey % 41 > 0 AND o_orderstatus = 'O') AS in_review,
  count(*) FILTER (WHERE o_orderkey % 41 > 0 AND o_orderstatus = 'P') AS unsupported, count(*) FILTER (WHERE o_orderkey % 53 = 0) AS crashed, count(*) FILTER (WHERE o_orderstatus <> 'P') AS tp, count(*) FILTER (WHERE o_orderkey % 17 = 0) AS fp, count(*) FILTER (WHERE o_orderkey % 59 = 0) AS fn,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 13 > 0) AS exact, count(*) FILTER (WHERE o_orderstatus = 'F') AS evidence, count(*) FILTER (WHERE o_orderkey % 61 = 0) AS contaminated, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 > 0) AS correct,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS matched, count(*) FILTER (WHERE o_orderkey % 67 = 0) AS wrong, count(*) FILTER (WHERE o_orderstatus = 'P') AS unqualified, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 19 > 0) AS routed FROM orders GROUP BY 1),
r AS (SELECT *, {codes_sql(READY_RULES[:9])} AS b, {codes_sql(READY_RULES[9:])} AS v FROM m)
SELECT c, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(exact / nullif(evidence, 0), 6) AS evidence_rate, round(correct / nullif(matched, 0), 6) AS accuracy, round(routed / nullif(unqualified, 0), 6) AS routing_rate,
  CASE WHEN matched = 0 THEN 'NOT_EVALUATED' WHEN matched < 2 THEN 'INSUFFICIENT_SAMPLE' WHEN correct / matched < 0.99 THEN 'FAIL' ELSE 'PASS' END AS matching, array_to_string(list_concat(b, v), ',') AS reasons, CASE WHEN len(b) > 0 THEN 'NO_GO' WHEN len(v) > 0 THEN 'REVIEW_ONLY' ELSE 'DEMO_READY' END AS verdict FROM r
""")
def readiness_codes(t):
    d = docs.readiness(readiness_counts(t))
    return d.select("c", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "evidence_rate", "accuracy", "routing_rate")), "matching", F.array_join("reasons", ",").alias("reasons"), "verdict")


WORDINGS = [
    "Rohr komplett liefern und montieren mit Dichtung", "Pumpe, Fabrikat: Muster Typ: AB 12", "optional Gegenflansche und Kleinmaterial", "wird nicht angeboten", "bauseits gestellt", "Wahlweise Bogen mit Isolierung", "Preis auf Anfrage", "Hersteller: nach Wahl", "Fabrikat: Beta Werk",
    "Nennweite: DN 50", "1 . 02 . 3 . Rohrleitung", "1.2.3.4. Bogen", "1. 042 Heizung", "1.2. 042.1 Verteiler", "Anschlusskabel 5 m", "12,50 1.234,00 Ventil Kugel- hahn Zwischensumme 5", "EP: 3,20 Bogen 3 zu LV-Pos.: ", "AB-12.345", "Montage vor Ort", "Typ: X",
]
W_SQL = pick_sql(WORDINGS, "l_orderkey + l_linenumber")
FOLD_SQL = "translate(lower({}), 'äöüé', 'aoue')"
CLEAN_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def line_texts(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", pick(WORDINGS, F.col("l_orderkey") + F.col("l_linenumber")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


LINE_TEXTS = f"x AS (SELECT text, count(*) AS n FROM (SELECT {W_SQL} AS text FROM lineitem) GROUP BY 1)"


@query(f"""
WITH {LINE_TEXTS} SELECT text, n, array_to_string({codes_sql([(name, f"regexp_matches({FOLD_SQL.format('text')}, '{p}')") for name, p in wording.REQUIREMENTS])}, ',') AS tags,
  CASE WHEN regexp_matches({FOLD_SQL.format('text')}, '{wording.INSTALLATION}') THEN 'INSTALLATION' WHEN regexp_matches({FOLD_SQL.format('text')}, '{wording.EXECUTION}') THEN 'EXECUTION' ELSE 'MATERIAL' END AS category,
  regexp_matches({FOLD_SQL.format('text')}, '{wording.INSULATION}') AS insulates FROM x
""")
def requirement_tags(t):
    c = F.col("text")
    return line_texts(t).select("text", "n", F.array_join(wording.requirement_tags(c), ",").alias("tags"), wording.requirement_category(c).alias("category"), wording.satisfies(F.lit("Wärmedämmschale"), c).alias("insulates"))


@query(f"""
WITH {LINE_TEXTS}, e AS (SELECT *, regexp_extract({CLEAN_SQL}, '^([^:]{{2,48}}):\\s*(.{{1,100}})$', 1) AS a, regexp_extract({CLEAN_SQL}, '^([^:]{{2,48}}):\\s*(.{{1,100}})$', 2) AS v FROM x)
SELECT text, CASE WHEN a <> '' AND v <> '' AND NOT regexp_matches(a, '{wording.NO_ATTRIBUTES}') THEN trim(a) END AS name, CASE WHEN a <> '' AND v <> '' AND NOT regexp_matches(a, '{wording.NO_ATTRIBUTES}') THEN trim(v) END AS value,
  nullif(trim(regexp_extract({CLEAN_SQL}, '(?i)^Fabrikat\\s*:\\s*(.+)$', 1)), '') AS asked_maker FROM e
""")
def line_attributes(t):
    a = wording.attribute(F.col("text"))
    return line_texts(t).select("text", a["name"].alias("name"), a["value"].alias("value"), wording.manufacturer_line(F.col("text")).alias("asked_maker"))


@query(f"""
WITH {LINE_TEXTS} SELECT text, n, CASE {' '.join(f"WHEN regexp_matches({CLEAN_SQL}, '{p}') THEN '{name}'" for name, p in wording.ROLE_WORDS)} ELSE 'PRIMARY' END AS role,
  CASE WHEN NOT regexp_matches(regexp_extract(text, '{wording.MAKER}', 1), '(?i)gleichwertig|nach\\s+wahl') THEN nullif(trim(regexp_extract(text, '{wording.MAKER}', 1)), '') END AS maker FROM x
""")
def roles_from_text(t):
    return line_texts(t).select("text", "n", wording.role(F.col("text")).alias("role"), wording.stated_manufacturer(F.col("text")).alias("maker"))


@query(f"""
WITH {LINE_TEXTS}, s AS (SELECT text, regexp_replace(text, '{wording.PRICE_COLUMNS}', '') AS r FROM x), u AS (SELECT text, string_split_regex(r, '{wording.SUMMARY_WORDS}')[1] AS r FROM s),
v AS (SELECT text, regexp_replace(regexp_replace(r, '(?i)\\s+\\d+\\s+zu\\s+LV-Pos\\.?:?\\s*$', ''), '([\\p{{L}}\\p{{N}}])-\\s+([\\p{{L}}\\p{{N}}])', '\\1-\\2', 'g') AS r FROM u)
SELECT text, trim(regexp_replace(r, '\\s+', ' ', 'g')) AS description, CASE WHEN regexp_matches(text, '(?i)^[.,;:]?\\s*[A-Z0-9][A-Z0-9._/-]{{4,}}$') AND regexp_matches(text, '[0-9]') THEN regexp_extract(text, '(?i)^[.,;:]?\\s*([A-Z0-9][A-Z0-9._/-]{{4,}})$', 1) END AS article FROM v
""")
def price_column_texts(t):
    return line_texts(t).select("text", wording.after_price_columns(F.col("text")).alias("description"), wording.leading_article(F.col("text")).alias("article"))


@query(f"""
WITH {LINE_TEXTS} SELECT text, CASE WHEN regexp_matches({CLEAN_SQL}, '{wording.ANCHOR}') THEN concat_ws('.', regexp_extract({CLEAN_SQL}, '{wording.ANCHOR}', 1)::BIGINT, regexp_extract({CLEAN_SQL}, '{wording.ANCHOR}', 2)::BIGINT, regexp_extract({CLEAN_SQL}, '{wording.ANCHOR}', 3)::BIGINT) END AS number,
  CASE WHEN regexp_matches({CLEAN_SQL}, '{wording.ANCHOR}') THEN regexp_matches(trim(regexp_extract({CLEAN_SQL}, '{wording.ANCHOR}', 4)), '^\\d+\\b') END AS fourth_level,
  CASE WHEN regexp_matches({CLEAN_SQL}, '^\\d+\\.\\s+\\d{{3}}\\s+\\S') THEN 1 WHEN regexp_matches({CLEAN_SQL}, '^\\d+\\.\\d+\\.\\s+\\d{{3}}\\.\\d+\\s+\\S') THEN 2 END AS level FROM x
""")
def basis_anchors(t):
    a = wording.basis_anchor(F.col("text"))
    return line_texts(t).select("text", a["number"].alias("number"), a["fourth_level"].alias("fourth_level"), wording.section_level(F.col("text")).alias("level"))
