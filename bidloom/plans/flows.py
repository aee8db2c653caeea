"""Queries on replays, corrections, coverage, scans, manifests and exchange."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.operators import history, keyed, sequences
from bidloom.plans.codes import pick, pick_sql
from bidloom.plans.registry import query
from bidloom.sources import tables

ACTIONS = ["DEFER", "EDIT", "CONFIRM", "CLEAR"]
LOG_SQL = f"a AS (SELECT o_custkey AS k, o_orderkey AS seq, {pick_sql(ACTIONS, 'o_orderkey')} AS action, CASE WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'segment' END AS field, CASE WHEN o_orderkey % 7 > 0 THEN 'v' || o_orderkey % 9 END AS v, 'S' || o_orderkey % 4 AS status FROM orders)"


def lines_and_log(t):
    k = F.col("o_orderkey")
    lines = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("NEW").alias("verification_status"), F.array(F.lit("segment")).alias("locked_fields"))
    log = t.orders.select(F.col("o_custkey").alias("k"), k.alias("seq"), pick(ACTIONS, k).alias("action"), F.when(k % 3 == 0, "name").otherwise("segment").alias("field"), F.when(k % 7 > 0, F.concat(F.lit("v"), (k % 9).cast("string"))).alias("new_value"), F.concat(F.lit("S"), (k % 4).cast("string")).alias("status"))
    return lines, log


REPLAYED = f"""
{LOG_SQL}, r AS (SELECT k, arg_max(struct_pack(v := v), seq) FILTER (WHERE field = 'name') AS n, arg_max(struct_pack(v := v), seq) FILTER (WHERE field = 'segment') AS s, arg_max(status, seq) AS status FROM a WHERE action <> 'DEFER' GROUP BY 1),
lines AS (SELECT c_custkey AS k, CASE WHEN n IS NOT NULL THEN n.v ELSE c_name END AS name, CASE WHEN s IS NOT NULL THEN s.v ELSE c_mktsegment END AS segment, coalesce(status, 'NEW') AS verification_status, CASE WHEN n IS NOT NULL THEN 'segment,name' ELSE 'segment' END AS locked FROM customer LEFT JOIN r ON k = c_custkey)
"""


@query(f"WITH {REPLAYED} SELECT * FROM lines")
def replayed_lines(t):
    lines, log = lines_and_log(t)
    return history.replayed(lines, log, "k", ["name", "segment"], ["seq"]).withColumn("locked", F.array_join("locked_fields", ",")).drop("locked_fields")


@query(f"WITH {REPLAYED} SELECT k, name, segment FROM lines WHERE segment = 'v4'")
def lines_by_role(t):
    lines, log = lines_and_log(t)
    return history.replayed(lines, log, "k", ["name", "segment"], ["seq"]).filter("segment = 'v4'").select("k", "name", "segment")


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderkey % 3 AS x, CASE WHEN o_orderkey % 5 > 0 THEN 'n' || o_orderkey % 11 ELSE '' END AS v FROM orders), f AS (SELECT k, max(seq) AS m FROM a WHERE x = 0 GROUP BY 1), g AS (SELECT a.* FROM a JOIN f USING (k) WHERE seq < m OR x = 0),
b AS (SELECT a.k, a.seq, a.x, a.v, row_number() OVER (PARTITION BY a.k ORDER BY a.seq) AS n FROM a),
r AS (SELECT k, list(struct_pack(x := x, v := v) ORDER BY seq) AS l FROM a GROUP BY 1),
s AS (WITH RECURSIVE w AS (SELECT c_custkey AS k, 0 AS n, c_mktsegment AS v, c_custkey % 4 = 0 AS locked, 'NEW' AS status, NULL::VARCHAR AS error FROM customer
  UNION ALL SELECT w.k, b.n, CASE WHEN w.locked AND b.x > 0 THEN w.v WHEN b.x = 0 THEN w.v WHEN b.x = 1 THEN NULL ELSE b.v END, true, CASE WHEN w.locked AND b.x > 0 THEN w.status WHEN b.x = 0 THEN 'HUMAN_CONFIRMED' ELSE 'HUMAN_CORRECTED' END, CASE WHEN w.locked AND b.x > 0 THEN 'LOCKED' ELSE w.error END
  FROM w JOIN b ON b.k = w.k AND b.n = w.n + 1) SELECT k, arg_max(struct_pack(v := v, status := status, error := error, locked := locked), n) AS z FROM w GROUP BY 1)
SELECT k, z.v AS segment, z.status AS verification_status, z.error AS error, CASE WHEN z.locked THEN 1 ELSE 0 END AS n_locked FROM s
""")
def folded_reviews(t):
    """Several actions a line on one field: the first locks it, later ones may only confirm."""
    from bidloom.operators import rules

    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    lines = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.lit("NEW").alias("verification_status"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("segment"))).otherwise(none).alias("locked_fields"))
    actions = t.orders.select(F.col("o_custkey").alias("k"), k.alias("seq"), F.when(k % 3 == 0, "CONFIRM").when(k % 3 == 1, "CLEAR").otherwise("SET").alias("action"), F.when(k % 5 > 0, F.concat(F.lit("n"), (k % 11).cast("string"))).otherwise("").alias("new_value"))
    return rules.reviewed(lines, actions, "k", "segment", ["seq"]).select("k", "segment", "verification_status", "error", F.size("locked_fields").alias("n_locked"))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'segment' END AS field, 'v' || o_orderkey % 9 AS v, o_orderkey % 8 > 0 AS ok FROM orders),
r AS (SELECT k, arg_max(v, seq) FILTER (WHERE ok AND field = 'name') AS n, arg_max(v, seq) FILTER (WHERE ok AND field = 'segment') AS s, count(*) FILTER (WHERE ok) AS applied, count(*) FILTER (WHERE NOT ok) AS refused FROM a GROUP BY 1)
SELECT c_custkey AS k, coalesce(n, c_name) AS name, coalesce(s, c_mktsegment) AS segment, coalesce(applied, 0) AS applied, coalesce(refused, 0) AS refused, NULL::VARCHAR AS decision FROM customer LEFT JOIN r ON k = c_custkey
""")
def corrections_from_root(t):
    k = F.col("o_orderkey")
    root = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    log = t.orders.select(F.col("o_custkey").alias("k"), k.alias("seq"), F.when(k % 3 == 0, "name").otherwise("segment").alias("field"), F.concat(F.lit("v"), (k % 9).cast("string")).alias("value"))
    return history.corrected_from_root(root, log, "k", ["name", "segment"], ["seq"], F.col("seq") % 8 > 0)


@query("""
SELECT o_custkey AS k, round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 6) AS mean_or_zero, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS mean_or_null FROM orders GROUP BY 1
""")
def mean_confidences(t):
    return history.means(t.orders.withColumnRenamed("o_custkey", "k"), ["k"], F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).select("k", F.round("mean_or_zero", 6).alias("mean_or_zero"), F.round("mean_or_null", 6).alias("mean_or_null"))


@query("""
SELECT l_orderkey AS document, l_linenumber AS page, l_suppkey AS evidence_id, o_custkey AS revision, l_linenumber * 10 + l_orderkey % 7 AS run FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 > 0 AND l_linenumber % 2 = 1 AND o_orderstatus <> 'P'
""")
def evidence_runs(t):
    evidence = t.lineitem.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("evidence_id"))
    runs = t.lineitem.filter((F.col("l_orderkey") % 3 > 0) & (F.col("l_linenumber") % 2 == 1)).select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") * 10 + F.col("l_orderkey") % 7).alias("run")).distinct()
    revisions = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("revision"))
    return history.with_run_and_revision(evidence, runs, revisions).select("document", "page", "evidence_id", "revision", "run")


@query("""
WITH s AS (SELECT s_nationkey AS scope, s_suppkey % 10 AS k FROM supplier WHERE s_nationkey % 3 = 0)
SELECT c_custkey, c_nationkey AS scope FROM customer WHERE c_nationkey NOT IN (SELECT scope FROM s) OR EXISTS (SELECT 1 FROM s WHERE scope = c_nationkey AND k = c_custkey % 10)
""")
def limited_positions(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 10).alias("k"))
    limits = t.supplier.filter("s_nationkey % 3 = 0").select(F.col("s_nationkey").alias("scope"), (F.col("s_suppkey") % 10).alias("k"))
    return history.limited_to(rows, "k", limits, "scope").select("c_custkey", "scope")


@query("SELECT DISTINCT unnest([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END]) AS value FROM part EXCEPT SELECT NULL")
def filter_values(t):
    return history.distinct_values(t.part, F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), "value")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey * 3 % 20000 AS a, o_orderkey * 7 % 20000 AS b FROM orders), u AS (SELECT a AS id FROM o UNION SELECT b FROM o), l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT 'OPTION_LINE_UNKNOWN' AS code, id AS subject FROM u WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT 'LINE_UNLINKED', id FROM l WHERE id NOT IN (SELECT id FROM u)
UNION ALL SELECT 'PAGE_OUTSIDE', event_id FROM events LEFT JOIN customer ON c_custkey = user_id WHERE NOT coalesce(event_id % 12 BETWEEN 1 AND c_custkey % 10 + 1, false)
""")
def evidence_problems(t):
    k = F.col("o_orderkey")
    options = t.orders.select(F.array(k * 3 % 20000, k * 7 % 20000).alias("line_ids"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("line_id")).distinct()
    evidence = t.events.select(F.col("event_id").alias("evidence_id"), F.col("user_id").alias("document"), (F.col("event_id") % 12).alias("page"))
    pages = t.customer.select(F.col("c_custkey").alias("document"), (F.col("c_custkey") % 10 + 1).alias("page_count"))
    return history.evidence_problems(options, lines, evidence, pages)


@query(f"""
WITH d AS (SELECT s_nationkey AS project, s_suppkey AS document, {pick_sql(["ALL", "LISTED", "UNKNOWN"], 's_suppkey')} AS scope, s_suppkey % 6 AS listed, s_acctbal > 0 AS read FROM supplier), p AS (SELECT c_nationkey AS project, c_custkey AS position FROM customer),
j AS (SELECT p.*, document, read, CASE WHEN scope = 'ALL' OR (scope = 'LISTED' AND position % 6 = listed) THEN 'RELEVANT' WHEN scope = 'UNKNOWN' THEN 'POSSIBLE' END AS m FROM p LEFT JOIN d USING (project)),
g AS (SELECT project, position, coalesce(string_agg(document::VARCHAR, ',' ORDER BY document) FILTER (WHERE m = 'RELEVANT' AND read), '') AS read_documents, count(*) FILTER (WHERE m = 'RELEVANT' AND NOT read) AS unread, count(*) FILTER (WHERE m = 'POSSIBLE') AS possible FROM j GROUP BY 1, 2)
SELECT *, CASE WHEN unread > 0 OR read_documents = '' THEN 'INCOMPLETE' WHEN possible > 0 THEN 'UNKNOWN' ELSE 'COMPLETE' END AS status FROM g
""")
def position_coverage(t):
    k = F.col("s_suppkey")
    positions = t.customer.select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("position"))
    documents = t.supplier.select(F.col("s_nationkey").alias("project"), k.alias("document"), pick(["ALL", "LISTED", "UNKNOWN"], k).alias("scope"), (k % 6).alias("listing"), (F.col("s_acctbal") > 0).alias("read"))
    return history.coverage(positions, positions.withColumn("listing", F.col("position") % 6), documents)


@query("""
WITH e AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT 'clean' AS package, k, v FROM e UNION ALL SELECT 'clean', k, v FROM i WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT 'conflicting', k, v FROM e
""")
def all_or_nothing_import(t):
    own = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    existing, incoming = own.filter("k % 2 = 0"), own.filter("k % 3 = 0")
    bad = incoming.withColumn("v", F.when(F.col("k") == 6, "other").otherwise(F.col("v")))
    clean = history.merged_or_refused(existing, incoming, ["k"], ["v"]).withColumn("package", F.lit("clean"))
    return clean.unionByName(history.merged_or_refused(existing, bad, ["k"], ["v"]).withColumn("package", F.lit("conflicting")))


@query("""
WITH c AS (SELECT event_id, user_id, value > 50 AS conflict FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0)
SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN CASE WHEN value > 50 THEN 'CONFLICT' ELSE 'DUPLICATE' END WHEN event_id % 3 = 0 THEN 'INSERT' ELSE 'UNCHANGED' END AS state FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0
""")
def immutable_states(t):
    """Which appended rows are new, known, unchanged, or in conflict with what is stored."""
    own = t.events.select("event_id", "value")
    incoming = own.filter("event_id % 3 = 0").withColumn("value", F.when(F.col("value") > 50, F.col("value") + 1).otherwise(F.col("value")))
    return keyed.merge_state(own.filter("event_id % 2 = 0"), incoming, "event_id", ["value"])


# Pages of a document: the lines of its text, twenty a page.
PAGES_SQL = """
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
p AS (SELECT doc_id AS document, (i // 20 + 1)::INTEGER AS page, string_agg(x, chr(10) ORDER BY i) AS content, count(*) AS items FROM l GROUP BY 1, 2)
"""


def text_pages(t):
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 20).cast("int")), lambda p: F.slice(lines, p * 20 + 1, 20))
    return t.documents.select(F.col("doc_id").alias("document"), F.posexplode(pages).alias("p", "x")).select("document", (F.col("p") + 1).alias("page"), F.array_join("x", "\n").alias("content"), F.size("x").cast("long").alias("items"))


@query(f"""
WITH {PAGES_SQL} SELECT document, page, length(content) AS chars, CASE WHEN length(content) >= 80 THEN CASE WHEN document % 3 = 0 THEN 'HYBRID' ELSE 'DIGITAL' END WHEN document % 3 = 0 THEN 'SCAN' ELSE 'UNREADABLE' END AS mode FROM p
""")
def page_modes(t):
    items = F.array(F.struct(F.col("content").alias("normalized_text")))
    d = text_pages(t).withColumns({"text_items": items, "image_count": F.when(F.col("document") % 3 == 0, 1).otherwise(0)})
    return tables.page_modes(d).select("document", "page", "chars", "mode")


METHODS = f"WITH {PAGES_SQL}, s AS (SELECT document, page, length(content) AS native, CASE WHEN document % 5 = 0 THEN page % 2 * 9 ELSE 0 END AS ocr, document % 17 = 0 AND page = 1 AS failed FROM p), b AS (SELECT DISTINCT document FROM s WHERE failed), m AS (SELECT *, CASE WHEN native >= 40 THEN 'NATIVE' WHEN ocr > 0 THEN 'OCR' END AS method FROM s WHERE document NOT IN (SELECT document FROM b))"


def scanned(t):
    return text_pages(t).select("document", "page", F.length("content").alias("native_chars"), F.when(F.col("document") % 5 == 0, F.col("page") % 2 * 9).otherwise(0).alias("ocr_chars"), ((F.col("document") % 17 == 0) & (F.col("page") == 1)).alias("failed"))


@query(f"{METHODS} SELECT document, page, method FROM m WHERE method IS NOT NULL")
def page_methods(t):
    return tables.page_methods(scanned(t))[0].select("document", "page", "method")


@query(f"{METHODS} SELECT document, NULL::INTEGER AS page, 'DOCUMENT_UNREADABLE' AS code FROM b UNION ALL SELECT document, page, 'PAGE_UNREADABLE' FROM m WHERE method IS NULL")
def scan_issues(t):
    return tables.page_methods(scanned(t))[1]


@query(f"""
WITH {PAGES_SQL}, s AS (SELECT *, CASE WHEN document % 9 > 0 THEN trim(content, ' ') ELSE '' END AS c FROM (SELECT *, max(page) OVER (PARTITION BY document) AS n FROM p) WHERE page <= 5 OR page IN (ceil(n / 3), ceil(n * 2 / 3), n)),
g AS (SELECT document, coalesce(string_agg(c, chr(10) ORDER BY page) FILTER (WHERE c <> ''), '') AS text, count(*) AS inspected, count(*) FILTER (WHERE length(c) >= 20) AS with_text, avg(CASE WHEN document % 4 = 0 THEN page * 10.0::DOUBLE END) AS ocr_mean FROM s GROUP BY 1),
x AS (SELECT *, CASE WHEN length(text) < 40 THEN CASE WHEN document % 2 = 0 THEN 'doc ' || document || ' end' ELSE text END ELSE text END AS best FROM g)
SELECT document, md5(best) AS digest, length(best) AS chars, inspected, with_text, ocr_mean FROM x
""")
def page_previews(t):
    numbered = text_pages(t).withColumn("n", F.max("page").over(W.partitionBy("document")))
    pages = numbered.filter(F.array_contains(sequences.sampled_pages(F.col("n")), F.col("page"))).drop("n").withColumns({"content": F.when(F.col("document") % 9 > 0, F.col("content")).otherwise(""), "ocr_confidence": F.when(F.col("document") % 4 == 0, F.col("page") * F.lit(10.0))})
    raw = t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("document"), F.concat(F.lit("BT (doc "), F.col("doc_id").cast("string"), F.lit(") Tj 0 0 Td (end) Tj ET")).alias("content"))
    raw = raw.withColumn("content", F.regexp_replace("content", r"\(doc ([0-9]+)\) Tj", r"(doc $1) Tj"))
    return tables.previews(pages, raw).select("document", F.md5("text").alias("digest"), "chars", "inspected", "with_text", "ocr_mean")


@query(f"""
WITH {PAGES_SQL}, g AS (SELECT document, count(*) AS pages, sum(length(content))::BIGINT AS chars, sum(items)::BIGINT AS items, string_agg(content, chr(10) ORDER BY page) FILTER (WHERE page <= 3) AS ft FROM p GROUP BY 1)
SELECT doc_id AS document, sha256(coalesce(text, '')) AS sha256, substring(sha256(coalesce(text, '')), 1, 16) AS document_id, pages, chars, items, md5(ft) AS first_text FROM documents JOIN g ON document = doc_id
""")
def document_inventory(t):
    digests = t.documents.select(F.col("doc_id").alias("document"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return tables.inventory(text_pages(t), digests).withColumn("first_text", F.md5("first_text"))


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN 'OTHER' ELSE p_brand END AS brand, p_type AS kind, CASE WHEN p_size % 5 = 0 THEN 'OPERATOR' ELSE 'LOW' END AS confidence, CASE WHEN p_size % 5 = 0 THEN 'SCAN' ELSE 'ROLE,SCAN' END AS risks FROM part
""")
def manifest_overrides(t):
    detected = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.lit("LOW").alias("confidence"), F.array(F.lit("ROLE"), F.lit("SCAN")).alias("risks"))
    overrides = t.part.filter("p_size % 5 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "OTHER").alias("brand"), F.lit(None).cast("string").alias("kind"))
    return tables.overlaid_manifest(detected, overrides, "k", ["brand", "kind"], "ROLE").withColumn("risks", F.array_join("risks", ","))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n_runs, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS n_issues FROM customer")
def state_defaults(t):
    k = F.col("c_custkey")
    stored = t.customer.select(k.alias("k"), F.when(k % 3 > 0, F.array(F.col("c_name"))).alias("runs"), F.when(k % 4 > 0, F.array(k, k)).alias("issues"))
    return tables.with_defaults(stored, ["runs", "issues"]).select("k", F.size("runs").alias("n_runs"), F.size("issues").alias("n_issues"))


@query("""
WITH s AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_partkey, l_suppkey, l_quantity) AS a, list(l_suppkey ORDER BY l_partkey, l_suppkey, l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT 'lines' AS output, k, unnest(range(0, len(a)))::INTEGER AS seq, unnest(a) AS value FROM s UNION ALL SELECT 'suppliers', k, unnest(range(0, len(b)))::INTEGER, unnest(b) FROM s
""")
def snapshot_outputs(t):
    rows = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity")))  # one order's lines
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(rows.alias("r"))
    s = s.select("k", F.transform("r", lambda x: F.struct(x["l_partkey"].alias("value"))).alias("a"), F.transform("r", lambda x: F.struct(x["l_suppkey"].alias("value"))).alias("b"))
    out = tables.snapshot_outputs(s, "k", {"lines": "a", "suppliers": "b"})
    return out["lines"].withColumn("output", F.lit("lines")).unionByName(out["suppliers"].withColumn("output", F.lit("suppliers")))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def package_round_trip(t):
    packed = tables.package_json(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_suppkey"])
    return tables.from_packages(packed, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query(f"""
WITH {PAGES_SQL} SELECT document, page, CASE WHEN document % 4 > 0 THEN length(content) END AS chars, round(document % 97 / 97.0::DOUBLE, 4) AS x FROM p
""")
def compact_requests(t):
    box = F.struct((F.col("document") % 97 / F.lit(97.0)).alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("width"), F.lit(0.3).alias("height"))
    pages = text_pages(t).select("document", "page", F.when(F.col("document") % 4 > 0, "DIGITAL").otherwise("SCAN").alias("mode"), F.array(F.struct(F.col("document").alias("item_id"), "content", box.alias("box"))).alias("items"))
    return tables.compact_request(pages).select("document", "page", F.length(F.col("items")[0]["content"]).alias("chars"), F.col("items")[0]["box"]["x"].alias("x"))


@query("""
SELECT o_orderkey AS document, 1 AS page, 0 AS seq, CASE WHEN o_orderkey % 3 > 0 THEN 'section_' || substring(sha256(o_orderkey || ':s' || o_orderkey % 2 || ':Title'), 1, 18) END AS section_id, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS quantity, CASE WHEN o_orderkey % 5 > 0 THEN 'm' END AS unit FROM orders
""")
def full_records(t):
    k = F.col("o_orderkey")
    key = F.concat(F.lit("s"), (k % 2).cast("string"))
    line = F.struct(F.when(k % 3 > 0, key).otherwise("none").alias("section"), F.when(k % 4 > 0, F.array("o_totalprice")).otherwise(F.array().cast("array<double>")).alias("quantity"), F.when(k % 5 > 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("unit"))
    return tables.full_records(t.orders.select(k.alias("document"), F.lit(1).alias("page"), F.create_map(key, F.lit("Title")).alias("sections"), F.array(line).alias("lines")))
