"""Queries on decisions, memory, uploads, runs and pages."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import decisions as ops
from bidloom.operators import history, sequences, views
from bidloom.plans.codes import codes_sql, pick, pick_sql
from bidloom.plans.registry import query

LAYERS = ["FACT", "RULE_CANDIDATE", "RULE"]


@query(f"""
WITH r AS (SELECT p_partkey AS record, p_partkey % 50 AS project, {pick_sql(LAYERS, 'p_size')} AS layer, p_size % 7 > 0 AS active, CASE WHEN p_size % 3 > 0 THEN p_brand END AS b, CASE WHEN p_size % 4 > 0 THEN p_type END AS ty, CASE WHEN p_size % 5 = 0 THEN p_size % 2 END AS at, CASE WHEN p_size % 6 > 0 THEN p_size % 4 END AS ctx FROM part),
s AS (SELECT s_suppkey AS scope, s_suppkey % 50 AS project, CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || s_suppkey % 25 END AS b, {pick_sql(["ECONOMY", "SMALL", None], 's_suppkey')} AS ty, s_suppkey % 2 AS at, s_suppkey % 4 AS c1, s_suppkey % 3 AS c2 FROM supplier)
SELECT record, scope FROM r JOIN s USING (project) WHERE active AND layer <> 'RULE_CANDIDATE' AND (r.b IS NULL OR s.b IS NULL OR r.b = s.b) AND (r.ty IS NULL OR s.ty IS NULL OR r.ty = s.ty) AND (r.at IS NULL OR r.at = s.at) AND (ctx IS NULL OR ctx = c1 OR ctx = c2)
""")
def relevant_memory(t):
    z, s = F.col("p_size"), F.col("s_suppkey")
    said = lambda c: c.cast("string")
    none = F.create_map().cast("map<string,string>")
    records = t.part.select(
        F.col("p_partkey").alias("record"), (F.col("p_partkey") % 50).alias("project"), pick(LAYERS, z).alias("layer"), (z % 7 > 0).alias("active"), F.when(z % 3 > 0, F.col("p_brand")).alias("brand"), F.when(z % 4 > 0, F.col("p_type")).alias("kind"),
        F.when(z % 5 == 0, F.create_map(F.lit("size"), said(z % 2))).otherwise(none).alias("attributes"), F.when(z % 6 > 0, F.array(said(z % 4))).otherwise(F.array().cast("array<string>")).alias("context"),
    )
    scopes = t.supplier.select(s.alias("scope"), (s % 50).alias("project"), F.when(s % 2 == 0, F.concat(F.lit("Brand#"), said(s % 25))).alias("brand"), pick(["ECONOMY", "SMALL", None], s).alias("kind"), F.create_map(F.lit("size"), said(s % 2), F.lit("x"), F.lit("y")).alias("attributes"), F.array(said(s % 4), said(s % 3)).alias("context"))
    return ops.relevant_memory(records, scopes, ["brand", "kind"])


REASON_RULES = [
    ("DECISION_REASON_REQUIRED", "n = 0"), ("DUPLICATE_DECISION_REASON", "n = 3"), ("DECISION_REASON_UNKNOWN", "n > 0 AND a = 9 OR n > 1 AND b = 9"), ("DECISION_REASON_INACTIVE", "n > 0 AND a % 4 = 0 AND a < 9 OR n > 1 AND b % 4 = 0 AND b < 9"),
    ("DECISION_REASON_MULTIPLE_NOT_ALLOWED", "n > 1 AND a <> b AND (a % 3 = 0 AND a < 9 OR b % 3 = 0 AND b < 9)"), ("DECISION_COMMENT_REQUIRED", "(n > 0 AND a % 2 = 1 AND a < 9 OR n > 1 AND b % 2 = 1 AND b < 9) AND k % 5 > 0"),
]


@query(f"WITH d AS (SELECT o_orderkey AS k, o_orderkey % 4 AS n, o_orderkey % 10 AS a, o_custkey % 10 AS b FROM orders) SELECT k, array_to_string({codes_sql(REASON_RULES)}, ',') AS errors FROM d")
def decision_reasons(t):
    k = F.col("o_orderkey")
    a, b = k % 10, F.col("o_custkey") % 10
    d = t.orders.select(k.alias("k"), F.when(k % 4 == 0, F.array().cast("array<bigint>")).when(k % 4 == 1, F.array(a)).when(k % 4 == 2, F.array(a, b)).otherwise(F.array(a, b, a)).alias("reasons"), F.when(k % 5 == 0, "why").otherwise(" ").alias("comment"))
    d = d.withColumn("reasons", F.when((F.size("reasons") == 2) & (F.col("reasons")[0] == F.col("reasons")[1]), F.slice("reasons", 1, 1)).otherwise(F.col("reasons")))
    code = F.col("n_nationkey").cast("bigint")
    catalog = t.nation.filter("n_nationkey < 9").select(code.alias("code"), (code % 4 > 0).alias("active"), (code % 3 > 0).alias("allows_multiple"), (code % 2 == 1).alias("requires_comment"))
    return ops.reason_errors(d, catalog, "k").withColumn("errors", F.array_join("errors", ","))


@query("""
WITH l AS (SELECT o_orderkey AS k, list(DISTINCT l_partkey) AS ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'SUPPLIER_OPTION_NOT_FOUND' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'SELECTED_OPTION_REQUIRED' WHEN o_orderkey % 3 > 0 AND (o_orderkey % 5 = 0 OR (o_orderkey % 4 = 0 AND NOT list_contains(list_filter(ids, lambda x: x IS NOT NULL), o_orderkey % 100))) THEN 'SELECTED_BUNDLE_LINES_INVALID'
  WHEN o_custkey % 8 = 5 THEN 'REJECTED_OPTION_INVALID' END AS error FROM orders JOIN l ON k = o_orderkey
""")
def selection_errors(t):
    k = F.col("o_orderkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ids"))  # an option's lines
    d = t.orders.join(lines, "o_orderkey", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    chosen = F.when(k % 5 == 0, F.array().cast("array<bigint>")).when(k % 4 == 0, F.array(k % 100)).otherwise(F.slice("ids", 1, 1))
    chosen = F.when((k % 5 > 0) & (k % 4 > 0) & (F.size("ids") == 0), F.array(F.lit(-1).cast("bigint"))).otherwise(chosen)
    own = F.when((k % 5 > 0) & (k % 4 > 0) & (F.size("ids") == 0), chosen).otherwise(F.col("ids"))
    picked = F.when((k % 7 == 0) | (k % 3 > 0), k)
    error = ops.selection_error(F.when(F.col("o_orderstatus") == "F", "SELECTED").otherwise("DEFERRED"), picked, k % 7 > 0, chosen, own, F.array(F.col("o_custkey") % 8), F.array(*(F.lit(x).cast("bigint") for x in (0, 1, 2, 3, 4, 6, 7))))
    return d.select("o_orderkey", error.alias("error"))


@query("""
WITH RECURSIVE f AS (SELECT o_custkey AS p, o_orderkey AS seq, o_orderkey % 11 = 0 AS bn, o_orderkey % 13 = 0 AS bt, o_orderkey % 17 = 0 AS bh, o_custkey * 10 + o_orderkey % 9 AS digest, (o_totalprice * 60)::BIGINT AS size, o_orderkey % 400 AS pages FROM orders),
o AS (SELECT *, CASE WHEN bn THEN 'NAME_INVALID' WHEN bt THEN 'TYPE_INVALID' WHEN bh THEN 'CONTENT_INVALID' WHEN size > 25000000 THEN 'FILE_TOO_LARGE' END AS own FROM f),
d AS (SELECT *, CASE WHEN own IS NULL AND row_number() OVER (PARTITION BY p, digest, own IS NULL ORDER BY seq) > 1 THEN 'DUPLICATE' ELSE own END AS o2, row_number() OVER (PARTITION BY p ORDER BY seq) AS i FROM o),
r AS (SELECT p, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS g, ''::VARCHAR AS outcome FROM (SELECT DISTINCT p FROM d)
  UNION ALL SELECT r.p, d.i, d.seq, r.n + x.ok, r.s + x.ok * d.size, r.g + x.ok * d.pages, x.why FROM r JOIN d ON d.p = r.p AND d.i = r.i + 1,
  LATERAL (SELECT w.why, CASE WHEN w.why = 'ACCEPTED' THEN 1 ELSE 0 END AS ok FROM (SELECT CASE WHEN d.o2 IS NOT NULL THEN d.o2 WHEN r.n + 1 > 30 THEN 'TOO_MANY_FILES' WHEN r.s + d.size > 60000000 THEN 'PROJECT_TOO_LARGE' WHEN r.g + d.pages > 2000 THEN 'TOO_MANY_PAGES' ELSE 'ACCEPTED' END AS why) w) x)
SELECT p, seq, outcome FROM r WHERE i > 0
""")
def upload_outcomes(t):
    k = F.col("o_orderkey")
    files = t.orders.select(
        F.col("o_custkey").alias("p"), k.alias("seq"), F.when(k % 11 == 0, "a.txt").otherwise("a.PDF").alias("name"), F.when(k % 13 == 0, "text/plain").otherwise("application/pdf").alias("mime"), F.when(k % 17 == 0, "PK").otherwise("%PDF-1.7").alias("head"),
        (F.col("o_custkey") * 10 + k % 9).cast("string").alias("sha256"), F.round(F.col("o_totalprice") * 60).cast("long").alias("size"), (k % 400).alias("pages"),
    )
    return ops.upload_outcomes(files, "p", ["seq"])


@query("""
WITH l AS (SELECT user_id AS document, event_id % 20 AS page, event_id AS seq, event_type = 'signup' AS a, CASE WHEN event_type = 'click' THEN value END AS q FROM events),
g AS (SELECT document, page, min(seq) FILTER (WHERE a) AS anchor, min(seq) FILTER (WHERE q IS NOT NULL) AS qs, arg_min(q, seq) FILTER (WHERE q IS NOT NULL) AS q FROM l GROUP BY 1, 2),
p AS (SELECT c_custkey * 20 + x AS position, c_custkey AS document, x AS page, (c_custkey + x) % 3 > 0 AS incomplete, (c_custkey * 7 + x) % 100 / 100.0::DOUBLE AS bottom FROM customer, range(20) r(x))
SELECT position, q AS quantity, qs AS from_seq FROM p JOIN g ON g.document = p.document AND g.page = p.page + 1 WHERE incomplete AND bottom >= 0.75 AND qs IS NOT NULL AND (anchor IS NULL OR qs < anchor)
""")
def page_continuations(t):
    lines = t.events.select(F.col("user_id").alias("document"), (F.col("event_id") % 20).alias("page"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("is_anchor"), F.when(F.col("event_type") == "click", F.col("value")).alias("quantity"))
    c, x = F.col("c_custkey"), F.col("x")
    positions = t.customer.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("x")).select((c * 20 + x).alias("position"), c.alias("document"), x.cast("long").alias("page"), ((c + x) % 3 > 0).alias("incomplete"), ((c * 7 + x) % 100 / F.lit(100.0)).alias("bottom"))
    return ops.continuations(positions, lines)


@query("""
WITH y AS (SELECT l_orderkey AS k, (l_partkey % 50 + 50) / 100.0::DOUBLE AS y FROM lineitem), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY k ORDER BY y) >= 0.018 THEN 1 ELSE 0 END AS new FROM y),
s AS (SELECT k, y, sum(new) OVER (PARTITION BY k ORDER BY y ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT k, s, min(y) AS top, count(*) AS n FROM s GROUP BY 1, 2)
SELECT k, top AS footer_top FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS rn FROM c) WHERE rn = 1 AND top >= 0.9 AND n >= 2
""")
def footer_tops(t):
    return ops.footer_tops(t.lineitem.select(F.col("l_orderkey").alias("k"), ((F.col("l_partkey") % 50 + 50) / F.lit(100.0)).alias("y")), ["k"], "y")


@query("""
SELECT 'day' AS asked, event_id, s_nationkey AS supplier FROM events LEFT JOIN supplier ON s_suppkey = user_id WHERE user_id % 3 = 1 AND event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05'
UNION ALL SELECT 'supplier', event_id, s_nationkey FROM events JOIN supplier ON s_suppkey = user_id WHERE s_nationkey = 15
""")
def filtered_history(t):
    d = t.events.select("event_id", (F.col("user_id") % 3).alias("actor"), F.col("user_id").alias("option"), F.col("event_type").alias("outcome"), F.col("ts").alias("decided_at"))
    options = t.supplier.select(F.col("s_suppkey").alias("option"), F.col("s_nationkey").alias("supplier"))
    by_day = ops.history_filter(d, options, actor=1, outcome="click", day=datetime.date(2024, 1, 5), supplier=None).withColumn("asked", F.lit("day"))
    return by_day.unionByName(ops.history_filter(d, options, supplier=15).withColumn("asked", F.lit("supplier"))).select("asked", "event_id", "supplier")


@query(f"""
WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS previous, {pick_sql(["F", "O", "P"], 'o_orderkey')} AS corrected, o_orderkey % 4 = 0 AS reviewed FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, previous, corrected, previous <> corrected AS outcome_changed, CASE WHEN previous <> corrected AND corrected = 'F' AND NOT reviewed THEN 'UNSAFE' WHEN previous <> corrected THEN 'CHANGED' ELSE 'SAFE' END AS verdict FROM x
""")
def audit_verdicts(t):
    k = F.col("o_orderkey")
    before = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("status"))
    after = t.orders.filter(k % 2 == 0).select(k.alias("k"), pick(["F", "O", "P"], k).alias("status"), (k % 4 == 0).alias("reviewed"))
    return ops.audit(before, after, "k", "status", ["F"])


@query("""
WITH s AS (SELECT o_custkey AS run, o_orderkey AS seq, o_orderkey % 5 AS step, o_orderkey % 3 = 0 AS d, o_orderkey % 7 = 0 AS c, o_totalprice AS cost, o_orderkey % 23 = 0 AS blocked, o_orderkey % 29 > 0 AS check_ok FROM orders),
t AS (SELECT *, sum(CASE WHEN d OR c THEN 0 ELSE cost END) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM s), u AS (SELECT *, max(CASE WHEN NOT d AND NOT c AND (blocked OR NOT check_ok OR spent > 1000000) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stopped FROM t)
SELECT run, seq, 's' || seq AS step, CASE WHEN d THEN 'DONE' WHEN c THEN 'CACHED' WHEN stopped = 1 THEN 'STOPPED' ELSE 'RUN' END AS action FROM u
""")
def next_steps(t):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("s"), k.cast("string"))
    steps = t.orders.select(F.col("o_custkey").alias("run"), k.alias("seq"), name.alias("step"), k.cast("string").alias("cache_key"), F.col("o_totalprice").alias("cost"), F.lit(1000000.0).alias("cost_limit"), (k % 23 == 0).alias("blocked"), (k % 29 > 0).alias("check_ok"))
    done = t.orders.filter(k % 3 == 0).select(F.col("o_custkey").alias("run"), name.alias("step"))
    return ops.next_steps(steps, done, t.orders.filter(k % 7 == 0).select(k.cast("string").alias("cache_key")))


@query("""
WITH o AS (SELECT l_partkey AS position, l_suppkey AS option, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1, 2), s AS (SELECT l_partkey AS position, max(l_suppkey) AS option FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1)
SELECT p_partkey AS position, CASE WHEN o.option IS NOT NULL THEN 'S' || o.option END AS supplier, total, CASE WHEN s.option IS NULL THEN 'UNSELECTED' WHEN o.option IS NULL THEN 'OPTION_LOST' ELSE 'SELECTED' END AS state FROM part LEFT JOIN s ON s.position = p_partkey LEFT JOIN o ON o.position = s.position AND o.option = s.option
""")
def export_lines(t):
    options = t.lineitem.filter("l_suppkey % 4 > 0").groupBy(F.col("l_partkey").alias("position"), F.col("l_suppkey").alias("option")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    options = options.withColumn("supplier", F.concat(F.lit("S"), F.col("option").cast("string")))
    chosen = t.lineitem.filter("l_partkey % 3 > 0").groupBy(F.col("l_partkey").alias("position")).agg(F.max("l_suppkey").alias("option"))
    return ops.export_lines(t.part.select(F.col("p_partkey").alias("position")), options, chosen)


@query("""
WITH p AS (SELECT c_custkey AS k, unnest(list_distinct([c_custkey % 10, c_custkey % 7, c_custkey % 10])) AS ref FROM customer), h AS (SELECT n_nationkey % 12 AS ref, n_nationkey AS seq, n_name AS title, CASE WHEN n_nationkey % 3 > 0 THEN 'note ' || n_nationkey END AS note FROM nation)
SELECT c_custkey AS k, t AS titles, m AS notes FROM customer LEFT JOIN (SELECT k, string_agg(title, ',' ORDER BY seq) AS t, coalesce(string_agg(note, ',' ORDER BY seq), '') AS m FROM p JOIN h USING (ref) GROUP BY 1) x ON x.k = c_custkey
""")
def inherited_headings(t):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    positions = t.customer.select(k.alias("k"), F.array(k % 10, k % 7, k % 10).alias("refs"))
    headings = t.nation.select((n % 12).cast("long").alias("ref"), n.alias("seq"), F.col("n_name").alias("title"), F.when(n % 3 > 0, F.concat(F.lit("note "), n.cast("string"))).alias("note"))
    return history.inherited(positions, headings, "k").select("k", F.array_join("titles", ",").alias("titles"), F.array_join("notes", ",").alias("notes"))


@query("""
WITH i AS (SELECT s_nationkey AS g, s_suppkey AS seq, s_suppkey AS identity, lower(CASE s_suppkey % 3 WHEN 0 THEN 'Building' WHEN 1 THEN 'machinery 4' ELSE 'HOUSEHOLD 7 west' END) AS name FROM supplier), d AS (SELECT c_custkey AS document, c_nationkey AS g, CASE WHEN c_custkey % 11 > 0 THEN lower(c_mktsegment || ' ' || c_custkey % 10) ELSE '' END AS c FROM customer)
SELECT document, coalesce(arg_min(identity, seq) FILTER (WHERE c <> '' AND (contains(c, name) OR contains(name, c))), CASE WHEN count(identity) = 1 THEN min(identity) END) AS identity FROM d LEFT JOIN i USING (g) GROUP BY 1
""")
def project_clusters(t):
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    identities = t.supplier.select(F.col("s_nationkey").alias("g"), s.alias("seq"), s.alias("identity"), F.when(s % 3 == 0, "Building").when(s % 3 == 1, "machinery 4").otherwise("HOUSEHOLD 7 west").alias("name"))
    documents = t.customer.select(k.alias("document"), F.col("c_nationkey").alias("g"), F.when(k % 11 > 0, F.concat(F.col("c_mktsegment"), F.lit(" "), (k % 10).cast("string"))).otherwise(" ").alias("content"))
    return history.clustered(documents, identities, "g")


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', 0")
def restored_tables(t):
    taken = history.restored({"events": t.events, "orders": t.orders, "labels": t.labels}, ["labels"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in taken.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT 'sound' AS package, 'review' AS sheet, count(*) AS n FROM nation UNION ALL SELECT 'sound', 'history', count(*) FROM region UNION ALL SELECT 'broken', 'review', 0 UNION ALL SELECT 'broken', 'history', 0")
def review_sheets(t):
    out = None
    for package, problems in (("sound", t.orders.filter("o_orderkey < 0")), ("broken", t.orders)):
        sheets = history.review_sheets(t.nation, t.region, t.region, problems)
        for sheet in ("review", "history"):
            rows = sheets[sheet].agg(F.count("*").alias("n")).select(F.lit(package).alias("package"), F.lit(sheet).alias("sheet"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


MODES = ["LV", "UNRESOLVED_FIRST", "AUTOMATIC_FIRST", "SPREAD", "STATUS"]


@query("""
WITH s AS (SELECT l_partkey AS k, max(l_extendedprice) - min(l_extendedprice) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, m AS mode, CASE m WHEN 'LV' THEN 0 WHEN 'UNRESOLVED_FIRST' THEN CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END WHEN 'AUTOMATIC_FIRST' THEN CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END WHEN 'SPREAD' THEN -d ELSE n % 5 END::DOUBLE AS key FROM s, (VALUES ('LV'), ('UNRESOLVED_FIRST'), ('AUTOMATIC_FIRST'), ('SPREAD'), ('STATUS')) v(m)
""")
def list_orders(t):
    n = F.col("n")
    s = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("d"), F.count("*").alias("n"))
    keys = F.array(*(F.struct(F.lit(m).alias("mode"), views.order_keys(m, n % 3 == 0, n % 2 == 0, F.col("d"), n % 5).alias("key")) for m in MODES))
    return s.select("k", F.inline(keys))


GERMAN = ["Zange", "Äpfel", "apfel", "Apfel", "Straße", "Strasse", "Öl", "ofen", "Über", "uber", "Stück", "stuck"]
REPEATED = ["Rohr Rohr DN 50. Rohr DN 50.", "Bogen. Bogen. Ventil.", "a\nb\nb\nc", "plain", "Eins! Eins! Zwei?"]


def german_names(t):
    return t.part.groupBy(F.concat_ws(" ", pick(GERMAN, F.col("p_partkey")), F.col("p_size")).alias("name")).agg(F.count("*").alias("n"))


@query(f"""
SELECT name, n FROM (SELECT {pick_sql(GERMAN, 'p_partkey')} || ' ' || p_size AS name, count(*) AS n FROM part GROUP BY 1) ORDER BY name COLLATE de
""")
def german_order(t):
    return german_names(t).orderBy(text.german_order(F.col("name")))


@query(f"""
SELECT name, n FROM (SELECT {pick_sql(GERMAN, 'p_partkey')} AS word, p_size, {pick_sql(GERMAN, 'p_partkey')} || ' ' || p_size AS name, count(*) AS n FROM part GROUP BY ALL) ORDER BY (word || ' ' || lpad(p_size::VARCHAR, 18, '0')) COLLATE de
""")
def german_numeric_order(t):
    return german_names(t).orderBy(text.german_order(F.col("name"), numeric=True))


@query(f"""
SELECT {pick_sql(REPEATED, 'p_partkey')} AS raw, {pick_sql(["Rohr DN 50.", "Bogen. Ventil.", "a b c", "plain", "Eins! Zwei?"], 'p_partkey')} AS shown, count(*) AS n FROM part GROUP BY ALL
""")
def display_texts(t):
    d = t.part.groupBy(pick(REPEATED, F.col("p_partkey")).alias("raw")).agg(F.count("*").alias("n"))
    return d.select("raw", F.regexp_replace(text.collapse_sentences(F.col("raw")), r"\s+", " ").alias("shown"), "n")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS level_1, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS level_2 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY event_type = 'purchase'
""")
def headings_by_level(t):
    d, order = t.events, [F.col("ts"), F.col("event_id")]
    for name, kind in (("level_1", "signup"), ("level_2", "click")):
        d = sequences.as_of(d, ["user_id"], order, F.col("event_type") == kind, F.col("value"), name)
    return d.filter("event_type = 'purchase'").select("event_id", "level_1", "level_2")
