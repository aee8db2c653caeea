"""Queries on reviews, evidence, rules and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import geometry as g
from bidloom.functions import numbers, references, text
from bidloom.operators import evidence, keyed, matching, rules
from bidloom.plans.offers import LINE, LINE_SQL, OPTIONS, ROLES_SQL, options, role
from bidloom.plans.registry import query

LINES_SQL = f"l AS (SELECT *, {ROLES_SQL} AS role, CASE WHEN l_discount < 0.08 THEN l_extendedprice END AS total_price, CASE WHEN l_tax < 0.07 THEN l_extendedprice / l_quantity END AS unit_price, CASE WHEN l_tax > 0.01 THEN 1 END AS price_basis, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END AS group_id FROM lineitem)"


def lines(t):
    return t.lineitem.withColumns(
        {
            "role": role(),
            "total_price": F.when(F.col("l_discount") < 0.08, F.col("l_extendedprice")),
            "unit_price": F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice") / F.col("l_quantity")),
            "price_basis": F.when(F.col("l_tax") > 0.01, 1),
            "group_id": F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3),
            "quantity": F.col("l_quantity"),
            "continuation": F.col("l_linenumber") == 7,
            "n_evidence": F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(1),
            "completeness": F.when(F.col("l_partkey") % 9 == 0, "PRICED_OFFER").when(F.col("l_partkey") % 9 == 1, "NOT_OFFERED"),
        }
    )


BROKEN_SQL = [
    ("PRICE_NOT_PRINTED", "BLOCKING", "l_partkey % 9 = 0 AND total_price IS NULL AND unit_price IS NULL"),
    ("PRICE_DESPITE_STATUS", "WARNING", "l_partkey % 9 = 1 AND (total_price IS NOT NULL OR unit_price IS NOT NULL)"),
    ("BASIS_UNKNOWN", "BLOCKING", "total_price IS NOT NULL AND unit_price IS NOT NULL AND price_basis IS NULL"),
    ("ALTERNATIVE_WITHOUT_GROUP", "WARNING", "role = 'ALTERNATIVE' AND group_id IS NULL"),
    ("CONTINUATION", "WARNING", "l_linenumber = 7"),
    ("NO_EVIDENCE", "BLOCKING", "l_partkey % 50 = 0"),
]


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS severity, count(*) AS n FROM l WHERE {b}" for c, s, b in BROKEN_SQL))
def line_issues(t):
    return rules.issues(lines(t), "l_orderkey", rules.line_rules()).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"""
WITH {LINES_SQL} SELECT CASE WHEN l_partkey % 9 = 0 THEN 'PRICED_OFFER' WHEN l_partkey % 9 = 1 THEN 'NOT_OFFERED' WHEN total_price IS NOT NULL OR unit_price IS NOT NULL THEN 'PRICED_OFFER' ELSE 'OFFER_WITHOUT_PRICE' END AS completeness, count(*) AS n FROM l GROUP BY 1
""")
def offer_completeness(t):
    d = lines(t)
    c = rules.completeness(F.col("completeness"), F.col("role"), F.col("total_price").isNotNull() | F.col("unit_price").isNotNull(), F.col("l_linestatus"))
    return d.groupBy(c.alias("completeness")).agg(F.count("*").alias("n"))


@query(f"""
WITH {LINES_SQL}, b AS (SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_partkey % 50 = 0 AND role <> 'ALTERNATIVE') AS n_blocked FROM l GROUP BY 1) SELECT * FROM b
""")
def blocking_attached(t):
    d = lines(t).withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_partkey"))
    found = rules.issues(d, "line_id", [r for r in rules.line_rules() if r[0] == "NO_EVIDENCE"])
    tagged = evidence.with_blocking_issues(d, found, "line_id", ["ALTERNATIVE", "OPTIONAL"])
    return tagged.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(F.size("blocking") > 0).alias("n_blocked"))


STATUS_SQL = "CASE option % 6 WHEN 0 THEN 'CLEAR_RECOMMENDATION' WHEN 1 THEN 'PRICE_UNCLEAR' WHEN 2 THEN 'MATCHING_UNCLEAR' WHEN 3 THEN 'NO_OFFER' WHEN 4 THEN 'TECHNICAL_DEVIATION' ELSE 'DIFFERENT_SCOPE_OF_SUPPLY' END"
STATUSES = ["CLEAR_RECOMMENDATION", "PRICE_UNCLEAR", "MATCHING_UNCLEAR", "NO_OFFER", "TECHNICAL_DEVIATION", "DIFFERENT_SCOPE_OF_SUPPLY"]


def with_status(t):
    return options(t).withColumn("status", F.get(F.array(*map(F.lit, STATUSES)), (F.col("option") % 6).cast("int"))).withColumn("total", F.when(F.col("n_lines") == 1, F.col("total")))


@query(f"""
WITH {OPTIONS}, s AS (SELECT position, {STATUS_SQL} AS status, n_lines FROM o), r AS (
  SELECT position, count(*) FILTER (WHERE status = 'CLEAR_RECOMMENDATION' AND n_lines = 1) AS n_clear, bool_or(status = 'TECHNICAL_DEVIATION') AS a, bool_or(status = 'DIFFERENT_SCOPE_OF_SUPPLY') AS b, bool_or(status = 'MATCHING_UNCLEAR') AS c, bool_or(status = 'PRICE_UNCLEAR') AS d FROM s GROUP BY 1),
x AS (SELECT position, n_clear, CASE WHEN n_clear > 0 THEN 'CLEAR_RECOMMENDATION' WHEN a THEN 'TECHNICAL_DEVIATION' WHEN b THEN 'DIFFERENT_SCOPE_OF_SUPPLY' WHEN c THEN 'MATCHING_UNCLEAR' WHEN d THEN 'PRICE_UNCLEAR' ELSE 'NO_OFFER' END AS status FROM r)
SELECT *, status <> 'NO_OFFER' AS needs_operator FROM x
""")
def basis_recommendation(t):
    return rules.basis_recommendations(with_status(t), "position")


@query(f"""
WITH {OPTIONS}, s AS (SELECT {STATUS_SQL} AS status, option, quantity, n_lines, total FROM o)
SELECT status, count(*) AS n, count(*) FILTER (WHERE quantity >= 10 AND n_lines = 1 AND total > 5000 AND option % 5 <> 0) AS n_comparable, count(*) FILTER (WHERE quantity < 10 OR option % 5 = 0) AS n_review FROM s GROUP BY 1
""")
def comparable_gates(t):
    gates = [F.col("quantity") >= 10, F.col("n_lines") == 1, F.col("total") > 5000, F.col("option") % 5 != 0]
    return evidence.counted(with_status(t), ["status"], n=F.lit(True), n_comparable=rules.all_hold(*gates), n_review=rules.any_holds(~gates[0], ~gates[3]))


@query(f"""
WITH {OPTIONS}, s AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY total, option) AS rn, count(*) OVER (PARTITION BY position) AS n FROM o), b AS (SELECT position, option, total FROM s WHERE rn = 1),
h AS (SELECT b.*, CASE WHEN position % 7 <> 0 THEN CASE WHEN position % 2 = 0 THEN total ELSE total + 5 END END AS history FROM b)
SELECT CASE WHEN position % 11 = 0 THEN 'MANAGER_COMPLETED' WHEN position % 13 = 0 THEN 'MANAGER_PENDING' WHEN position % 3 = 0 AND history = total THEN 'AUTO_CONFIRMED_BY_HISTORY'
  WHEN position % 3 = 0 AND history IS NOT NULL THEN 'AUTO_LOWEST_BUT_HISTORY_DIFFERS' WHEN history IS NULL THEN 'HISTORICAL_EK_UNRESOLVED' WHEN option % 2 = 0 THEN 'INSUFFICIENT_COVERAGE' ELSE 'NOT_COMPARABLE' END AS class, count(*) AS n FROM h GROUP BY 1
""")
def history_backtest(t):
    best = matching.cheapest(options(t), "position", "option", "total")
    p = F.col("position")
    history = F.when(p % 7 != 0, F.when(p % 2 == 0, F.col("total")).otherwise(F.col("total") + 5))
    decision = F.when(p % 11 == 0, "SELECTED").when(p % 13 == 0, "DEFERRED")
    near = F.when(F.abs(F.col("total") - history) <= 0.01, F.col("option"))
    c = matching.backtest(decision, F.col("n_options"), p % 3 == 0, history, near, F.col("option"), F.col("option") % 2 == 0)
    return best.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(f"""
SELECT l_orderkey, string_agg(CASE role WHEN 'PRIMARY' THEN 'PRIMARY' WHEN 'MANDATORY_COMPONENT' THEN 'REQUIRED_COMPONENT' ELSE CASE WHEN n > 1 AND alla AND refs = 1 THEN CASE WHEN seq = 1 THEN 'PRIMARY' ELSE 'COMPONENT' END ELSE 'ALTERNATIVE' END END, ',' ORDER BY seq) AS roles FROM (
  SELECT *, count(*) OVER w AS n, bool_and(role = 'ALTERNATIVE') OVER w AS alla, count(DISTINCT l_linestatus) OVER w AS refs, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS seq FROM (SELECT *, {ROLES_SQL} AS role FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)) GROUP BY 1
""")
def display_roles(t):
    d = keyed.versions(t.lineitem, "l_orderkey", [F.col(c) for c in LINE], "seq").withColumns({"role": role(), "says_alternative": F.lit(False), "reference": F.col("l_linestatus")})
    shown = rules.display_roles(d, "l_orderkey", "seq")
    return shown.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "display_role"))), lambda r: r["display_role"]), ",").alias("roles"))


@query("""
WITH r AS (SELECT p_brand, min(p_partkey) AS f, count(*) AS n, p_brand LIKE '%3' AS c FROM part GROUP BY 1), o AS (SELECT *, coalesce(sum(CASE WHEN c THEN 0 ELSE n END) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(CASE WHEN c THEN 0 ELSE n END) OVER () AS t FROM r)
SELECT p_brand, n, c AS is_collapsed, least(off // 50 + 1, greatest(1, ceil(t / 50)))::BIGINT AS first_page, (CASE WHEN c THEN least(off // 50 + 1, greatest(1, ceil(t / 50))) ELSE (off + n - 1) // 50 + 1 END)::BIGINT AS last_page FROM o
""")
def collapsed_pagination(t):
    return evidence.collapsed_pages(t.part, "p_brand", "p_partkey", F.col("p_brand").endswith("3"), 50)


@query("""
WITH r AS (SELECT doc_id, CASE WHEN length(text) < 80 THEN CASE WHEN doc_id % 2 = 0 THEN 'SCAN' ELSE 'UNREADABLE' END WHEN doc_id % 2 = 0 THEN 'HYBRID' ELSE 'DIGITAL' END AS mode, length(text) AS c, length(text) // 40 AS i, 0.9 + doc_id % 10 / 100.0 AS g FROM documents)
SELECT doc_id, CASE WHEN mode = 'DIGITAL' OR (mode = 'HYBRID' AND c >= 160 AND i >= 20 AND g >= 0.97) THEN 'DETERMINISTIC_TEXT_LAYER' ELSE 'OCR_VISUAL' END AS primary, round(least(1, c / 800, i / 80, g)::DOUBLE, 6) AS confidence FROM r
""")
def extraction_routes(t):
    n = F.length("text")
    mode = F.when((n < 80) & (F.col("doc_id") % 2 == 0), "SCAN").when(n < 80, "UNREADABLE").when(F.col("doc_id") % 2 == 0, "HYBRID").otherwise("DIGITAL")
    geometry = F.round(F.lit(0.9) + (F.col("doc_id") % 10) / 100, 6)
    return t.documents.withColumn("r", rules.extraction_route(mode, n, F.floor(n / 40), geometry)).select("doc_id", "r.primary", F.round("r.confidence", 6).alias("confidence"))


@query("""
SELECT o_orderkey, o_orderkey % 4 <> 0 AS ready, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'NO_BASIS' END, CASE WHEN o_orderkey % 8 = 0 THEN 'NO_SUPPLIER' END], lambda x: x IS NOT NULL), ',') AS blocking,
  array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'LARGE' END, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END], lambda x: x IS NOT NULL), ',') AS warnings FROM orders
""")
def processing_preflight(t):
    d = rules.preflight(t.orders, [("NO_BASIS", F.col("o_orderkey") % 4 == 0), ("NO_SUPPLIER", F.col("o_orderkey") % 8 == 0)], [("LARGE", F.col("o_totalprice") > 300000), ("PENDING", F.col("o_orderstatus") == "P")])
    return d.select("o_orderkey", "ready", F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 3 THEN 'NEW' ELSE o_orderpriority END ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 9 = 6) THEN CASE WHEN o_orderkey % 9 = 6 THEN 'HUMAN_CONFIRMED' ELSE 'HUMAN_CORRECTED' END ELSE 'NEEDS_REVIEW' END AS verification_status,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_locked, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 AND o_orderkey % 9 <> 6 THEN 'LOCKED' END AS error FROM orders
""")
def reviewed_lines(t):
    none, lock = F.array().cast("array<string>"), F.array(F.lit("o_orderpriority"))
    d = t.orders.select("o_orderkey", "o_orderpriority", F.lit("NEEDS_REVIEW").alias("verification_status"), F.when(F.col("o_orderkey") % 5 == 0, lock).otherwise(none).alias("locked_fields"))
    k = F.col("o_orderkey") % 9
    actions = t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(k == 0, "CLEAR").when(k == 3, "SET").otherwise("CONFIRM").alias("action"), F.lit("NEW").alias("new_value"))
    return rules.reviewed(d, actions, "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderpriority", "verification_status", F.size("locked_fields").alias("n_locked"), "error")


@query("""
SELECT event_id, event_type NOT IN ('error', 'signup') OR length(props) >= 9 AS ok FROM events
""")
def decision_comments(t):
    return t.events.select("event_id", rules.decision_comment_ok(F.col("event_type"), F.col("props"), ["error", "signup"], 9, 2).alias("ok"))


@query("""
WITH i AS (SELECT conv_id, turn AS item_order, coalesce(text, '') AS text FROM conversations), w AS (SELECT conv_id, unnest(range(0, (SELECT max(turn) + 1 FROM conversations))) AS turn FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 > 0),
n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'MISSING' WHEN conv_id % 3 = 0 THEN 'VISUAL_ONLY_UNCONFIRMED' WHEN conv_id % 3 = 1 THEN 'CONFLICTING' ELSE 'VERIFIED_NATIVE' END AS status FROM n
""")
def evidence_status(t):
    k = F.concat_ws("-", "conv_id", "turn")
    items = t.conversations.select(k.alias("item_id"), F.col("turn").alias("item_order"), F.coalesce("text", F.lit("")).alias("content"), g.region(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.1)).alias("box"))
    own = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(k)).alias("ids"))
    none = F.array().cast("array<string>")
    ids = F.when(F.col("conv_id") % 3 == 0, none).when(F.col("conv_id") % 3 == 1, F.array_append("ids", F.lit("lost"))).otherwise(F.col("ids"))
    ev = own.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 2 == 0, "DIGITAL").otherwise("SCAN").alias("mode"), ids.alias("item_ids"))
    return evidence.canonical_evidence(ev, items).select(F.col("id").alias("conv_id"), "status")


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn DESC) AS roles FROM conversations GROUP BY 1
""")
def ordered_lookup(t):
    k = F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0"))
    owners = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(k), asc=False).alias("ids")).withColumn("ids", F.array_append("ids", F.lit("unknown")))
    rows = t.conversations.select(k.alias("key"), "role")
    return evidence.ordered_lookup(owners, "conv_id", "ids", rows, "key", ["role"]).select("conv_id", F.array_join(F.transform("rows", lambda r: r["role"]), ">").alias("roles"))


@query("""
WITH e AS (SELECT o_custkey AS basis_id, l_partkey AS line_id, o_orderkey AS link_id, o_orderstatus = 'P' AS un FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey),
a AS (SELECT basis_id, bool_or(NOT un) AS a FROM e GROUP BY 1)
SELECT basis_id, count(*) AS n FROM e JOIN a USING (basis_id) WHERE NOT un OR NOT a GROUP BY 1
""")
def linked_lines(t):
    lines_of = t.lineitem.groupBy(F.col("l_orderkey").alias("link_id")).agg(F.collect_set("l_partkey").alias("line_ids"))
    links = t.orders.select(F.col("o_orderkey").alias("link_id"), F.array("o_custkey").alias("basis_ids"), F.when(F.col("o_orderstatus") == "P", "UNMATCHED").otherwise("EXACT").alias("status")).join(lines_of, "link_id")
    return evidence.linked_lines(links, t.part.select(F.col("p_partkey").alias("line_id"))).groupBy("basis_id").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'Unbekannt' ELSE n_name END AS n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def label_lookup(t):
    labels = t.nation.filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return evidence.with_label(t.customer, "c_nationkey", labels, "n_name", "Unbekannt").select("c_custkey", "n_name")


@query("""
SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) AS basis, string_agg(n_nationkey, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 1) AS supplier, string_agg(n_nationkey, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 2) AS pending FROM nation GROUP BY 1
""")
def cluster_buckets(t):
    kinds = ["basis", "supplier", "pending"]
    d = t.nation.withColumn("kind", F.get(F.array(*map(F.lit, kinds)), F.col("n_nationkey") % 3))
    b = evidence.buckets(d, "n_regionkey", "kind", "n_nationkey", kinds)
    return b.select("n_regionkey", *(F.nullif(F.array_join(F.col(k).cast("array<string>"), ","), F.lit("")).alias(k) for k in kinds))


@query("""
SELECT o_orderkey, coalesce((SELECT arg_max(event_type, (ts, event_id)) FROM events WHERE user_id = o_custkey), o_orderstatus) AS status FROM orders
""")
def review_overlay(t):
    log = t.events.select(F.col("user_id").alias("o_custkey"), "ts", "event_id", "event_type")
    return evidence.overlay_latest(t.orders, log, "o_custkey", ["ts", "event_id"], "event_type", "o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query(f"""
SELECT l_partkey, l_orderkey, n AS occurrences FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_orderkey) AS rn FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)) WHERE rn = 1
""")
def best_line_version(t):
    d = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber").distinct().withColumn("evidence", F.array_repeat(F.lit("e"), F.col("l_linenumber")))
    return evidence.best_versions(d, "l_partkey", "evidence", "l_orderkey", ["l_orderkey"]).select("l_partkey", "l_orderkey", "occurrences")


@query("""
SELECT o_orderkey, substring(sha256(o_custkey || '|' || o_orderpriority || '|' || o_orderkey), 1, 18) AS idempotency_key, lag(substring(sha256(o_custkey || '|' || o_orderpriority || '|' || o_orderkey), 1, 18)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS depends_on FROM orders
""")
def plan_steps(t):
    return evidence.plan_steps(t.orders, "o_custkey", "o_orderkey", "o_orderpriority").select("o_orderkey", "idempotency_key", "depends_on")


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'CORRUPT' ELSE 'OK' END AS state FROM documents
""")
def backup_check(t):
    files = t.documents.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return evidence.verified_restore(files, t.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


@query("""
SELECT count(*) FILTER (WHERE s_acctbal > 0) AS accepted, count(*) FILTER (WHERE s_acctbal <= 0) AS refused, count(*) FILTER (WHERE s_acctbal > 9000) AS large, CAST(avg(s_suppkey) FILTER (WHERE s_acctbal > 9000) AS BIGINT) IS NOT NULL AS has_mean FROM supplier
""")
def batch_outcomes(t):
    d = evidence.counted(t.supplier, [], accepted=F.col("s_acctbal") > 0, refused=F.col("s_acctbal") <= 0, large=F.col("s_acctbal") > 9000)
    return d.withColumn("has_mean", F.col("large") > 0)


@query("""
SELECT user_id, round(sum(event_id % 1000) * 5 / 1e6 + sum(event_id % 100) * 30 / 1e6, 9) AS cost, round(coalesce(avg(value) FILTER (WHERE value > 10), 0), 4) AS mean_large FROM events GROUP BY 1
""")
def run_costs(t):
    cost = numbers.token_cost(F.sum(F.col("event_id") % 1000), F.lit(0), F.sum(F.col("event_id") % 100))
    return t.events.groupBy("user_id").agg(F.round(cost, 9).alias("cost"), F.round(F.coalesce(F.avg(F.when(F.col("value") > 10, F.col("value"))), F.lit(0.0)), 4).alias("mean_large"))


@query("""
SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (p_size = 20 AND p_partkey % 10 > 5)
""")
def version_range(t):
    key = references.version_key(F.concat_ws(".", "p_size", F.col("p_partkey") % 10))
    low, high = references.version_key(F.lit("10")), references.version_key(F.lit("20.5"))
    return t.part.filter((key >= low) & (key <= high)).select("p_partkey")


@query("""
SELECT p_partkey FROM part WHERE (p_size % 3 = 0 OR p_brand = 'Brand#7') AND (p_type = 'SMALL' OR p_partkey % 2 = 0)
""")
def scoped_memory(t):
    brand = F.when(F.col("p_size") % 3 != 0, F.lit("Brand#7"))
    wanted = F.create_map(F.lit("type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("SMALL"))
    return t.part.filter(rules.wildcard_equal(brand, F.col("p_brand")) & rules.map_within(wanted, F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")))).select("p_partkey")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_size % 2 = 0 AND p_type = 'SMALL' AND contains(p_name || ' ' || p_brand, 'bolt')
""")
def product_catalog(t):
    products = t.part.withColumn("status", F.when(F.col("p_size") % 2 == 0, "CONFIRMED").otherwise("DRAFT"))
    return rules.confirmed_products(products, "BOLT", ["p_name", "p_brand"], p_type="SMALL").select("p_partkey", "p_name")


@query("""
SELECT n_nationkey, n_regionkey IN (0, 1) OR n_nationkey % 4 = 0 OR n_regionkey = 2 AND n_nationkey % 2 = 0 AS compatible FROM nation
""")
def discipline_filter(t):
    project = F.when(F.col("n_nationkey") % 4 == 0, "UNKNOWN").otherwise("SANITAER")
    document = F.when(F.col("n_regionkey") == 0, "SANITAER").when(F.col("n_regionkey") == 1, "INSTALLATIONSSYSTEME").when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0), "UNKNOWN").otherwise("ELEKTRO")
    return t.nation.select("n_nationkey", rules.discipline_compatible(document, project).alias("compatible"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def fully_read_documents(t):
    docs = t.orders.withColumn("state", F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("OPEN"))
    issues = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "BLOCKING").otherwise("INFO").alias("severity"))
    return rules.fully_read(docs, issues, "o_orderkey").select("o_orderkey")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AND o_orderkey % 10 <> 0
""")
def machine_validated(t):
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.when(F.col("l_linestatus") == "F", "VERIFIED_NATIVE").otherwise("MISSING")).alias("evidence_status"))
    issues = t.orders.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("BLOCKING").alias("severity"))
    return rules.machine_validatable(own, issues, "o_orderkey").select("o_orderkey")


@query("""
SELECT doc_id FROM documents WHERE doc_id % 100 < 92 AND NOT regexp_matches(lower(text), '^(the|und)')
""")
def body_rows(t):
    return rules.body_rows(t.documents.withColumn("y", (F.col("doc_id") % 100) / 100.0), "y", 0.92, ["^the", "^und"], "text").select("doc_id")


@query("""
SELECT lang, count(*) FILTER (WHERE length(text) >= 80) / count(*) AS share FROM documents GROUP BY 1
""")
def routing_coverage(t):
    return t.documents.groupBy("lang").agg(F.avg(F.when(F.length("text") >= 80, 1.0).otherwise(0.0)).alias("share"))


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_partkey % 7 = 0 AND l_returnflag = 'N') AS subtotals FROM lineitem GROUP BY 1
""")
def subtotal_lines(t):
    words = F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_returnflag") == "N"), "Zwischensumme: 12").otherwise("Summenzähler DN 20")
    refs = references.effective_references(F.lit("kein"), F.lit(None).cast("string"))
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(text.is_subtotal(words, F.lit("PRIMARY"), refs)).alias("subtotals"))
