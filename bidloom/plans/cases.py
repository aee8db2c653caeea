"""Further queries: price discrepancies, revisions, agent issues, packages, audits, filters, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import numbers, references, text
from bidloom.operators import review, rules
from bidloom.plans.codes import codes_sql, pick, pick_sql
from bidloom.plans.registry import query

ROLES = ["PRIMARY", "MANDATORY_COMPONENT", "OPTIONAL", "PRIMARY", "ALTERNATIVE"]
SHOWN_SQL = f"""
l AS (SELECT l_orderkey AS k, l_partkey * 100 + l_linenumber AS id, {pick_sql(ROLES, 'l_partkey')} AS role, CASE WHEN l_suppkey % 7 > 0 THEN l_quantity END AS quantity, CASE WHEN l_suppkey % 5 > 0 THEN round(l_extendedprice / l_quantity, 2) END AS up,
  CASE WHEN l_suppkey % 6 > 0 THEN CASE WHEN l_suppkey % 11 = 0 THEN round(round(l_extendedprice / l_quantity, 2) * l_quantity * l_quantity, 2) ELSE l_extendedprice END END AS tp, CASE WHEN l_suppkey % 9 > 0 THEN 'EUR' END AS currency FROM lineitem WHERE l_orderkey % 5 > 0),
p AS (SELECT k, arg_min(struct_pack(tp := tp, up := up, q := quantity), (CASE WHEN role = 'PRIMARY' THEN 0 ELSE 1 END, id, role, coalesce(quantity, -1), coalesce(up, -1), coalesce(tp, -1))) AS m, count(*) AS n, count(DISTINCT id) AS nd,
  CASE WHEN count(*) FILTER (WHERE role IN ('PRIMARY', 'MANDATORY_COMPONENT')) > 0 AND count(*) FILTER (WHERE role IN ('PRIMARY', 'MANDATORY_COMPONENT') AND tp IS NULL) = 0 THEN sum(CAST(tp AS DECIMAL(18,2))) FILTER (WHERE role IN ('PRIMARY', 'MANDATORY_COMPONENT'))::DOUBLE END AS total,
  bool_or(role IN ('OPTIONAL', 'ALTERNATIVE')) AS opt, bool_or(role = 'MANDATORY_COMPONENT') AS man, bool_or((up IS NOT NULL OR tp IS NOT NULL) AND currency IS NULL) AS nocur FROM l GROUP BY 1),
j AS (SELECT o_orderkey AS k, m, coalesce(n, 0) AS n, coalesce(nd, 0) AS nd, total, opt, man, nocur, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS st, CASE WHEN o_orderkey % 3 > 0 THEN 1.0 END AS su, CASE WHEN o_orderkey % 8 = 0 THEN 'MISSING' ELSE 'SHOWN' END AS state, o_orderkey % 10 > 0 AS valid,
  CASE WHEN o_orderkey % 2 = 0 THEN total ELSE o_totalprice END AS ot FROM orders LEFT JOIN p ON p.k = o_orderkey)
"""
SHOWN_RULES = [
    ("SOURCE_GP_PRESENT_UI_MISSING", "m.tp IS NOT NULL AND st IS NULL"), ("SOURCE_EP_PRESENT_UI_MISSING", "m.up IS NOT NULL AND su IS NULL"), ("GP_PRESENT_MARKED_NO_PRICE", "m.tp IS NOT NULL AND state = 'MISSING'"), ("PRICE_WITHOUT_SOURCE", "st IS NOT NULL AND NOT valid"), ("OPTION_WITHOUT_REAL_LINE", "n = 0"),
    ("DUPLICATED_COMPONENT_PRICE", "nd < n"), ("WRONG_TOTAL_AGGREGATION", "abs(total - ot) > 0.02"), ("OPTIONAL_INCLUDED_IN_TOTAL", "abs(total - ot) > 0.02 AND opt"), ("REQUIRED_COMPONENT_EXCLUDED", "abs(total - ot) > 0.02 AND man"),
    ("QUANTITY_MULTIPLIED_TWICE", "abs(m.q) > 1.001 AND abs(m.tp - m.up * m.q * m.q) <= 0.02"), ("CURRENCY_UNKNOWN", "nocur"),
]


@query(f"WITH {SHOWN_SQL} SELECT k, array_to_string({codes_sql(SHOWN_RULES)}, ',') AS codes FROM j")
def price_discrepancies(t):
    s, q, x = F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice")
    up = F.round(x / q, 2)
    lines = t.lineitem.filter("l_orderkey % 5 > 0").select(
        F.col("l_orderkey").alias("k"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("id"), pick(ROLES, F.col("l_partkey")).alias("role"), F.when(s % 7 > 0, q).alias("quantity"), F.when(s % 5 > 0, up).alias("unit_price"),
        F.when(s % 6 > 0, F.when(s % 11 == 0, F.round(up * q * q, 2)).otherwise(x)).alias("total_price"), F.when(s % 9 > 0, "EUR").alias("currency"),
    )
    rows = F.array_sort(F.collect_list(F.struct("id", "role", "quantity", "unit_price", "total_price", "currency")))  # one option's lines
    grouped = lines.groupBy("k").agg(rows.alias("lines"))
    kind = dict(grouped.dtypes)["lines"]
    k = F.col("k")
    d = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice").join(grouped, "k", "left").withColumn("lines", F.coalesce("lines", F.array().cast(kind)))
    needed = F.filter("lines", lambda l: l["role"].isin("PRIMARY", "MANDATORY_COMPONENT"))
    total = F.when((F.size(needed) > 0) & ~F.exists(needed, lambda l: l["total_price"].isNull()), F.aggregate(needed, F.lit(0).cast("decimal(38,2)"), lambda a, l: (a + l["total_price"].cast("decimal(18,2)")).cast("decimal(38,2)")).cast("double"))
    d = d.withColumn("option_total", F.when(k % 2 == 0, total).otherwise(F.col("o_totalprice")))
    codes = review.price_discrepancies(F.col("lines"), F.when(k % 4 > 0, F.col("o_totalprice")), F.when(k % 3 > 0, 1.0), F.when(k % 8 == 0, "MISSING").otherwise("SHOWN"), k % 10 > 0, F.col("option_total"))
    return d.select("k", F.array_join(codes, ",").alias("codes"))


@query(f"""
WITH d AS (SELECT o_orderkey AS k, {pick_sql(["Projekt-A", "projekt a", "Other"], 'o_orderkey')} AS p, {pick_sql(["HEIZUNG", "MIXED", "HEIZUNG", "SANITAER"], 'o_orderkey // 3')} AS di, {pick_sql(["SUPPLIER_OFFER", "SPECIALIZED_SUPPLIER_OFFER", "BASIS"], 'o_orderkey // 2')} AS ro, 'S' || o_custkey % 20 AS su,
  CASE WHEN o_orderkey % 4 > 0 THEN 'N' || o_custkey % 3 END AS nr, CASE WHEN o_orderkey % 6 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dt, o_orderkey % 3 AS rev FROM orders),
r AS (SELECT *, CASE WHEN p = 'Other' THEN 'PROJECT_MISMATCH' WHEN di NOT IN ('HEIZUNG', 'MIXED') THEN 'DISCIPLINE_MISMATCH' WHEN ro = 'BASIS' THEN 'ROLE_NOT_SUPPLIER' WHEN dt > '1999-01-01' THEN 'AFTER_HISTORICAL_CUTOFF' END AS reason FROM d)
SELECT k, reason, CASE WHEN reason IS NOT NULL THEN 'EXCLUDED' WHEN row_number() OVER (PARTITION BY reason IS NULL, di, su, coalesce(nr, 'fam') ORDER BY coalesce(dt, '') DESC, rev DESC, k::VARCHAR DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state FROM r
""")
def revision_selection(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t.orders.select(
        k.alias("k"), pick(["Projekt-A", "projekt a", "Other"], k).alias("project_key"), pick(["HEIZUNG", "MIXED", "HEIZUNG", "SANITAER"], F.floor(k / 3)).alias("discipline"), pick(["SUPPLIER_OFFER", "SPECIALIZED_SUPPLIER_OFFER", "BASIS"], F.floor(k / 2)).alias("role"),
        F.concat(F.lit("S"), (c % 20).cast("string")).alias("supplier"), F.when(k % 4 > 0, F.concat(F.lit("N"), (c % 3).cast("string"))).alias("offer_number"), F.lit("fam").alias("family"), F.when(k % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("document_date"), (k % 3).alias("revision"), k.cast("string").alias("revision_id"),
    )
    return review.selected_revisions(d, F.lit("PROJEKT A"), F.lit("HEIZUNG"), F.lit("1999-01-01")).select("k", "reason", "state")


STATUS = ["CLEAR_RECOMMENDATION", "TECHNICAL_DEVIATION", "DIFFERENT_SCOPE_OF_SUPPLY", "PRICE_UNCLEAR", "MATCHING_UNCLEAR", "DECISION_REQUIRED", "NOT_COMPARABLE", "NO_OFFER"]
ISSUES_SQL = f"i AS (SELECT p_partkey AS k, CASE WHEN p_size % 9 = 0 THEN 'MANDATORY_COMPONENT_MISSING' ELSE CASE {pick_sql(STATUS, 'p_partkey')} {' '.join(f'''WHEN '{s}' THEN '{i}' ''' for s, i in review.AGENT_ISSUES.items())} END END AS code FROM part)"


@query(f"""
WITH {ISSUES_SQL}, s AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase'), m AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click')
SELECT k, code, k IN (SELECT k FROM s) OR (code = 'MATCHING_AMBIGUOUS' AND k IN (SELECT k FROM m)) AS resolved FROM i WHERE code IS NOT NULL
""")
def agent_issues(t):
    issues = t.part.select(F.col("p_partkey").alias("k"), review.agent_issue(pick(STATUS, F.col("p_partkey")), F.col("p_size") % 9 == 0).alias("code")).filter("code is not null")
    acted = t.events.groupBy(F.col("user_id").alias("k")).agg(F.bool_or(F.col("event_type") == "purchase").alias("selected"), F.bool_or(F.col("event_type") == "click").alias("confirmed"))
    settled = F.col("selected") | (F.col("code").isin(review.MATCH_ISSUES) & F.col("confirmed"))
    return issues.join(acted, "k", "left").select("k", "code", F.coalesce(settled, F.lit(False)).alias("resolved"))


@query(f"""
WITH k AS (SELECT l_orderkey AS link_id, {pick_sql(["ONE_TO_ONE", "MANY_TO_MANY", "ONE_TO_MANY"], 'l_orderkey')} AS kind, {pick_sql(["EXACT", "REQUIRED_COMPONENT"], 'l_orderkey // 2')} AS status, l_orderkey % 5 = 0 AS confirmed, l_orderkey % 40 AS pos, l_partkey AS id, {pick_sql(["PRIMARY", "OPTIONAL", "PRIMARY"], 'l_partkey')} AS role FROM lineitem)
SELECT 'UNCONFIRMED_MANY_TO_MANY' AS code, link_id::VARCHAR AS subject FROM (SELECT DISTINCT link_id FROM k WHERE kind = 'MANY_TO_MANY' AND NOT confirmed) UNION ALL SELECT 'OPTIONAL_AS_MANDATORY', id::VARCHAR FROM k WHERE role = 'OPTIONAL' AND status = 'REQUIRED_COMPONENT'
UNION ALL SELECT 'PRIMARY_IN_SEVERAL_POSITIONS', id::VARCHAR FROM (SELECT id FROM k WHERE role = 'PRIMARY' GROUP BY id HAVING min(pos) <> max(pos))
""")
def matching_self_check(t):
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    lines = F.collect_list(F.struct(p.alias("id"), pick(["PRIMARY", "OPTIONAL", "PRIMARY"], p).alias("role")))  # one link's lines
    links = t.lineitem.groupBy("l_orderkey").agg(lines.alias("lines"))
    d = links.select(k.alias("link_id"), pick(["ONE_TO_ONE", "MANY_TO_MANY", "ONE_TO_MANY"], k).alias("kind"), pick(["EXACT", "REQUIRED_COMPONENT"], F.floor(k / 2)).alias("status"), (k % 5 == 0).alias("confirmed"), F.array(k % 40).alias("positions"), "lines")
    return review.self_check_matching(d)


PRICE_STATES = ["SHOWN", "MISSING", "UNIT_PRICE_ONLY", "SYSTEM_CALCULATED_TOTAL", "SHOWN", "SHOWN"]


@query(f"""
WITH g AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'A') AS need, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F') AS tot, sum(l_linenumber) AS z FROM lineitem WHERE l_orderkey % 9 > 0 GROUP BY 1),
j AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(need, 0) AS need, coalesce(tot, 0) AS tot, o_orderkey % 2 = 0 AS sc, o_orderkey % 3 > 0 AS bo, {pick_sql(["COMPLETE_MATERIAL_SCOPE", "PARTIAL_MATERIAL_SCOPE", "UNKNOWN"], 'o_orderkey // 2')} AS scope, o_orderkey % 5 > 1 AS choice, {pick_sql(PRICE_STATES, 'o_orderkey')} AS state FROM orders LEFT JOIN g ON g.k = o_orderkey),
c AS (SELECT *, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN sc AND bo AND scope = 'COMPLETE_MATERIAL_SCOPE' THEN 'COMPLETE' WHEN NOT choice THEN CASE WHEN scope = 'PARTIAL_MATERIAL_SCOPE' THEN 'PARTIAL' ELSE 'COMPLETE' END WHEN need <= 1 AND NOT sc THEN 'PRIMARY_ONLY' ELSE 'PARTIAL' END AS pc FROM j)
SELECT k, pc AS completeness, CASE WHEN state = 'MISSING' THEN 'NO_PRICE' WHEN state = 'UNIT_PRICE_ONLY' THEN 'SOURCE_EP_ONLY' WHEN state = 'SYSTEM_CALCULATED_TOTAL' THEN 'CALCULATED_EP_X_QUANTITY' WHEN pc = 'PARTIAL' AND tot > 1 THEN 'PARTIAL_BUNDLE_SUM' WHEN k % 4 > 0 AND tot > 1 THEN 'BUNDLE_SUM' ELSE 'SOURCE_GP' END AS provenance,
  (CASE pc WHEN 'COMPLETE' THEN k % 4 WHEN 'PRIMARY_ONLY' THEN least(1, k % 4) ELSE greatest(0, k % 4 - greatest(k % 3, CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END)) END)::BIGINT AS covered FROM c
""")
def package_states(t):
    flag = F.col("l_returnflag") != "A"
    g = t.lineitem.filter("l_orderkey % 9 > 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(flag).alias("need"), F.count_if(flag & (F.col("l_linestatus") == "F")).alias("tot"))
    d = t.orders.select(F.col("o_orderkey").alias("k")).join(g, "k", "left").na.fill(0, ["n", "need", "tot"])
    k, c = F.col("k"), F.col
    scope = pick(["COMPLETE_MATERIAL_SCOPE", "PARTIAL_MATERIAL_SCOPE", "UNKNOWN"], F.floor(k / 2))
    d = d.withColumn("completeness", review.package(c("n"), k % 2 == 0, k % 3 > 0, scope, k % 5 > 1, c("need")))
    return d.select("k", "completeness", review.price_provenance(pick(PRICE_STATES, k), c("completeness"), F.when(k % 4 > 0, "PACKAGE_TOTAL").otherwise("LINE"), c("tot")).alias("provenance"), review.covered_components(c("completeness"), k % 4, k % 3).cast("long").alias("covered"))


@query("SELECT p_brand, string_agg(p_name, ',' ORDER BY p_size, p_partkey) AS reasons FROM part WHERE p_size % 2 = 0 AND p_size < 12 GROUP BY 1")
def active_reasons(t):
    rows = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey", "p_name")))  # a catalogue's active reasons
    return t.part.filter("p_size % 2 = 0 AND p_size < 12").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda r: r["p_name"]), ",").alias("reasons"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 6 <> 0")
def leaf_positions(t):
    return rules.leaves(t.part.withColumn("heading", F.col("p_size") % 6 == 0)).select("p_partkey", "p_name")


@query("""
WITH l AS (SELECT l_partkey AS k, string_agg(DISTINCT s_name, ' ' ORDER BY s_name) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT p_partkey, contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, names)), 'supplier#000000003') AS hit FROM part LEFT JOIN l ON k = p_partkey
""")
def comparison_search(t):
    named = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_name").distinct()
    names = named.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), " ").alias("names"))  # a position's suppliers
    d = t.part.join(names, F.col("p_partkey") == F.col("l_partkey"), "left")
    return d.select("p_partkey", text.search_contains(F.lit("SUPPLIER#000000003"), F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("names")).alias("hit"))


REFS = ["1.2.03", "01 . 2 . 4", "x", None, "1.2.3-5", "2.10"]


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {pick_sql(["1.2.3", "1.2.4", None, None, "1.2.3-5", "2.10"], 'l_orderkey')} AS s, {pick_sql(["1.2.3", "1.2.4", None, None, "1.2.3-5", "2.10"], 'l_suppkey')} AS o FROM lineitem)
SELECT coalesce(s, o, '') AS refs, count(*) AS n FROM x GROUP BY 1
""")
def effective_references(t):
    d = t.lineitem.select(pick(REFS, F.col("l_orderkey")).alias("s"), pick(REFS, F.col("l_suppkey")).alias("o"))
    few = d.groupBy("s", "o").agg(F.count("*").alias("n"))
    return few.withColumn("refs", F.array_join(references.effective_references(F.col("s"), F.col("o")), ",")).groupBy("refs").agg(F.sum("n").alias("n"))


PRICES = ["EP 12,50 GP 1.234,00", "je 100 Stk 3,20", "pro 10 pro 100", "per 7 Stk", "keine Angabe", "12 Stk Rohr", "3 m und 4 m", "1.5 kg Blech", "2,5 m Kabel"]
PRICE_SQL = {"basis": ["1", "100", "unreadable", "unreadable", "1", "1", "1", "1", "1"], "net": ["1234.0", "3.2", None, None, None, None, None, None, None], "quantity": [None, "100.0", None, "7.0", None, "12.0", None, "1.5", "2.5"], "unit": [None, "stk", None, "stk", None, "stk", None, "kg", "m"]}


@query(f"""
SELECT {pick_sql(PRICES, 'l_orderkey')} AS text, {pick_sql(PRICE_SQL['basis'], 'l_orderkey')} AS basis, {pick_sql(PRICE_SQL['net'], 'l_orderkey')}::DOUBLE AS net, {pick_sql(PRICE_SQL['quantity'], 'l_orderkey')}::DOUBLE AS quantity, {pick_sql(PRICE_SQL['unit'], 'l_orderkey')} AS unit, count(*) AS n FROM lineitem GROUP BY ALL
""")
def price_texts(t):
    few = t.lineitem.groupBy(pick(PRICES, F.col("l_orderkey")).alias("text")).agg(F.count("*").alias("n"))
    c = F.col("text")
    q = numbers.quantity_with_unit(c)
    return few.select("text", numbers.price_basis(c).alias("basis"), F.try_element_at(numbers.money_values(c), F.lit(-1)).alias("net"), q["quantity"].alias("quantity"), q["unit"].alias("unit"), "n")


NUMBERED = ["Angebotsnummer: 1234567, vom", "Angebot Nr. 7654321.", "ohne Nummer", "1111111 Angebot Nr."]


@query(f"""
SELECT {pick_sql(NUMBERED, 'o_orderkey')} AS text, {pick_sql(["1234567", "7654321", None, "1111111"], 'o_orderkey')} AS number, count(*) AS n FROM orders GROUP BY ALL
""")
def first_numbers(t):
    few = t.orders.groupBy(pick(NUMBERED, F.col("o_orderkey")).alias("text")).agg(F.count("*").alias("n"))
    patterns = [r"(?i)Angebotsnummer\s*[:#]?\s*(\d{6,})", r"(?i)\bAngebot\s+(?:Nr\.?\s*[:#]?\s*)?(\d{6,})", r"(?i)\b(\d{6,})\s+Angebot\s+Nr\.?"]
    return few.select("text", text.first_match(F.col("text"), patterns).alias("number"), "n")


AUDIT = [
    ("OPTIONS", "true"), ("PRICED", "total > 0"), ("WITH_SEVERAL_LINES", "n > 1"), ("QUANTITY_OVER_20", "q > 20"), ("RETURNED", "r > 0"), ("OPEN", "o > 0"), ("DISCOUNTED", "d > 0.05"), ("TAXED", "x > 0.05"),
]


@query(f"""
WITH g AS (SELECT l_partkey, l_suppkey, l_shipdate < TIMESTAMP '1999-01-01' AS early, count(*) AS n, sum(l_quantity) AS q, sum(l_extendedprice) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_linestatus = 'O') AS o, max(l_discount) AS d, max(l_tax) AS x FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT {', '.join(f"unnest(['{name}']) AS metric, count(*) FILTER (WHERE early AND {holds}) AS before, count(*) FILTER (WHERE NOT early AND {holds}) AS after FROM g UNION ALL SELECT" if k < len(AUDIT) - 1 else f"'{name}' AS metric, count(*) FILTER (WHERE early AND {holds}) AS before, count(*) FILTER (WHERE NOT early AND {holds}) AS after FROM g" for k, (name, holds) in enumerate(AUDIT)).replace("UNION ALL SELECT, ", "UNION ALL SELECT ")})
SELECT metric, before, after, after - before AS change FROM m
""")
def audit_metrics(t):
    """Conditional counts of the state before and after, one pass over the options."""
    g = t.lineitem.groupBy("l_partkey", "l_suppkey", (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")).alias("early")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.max("l_discount").alias("d"), F.max("l_tax").alias("x")
    )
    return rules.before_after(g, F.col("early"), [(name, F.expr(holds)) for name, holds in AUDIT])
