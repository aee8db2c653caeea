"""Queries on comparison views, run planning, diagnostics and text facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import geometry as g
from bidloom.functions import numbers, text
from bidloom.operators import evidence, keyed, matching, rules, sequences, views
from bidloom.plans.offers import OPTIONS, ROLES_SQL, options, role
from bidloom.plans.registry import query

STATUSES = ["MANUAL_DECISION_REQUIRED", "AUTO_SELECTED_LOWEST_PRICE", "DEFERRED", "MANUAL_DECIDED", "NO_COMPARABLE_OFFER", "PROCESSING_ERROR", "PROCESSING_PENDING"]
STATUS_SQL = f"{STATUSES!r}[p_partkey % 7 + 1]"


def reviewed_parts(t):
    """Parts as positions with a reference, a live status and a review queue."""
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("p_partkey") % 7).cast("int"))
    queue = F.when(F.col("p_size") % 2 == 0, "MANAGER_DECISION").otherwise("SYSTEM_REVIEW")
    return t.part.select("p_partkey", F.concat_ws(".", F.lit("1"), "p_size", "p_partkey").alias("reference"), status.alias("status"), queue.alias("queue"))


@query(f"""
WITH {OPTIONS}, r AS (SELECT position, lead(total) OVER w - total AS difference, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY position ORDER BY total, option))
SELECT position, row_number() OVER (ORDER BY difference DESC NULLS LAST, position) AS row_number FROM r WHERE rn = 1
""")
def comparison_by_difference(t):
    best = matching.cheapest(options(t), "position", "option", "total")
    order = views.sort_order("PRICE_DIFFERENCE", F.col("position").cast("string"), F.lit(None).cast("string"), F.col("next_total") - F.col("total"))
    return sequences.pages_of(best, order, 25).select("position", "row_number")


@query(f"""
SELECT p_partkey, row_number() OVER (ORDER BY {STATUS_SQL} NOT IN ('AUTO_SELECTED_LOWEST_PRICE', 'MANUAL_DECIDED') DESC, p_size, p_partkey) AS row_number FROM part
""")
def comparison_unresolved_first(t):
    order = views.sort_order("UNRESOLVED_FIRST", F.col("reference"), F.col("status"), F.lit(None))
    return sequences.pages_of(reviewed_parts(t), order, 25).select("p_partkey", "row_number")


@query(f"""
WITH p AS (SELECT {STATUS_SQL} AS status, CASE WHEN p_size % 2 = 0 THEN 'MANAGER_DECISION' ELSE 'SYSTEM_REVIEW' END AS queue FROM part)
SELECT 'ALL' AS bucket, count(*) AS n FROM p UNION ALL SELECT status, count(*) FROM p GROUP BY 1 UNION ALL SELECT queue, count(*) FROM p WHERE status = 'MANUAL_DECISION_REQUIRED' GROUP BY 1
""")
def filter_counts(t):
    return views.filter_counts(reviewed_parts(t), "status", "queue")


def _sum_of(condition):
    return f"CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE role = '{condition}') AS DOUBLE)"


@query(f"""
SELECT l_orderkey, {_sum_of('PRIMARY')} AS "primary", {_sum_of('MANDATORY_COMPONENT')} AS mandatory, {_sum_of('ALTERNATIVE')} AS optional FROM (SELECT *, {ROLES_SQL} AS role FROM lineitem) GROUP BY 1
""")
def price_breakdown(t):
    return views.price_breakdown(t.lineitem.withColumn("role", role()), ["l_orderkey"], "role", "l_extendedprice")


@query(f"""
WITH {OPTIONS}, p AS (SELECT position, count(*) AS n, count(*) FILTER (WHERE option % 3 = 0 AND n_lines = 1) AS s, count(*) FILTER (WHERE option % 2 = 0) AS x FROM o GROUP BY 1)
SELECT position, CASE WHEN position % 4 = 0 THEN CASE WHEN position % 8 = 0 THEN 'SELECTED_WITH_WARNING' ELSE 'SELECTED_VALID' END WHEN s > 0 THEN 'UNSELECTED' WHEN x = n THEN 'NO_OFFER' ELSE 'MATCH_REVIEW_REQUIRED' END AS state FROM p
""")
def selection_state(t):
    o = F.col("option")
    p = evidence.counted(options(t), ["position"], n=F.lit(True), s=(o % 3 == 0) & (F.col("n_lines") == 1), x=o % 2 == 0)
    return p.select("position", views.selection_state(F.col("position") % 4 == 0, F.col("position") % 8 == 0, F.col("s"), F.col("x"), F.col("n")).alias("state"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BEREIT' ELSE 'ENTWURF' END AS status, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer)
SELECT c_custkey, CASE WHEN status = 'BEREIT' AND n = 0 THEN CASE WHEN c_acctbal < 0 THEN 'FEHLER' ELSE 'PRÜFUNG_ERFORDERLICH' END ELSE status END AS status FROM c
""")
def project_status(t):
    basis = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    stored = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "BEREIT").otherwise("ENTWURF")
    return t.customer.join(basis, "c_custkey", "left").select("c_custkey", views.project_status(stored, F.col("n"), F.when(F.col("c_acctbal") < 0, "E1")).alias("status"))


@query("""
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS row_number FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')
""")
def project_list(t):
    found = t.customer.filter(text.search_contains(F.lit("Build"), F.col("c_name"), F.col("c_mktsegment")))
    return sequences.pages_of(found, [F.desc("c_acctbal"), F.col("c_custkey")], 20).select("c_custkey", "row_number")


@query("""
WITH d AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS done, o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS basis FROM orders),
k AS (SELECT o_custkey, bool_or(done) AND bool_or(NOT done) AND NOT bool_or(NOT done AND basis) AS incremental FROM d GROUP BY 1)
SELECT o_custkey, o_orderkey, incremental FROM d JOIN k USING (o_custkey) WHERE NOT done OR NOT incremental
""")
def documents_to_process(t):
    done = t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return views.documents_to_process(t.orders.withColumn("basis", F.col("o_orderpriority") == "1-URGENT"), done, "o_custkey", "o_orderkey", "basis")


@query("""
WITH l AS (SELECT p_partkey AS d, 'BASIS' AS side, CASE WHEN p_size > 10 THEN 'VERIFIED_NATIVE' ELSE 'MISSING' END AS status FROM part UNION ALL SELECT l_partkey, 'OFFER', CASE l_linestatus WHEN 'F' THEN 'VERIFIED_NATIVE' ELSE 'MISSING' END FROM lineitem)
SELECT side, status, d IN (SELECT s_suppkey FROM supplier) AS in_scope, count(*) AS n FROM l GROUP BY 1, 2, 3
""")
def quality_lines(t):
    none, seen = F.array().cast("array<string>"), F.array(F.lit("VERIFIED_NATIVE"), F.lit("MISSING"))
    basis = t.part.select(F.col("p_partkey").alias("line_id"), F.col("p_partkey").alias("document"), F.when(F.col("p_size") > 10, seen).otherwise(none).alias("evidence"))
    offers = t.lineitem.select(F.col("l_orderkey").alias("line_id"), F.col("l_partkey").alias("document"), F.when(F.col("l_linestatus") == "F", seen).otherwise(none).alias("evidence"))
    d = views.quality_lines(basis, offers, t.supplier.select(F.col("s_suppkey").alias("document")), "document")
    return d.groupBy("side", "status", "in_scope").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, count(*) AS n_positions, count(*) FILTER (WHERE l_linestatus = 'O' OR l_quantity <= 10) AS n_without_region, count(*) FILTER (WHERE l_linenumber = 7) AS n_multi_page FROM lineitem GROUP BY 1
""")
def document_diagnostics(t):
    box = F.when(F.col("l_linestatus") != "O", g.region(F.lit(0.1), F.lit(0.1), F.col("l_quantity") - 10, F.lit(0.1)))
    return views.document_diagnostics(t.lineitem, "l_orderkey", box, F.col("l_linenumber") == 7)


@query("""
SELECT conv_id, turn // 2 AS page, string_agg(turn, ',' ORDER BY turn) AS items, string_agg(role, ' ' ORDER BY turn) AS content FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1, 2
""")
def evidence_pages(t):
    items = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("item_id"), F.col("turn").alias("item_order"), F.col("role").alias("content"), g.region(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.1)).alias("box"))
    return evidence.per_page(items, "conv_id").select("conv_id", "page", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"), "content")


@query("""
WITH own AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS ids FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 UNION ALL SELECT o_orderkey, [o_custkey] FROM orders WHERE o_orderstatus = 'P')
SELECT own.k AS l_orderkey, coalesce(bool_or(list_has_all(own.ids, c.ids)), false) AS confirmed FROM own LEFT JOIN c USING (k) GROUP BY 1
""")
def confirmed_flags(t):
    own = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"))
    lines = t.lineitem.filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("theirs"))
    confirmed = lines.union(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", F.array("o_custkey")))
    return evidence.covered_flags(own, "l_orderkey", "ids", confirmed, "theirs").select("l_orderkey", "confirmed")


@query("""
SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate + to_days(floor(o_totalprice / 2000)::INTEGER) > TIMESTAMP '1998-06-01' AND o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 180 DAYS
""")
def live_sessions(t):
    days = F.make_dt_interval(F.floor(F.col("o_totalprice") / 2000).cast("int"))
    sessions = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + days).alias("expires_at"))
    return evidence.active_sessions(sessions, t.customer.select(F.col("c_custkey").alias("user_id"), "c_name"), F.expr("timestamp_ntz'1998-06-01 00:00:00'").cast(dict(sessions.dtypes)["created_at"])).select("o_orderkey", "c_name")


@query("""
SELECT doc_id FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)
""")
def source_isolation(t):
    ends = t.documents.agg(F.min("source").alias("a"), F.max("source").alias("b"))
    kind = F.when(F.col("source") == F.col("a"), "BASIS_LV").when(F.col("source") == F.col("b"), "SUPPLIER_OFFER").otherwise("OTHER")
    return t.documents.join(F.broadcast(ends), F.lit(True)).filter(rules.enters_matching(kind)).select("doc_id")  # one row


@query("""
SELECT p_partkey, p_size > 10 AND (p_brand IN ('Brand#1', 'Brand#2'))::INT + (p_type = 'SMALL')::INT + (contains(p_name, 'red'))::INT >= 2 AS plausible FROM part
""")
def basis_plausible(t):
    signals = F.array_compact(F.array(F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "A"), F.when(F.col("p_type") == "SMALL", "B"), F.when(F.contains("p_name", F.lit("red")), "C"), F.lit("OTHER")))
    return t.part.select("p_partkey", rules.plausible_basis(signals, ["A", "B", "C"], F.greatest(F.col("p_size") - 10, F.lit(0))).alias("plausible"))


@query("""
WITH l AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS a, list(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'F') AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(list_has_all(a, s), true) AND (o_orderstatus <> 'P') AS sound FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def selection_integrity(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("own"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("chosen"))
    chosen = F.when(F.col("o_orderstatus") == "P", F.array_append("chosen", F.lit(-1).cast("bigint"))).otherwise(F.col("chosen"))
    return t.orders.join(lines, "o_orderkey").select("o_orderkey", rules.within(chosen, F.col("own")).alias("sound"))


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F' AND l_linenumber < 5 AND l_returnflag <> 'R') AS n_owned FROM lineitem GROUP BY 1
""")
def evidence_ownership(t):
    ids = F.when(F.col("l_returnflag") == "R", F.array(F.lit("a"), F.lit("lost"))).otherwise(F.array(F.lit("a")))
    owned = rules.evidence_owned(F.col("l_linestatus"), F.least("l_linenumber", F.lit(4)), F.lit("F"), F.col("l_linenumber"), ids, F.array(F.lit("a"), F.lit("b")))
    return evidence.counted(t.lineitem, ["l_orderkey"], n_owned=owned)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND NOT o_orderstatus <> 'P'
""")
def immutable_append(t):
    incoming = t.orders.filter("o_totalprice > 200000").select("o_orderkey", "o_orderpriority")
    return keyed.append_immutable(t.orders.filter("o_orderstatus <> 'P'"), incoming, "o_orderkey", ["o_orderpriority"])


@query("""
WITH k AS (SELECT count(DISTINCT l_partkey) AS b, count(DISTINCT l_suppkey) AS o FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN b > 1 AND o > 1 THEN 'MANY_TO_MANY' WHEN b > 1 THEN 'MANY_TO_ONE' WHEN o > 1 THEN 'ONE_TO_MANY' ELSE 'ONE_TO_ONE' END AS kind, count(*) AS n FROM k GROUP BY 1
""")
def link_kinds(t):
    k = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("b"), F.countDistinct("l_suppkey").alias("o"))
    return keyed.histogram(k.select(matching.link_kind(F.col("b"), F.col("o")).alias("kind")), "kind")


@query("""
SELECT l_orderkey, sum(l_quantity::BIGINT)::DOUBLE AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, 2 * count(*) AS n_amounts, count(*) FILTER (WHERE l_linenumber <> 3 OR l_quantity = 9) AS n_quantities FROM lineitem GROUP BY 1
""")
def amounts_in_lines(t):
    unit = F.when(F.col("l_linenumber") == 3, F.lit("Stk, dann 9 Stk ")).otherwise(F.lit("Stk "))
    money = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    d = t.lineitem.select("l_orderkey", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit, F.lit("0,95 "), money).alias("line"), "l_quantity")
    amounts, pair = numbers.money_values(F.col("line")), numbers.quantity_with_unit(F.col("line"))
    d = d.select("l_orderkey", numbers.strict_number(F.col("l_quantity").cast("int").cast("string")).alias("q"), amounts.alias("a"), pair.alias("p"))
    return d.groupBy("l_orderkey").agg(F.sum("q").alias("quantity"), F.sum(F.element_at("a", -1).cast("decimal(18,2)")).cast("double").alias("total"), F.sum(F.size("a")).alias("n_amounts"), F.count(F.col("p.quantity")).alias("n_quantities"))


DIAMETERS = ["Ventil DN 20", 'Ventil 3/4"', "Ventil DN 25", "Ventil"]


@query("""
SELECT p_partkey, ['MATCH', 'MATCH', 'MISMATCH', 'UNRESOLVED'][p_partkey % 4 + 1] AS result FROM part
""")
def attribute_compare(t):
    offered = F.get(F.array(*map(F.lit, DIAMETERS)), (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", text.attribute_match(F.lit("DN 20"), offered).alias("result"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ' ' || p_size END AS type, CASE WHEN p_size % 3 = 0 THEN 'A-' || p_partkey || '-X' END AS article, upper(substring(p_name, 1, 1) || substring(string_split(p_name, ' ')[2], 1, 1)) AS initials FROM part
""")
def article_mentions(t):
    kind = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Typ: "), F.col("p_type"), F.lit(" "), F.col("p_size"), F.lit(" Komplett "))).otherwise(F.lit("Pumpe "))
    article = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Art.-Nr.: A-"), F.col("p_partkey"), F.lit("-X"))).otherwise(F.lit("ohne"))
    c = F.concat(kind, article)
    return t.part.select("p_partkey", text.type_identifier(c).alias("type"), text.article_number(c).alias("article"), text.initials(F.col("p_name")).alias("initials"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || CASE WHEN o_orderstatus = 'P' THEN ',24.12.24' ELSE '' END AS hints FROM orders
""")
def date_hints(t):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    later = F.when(F.col("o_orderstatus") == "P", " bis 24.12.24").otherwise("")
    century = F.regexp_replace(day, "\\.19", ".20")
    c = F.concat(F.lit("Angebot vom "), century, F.lit(" (wie am "), century, F.lit(")"), later, F.lit(", Nr. 45.13.2024"))
    return t.orders.select("o_orderkey", F.array_join(F.transform(text.date_hints(c), lambda d: F.when(d == century, day).otherwise(d)), ",").alias("hints"))


@query("""
SELECT c_custkey, regexp_replace(translate(format('{:,.2f}', c_acctbal), ',.', '.,'), ',00$', '') AS shown FROM customer WHERE NOT format('{:.2f}', c_acctbal) LIKE '%0' UNION ALL
SELECT c_custkey, regexp_replace(translate(format('{:,.2f}', c_acctbal), ',.', '.,'), '(,0)?0$', '') FROM customer WHERE format('{:.2f}', c_acctbal) LIKE '%0'
""")
def german_amounts(t):
    return t.customer.select("c_custkey", numbers.german_format(F.col("c_acctbal")).alias("shown"))


@query("""
WITH e AS (SELECT user_id AS c_custkey, sha256(string_agg(event_type || ':' || event_id, '|' ORDER BY ts, event_id)) AS token FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey, token IS NOT NULL AS requires_confirmation, coalesce(token, sha256('')) AS token FROM customer LEFT JOIN e USING (c_custkey)
""")
def processing_protection(t):
    log = t.events.filter("event_type = 'purchase'").withColumnRenamed("user_id", "c_custkey")
    return views.protection(t.customer, log, "c_custkey", ["ts", "event_id"], ["event_type", "event_id"])


@query("""
WITH n AS (SELECT s_nationkey AS k, string_agg(s_name, ' ' ORDER BY s_suppkey) AS notes FROM supplier GROUP BY 1) SELECT c_custkey, coalesce(notes, '') AS notes FROM customer LEFT JOIN n ON k = c_nationkey
""")
def inherited_notes(t):
    notes = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "s_name")
    return views.inherited_notes(t.customer, notes, "c_nationkey", "s_suppkey", "s_name").select("c_custkey", "notes")


@query("""
SELECT p_partkey, round(greatest(0, x - 0.01), 6) AS x, round(greatest(0, y - 0.01), 6) AS y FROM (SELECT p_partkey, least(1, p_size / 50.0)::DOUBLE AS x, greatest(0, (100 - p_size - 10) / 100.0)::DOUBLE AS y FROM part)
""")
def item_regions(t):
    m = F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.col("p_size").cast("double"), F.col("p_size").cast("double"))
    box = g.from_transform(m, F.lit(5.0), F.lit(50.0), F.lit(100.0))
    d = views.padded_items(t.part, box, 0.01)
    return d.select("p_partkey", F.round("region.x", 6).alias("x"), F.round("region.y", 6).alias("y"))


FILTERS = [("", None, "ALL"), ("RED", None, "ALL"), (" a-7 ", None, "UNSELECTED"), ("widget", 3, "SELECTED"), ("", 5, "WARNINGS"), ("1.1", 4, "ALL")]
_FILTER_SQL = {"ALL": "true", "SELECTED": "selected", "UNSELECTED": "NOT selected", "WARNINGS": "warned"}


@query(f"""
WITH l AS (SELECT l_partkey AS k, string_agg('art ' || l_suppkey || ' A-' || l_orderkey, ' ') AS texts, list(DISTINCT l_suppkey) AS suppliers, max(l_quantity) > 49 AS warned FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, lower('1.' || p_size || ' ' || p_name || ' ' || coalesce(texts, '')) AS searched, coalesce(suppliers, []) AS suppliers, coalesce(warned, false) AS warned, p_size % 3 = 0 AS selected FROM part LEFT JOIN l ON k = p_partkey)
{" UNION ALL ".join(f"SELECT {i} AS filter, p_partkey FROM p WHERE contains(searched, '{search.strip().lower()}') AND {_FILTER_SQL[shown]}" + (f" AND list_contains(suppliers, {supplier})" if supplier else "") for i, (search, supplier, shown) in enumerate(FILTERS))}
""")
def filtered_positions(t):
    """Searches with and without a supplier, and with each filter."""
    positions = t.part.select(F.col("p_partkey").alias("position_id"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("number"), F.col("p_name").alias("description"), (F.col("p_size") % 3 == 0).alias("selected"))
    lines = t.lineitem.select(F.col("l_partkey").alias("position_id"), F.col("l_suppkey").alias("supplier"), F.concat(F.lit("art "), F.col("l_suppkey").cast("string")).alias("description"), F.concat(F.lit("A-"), F.col("l_orderkey").cast("string")).alias("article"))
    warned = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("position_id"))
    found = [views.searched_positions(positions, lines, warned, *f).select(F.lit(i).alias("filter"), F.col("position_id").alias("p_partkey")) for i, f in enumerate(FILTERS)]
    return reduce(DataFrame.unionByName, found)


@query("""
WITH p AS (SELECT c_custkey, c_mktsegment || ' ' || c_custkey % 50 AS name, c_acctbal, c_custkey * 37 % 1000 AS touched FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'i'))
SELECT 'NAME' AS sort, c_custkey, row_number() OVER (ORDER BY name COLLATE de, c_custkey) AS row_number FROM p
UNION ALL SELECT 'CREATED', c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM p UNION ALL SELECT 'UPDATED', c_custkey, row_number() OVER (ORDER BY touched DESC, c_custkey) FROM p
""")
def project_lists(t):
    """The project list in its three orders."""
    found = t.customer.filter(text.search_contains(F.lit("I"), F.col("c_name"), F.col("c_mktsegment")))
    found = found.select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 50).alias("name"), "c_acctbal", (F.col("c_custkey") * 37 % 1000).alias("touched"))
    orders = {"NAME": text.german_order(F.col("name")), "CREATED": F.desc("c_acctbal"), "UPDATED": F.desc("touched")}
    lists = [sequences.pages_of(found, [order, F.col("c_custkey")], 20).select(F.lit(sort).alias("sort"), "c_custkey", "row_number") for sort, order in orders.items()]
    return reduce(DataFrame.unionByName, lists)
