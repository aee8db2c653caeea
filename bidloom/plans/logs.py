"""Queries on decision and event logs (events, orders, conversations): versions, replay, merge, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import references
from bidloom.operators import keyed, sequences
from bidloom.plans.registry import query


def by_time():
    return [F.col("ts"), F.col("event_id")]


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_decision(t):
    return keyed.last_wins(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2
""")
def dedupe_last_wins(t):
    return keyed.last_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "value", "event_id")


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(t):
    return keyed.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT k AS event_type, (SELECT count(*) FROM events WHERE event_type = k) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('deferred')) AS v(k)
""")
def zero_filled_histogram(t):
    spark = t.events.sparkSession
    members = spark.createDataFrame([(k,) for k in ("view", "click", "purchase", "signup", "error", "deferred")], "event_type string")
    return keyed.zero_filled_histogram(t.events, "event_type", members)


@query("""
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
SELECT event_type, count(*) AS n, floor(count(*) * 10000 / (SELECT count(*) FROM events) + 0.5) / 100 AS percent, string_agg(event_id, ',' ORDER BY event_id) FILTER (WHERE rn <= 8) AS examples FROM r GROUP BY 1
""")
def histogram_percent_examples(t):
    return keyed.share_with_examples(t.events, "event_type", "event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'EXCLUDED' WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state FROM orders
""")
def active_revision(t):
    return keyed.active_versions(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "state")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_backfill(t):
    return keyed.versions(t.events, "user_id", by_time()).select("event_id", "version")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events")
def supersede_chain(t):
    return keyed.superseded(t.events, ["user_id", "event_type"], by_time(), "event_id").select("event_id", "supersedes")


@query("""
SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations WHERE role <> 'assistant') WHERE turn + 1 <> expected
""")
def dense_revision_check(t):
    log = t.conversations.filter("role <> 'assistant'")
    return keyed.revision_gaps(log, "conv_id", [F.col("turn")], F.col("turn") + 1).select("conv_id", "turn", "expected")


@query("""
SELECT event_id, concat_ws('|', lag(event_type) OVER w, event_type, lead(event_type) OVER w) AS frame FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def context_frame(t):
    return sequences.context(t.events, ["user_id"], by_time(), F.col("event_type"), "frame").select("event_id", F.array_join("frame", "|").alias("frame"))


@query("""
SELECT user_id, block, count(*) AS n FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events) GROUP BY 1, 2
""")
def block_segments(t):
    return sequences.blocks(t.events, ["user_id"], by_time(), F.col("event_type") == "signup").groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events
""")
def forward_fill_state(t):
    return sequences.carry_forward(t.events, ["user_id"], by_time(), F.when(F.col("event_type") == "signup", F.col("value")), "state").select("event_id", "state")


@query("""
SELECT event_id, CASE WHEN event_type <> 'purchase' THEN 'NOTE' WHEN count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'PRIMARY' ELSE 'MANDATORY_COMPONENT' END AS role FROM events
""")
def first_in_group_role(t):
    return sequences.first_role(t.events, ["user_id"], by_time(), F.col("event_type") == "purchase").select("event_id", "role")


@query("""
SELECT event_id, heading FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM events) WHERE event_type = 'purchase'
""")
def heading_asof(t):
    return sequences.as_of(t.events, ["user_id"], by_time(), F.col("event_type") == "view", F.col("event_id"), "heading").filter("event_type = 'purchase'").select("event_id", "heading")


@query("""
SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'
""")
def next_page_continuation(t):
    following = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return t.conversations.filter("role = 'user'").select("conv_id", "turn").join(following, ["conv_id", "turn"], "left")


@query("""
SELECT a.o_orderkey, arg_max(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) AS predecessor FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderkey <> a.o_orderkey GROUP BY 1
""")
def predecessor_self_join(t):
    # The latest other order is the latest one, or for that one the second: no self join.
    w = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    ranked = keyed.versions(t.orders, ["o_custkey", "o_orderpriority"], w, "rn")
    top = ranked.filter("rn <= 2").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.when(F.col("rn") == 1, F.col("o_orderkey"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("o_orderkey"))).alias("second"))
    return t.orders.join(top, ["o_custkey", "o_orderpriority"]).select("o_orderkey", F.when(F.col("o_orderkey") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("predecessor"))


@query("""
WITH n AS (SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'P'),
i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderpriority END AS v FROM orders WHERE o_totalprice > 200000)
SELECT o_orderkey, CASE WHEN n.v IS NULL THEN 'INSERT' WHEN i.v IS NULL THEN 'UNCHANGED' WHEN n.v = i.v THEN 'DUPLICATE' ELSE 'CONFLICT' END AS state FROM n FULL JOIN i USING (o_orderkey)
""")
def merge_classify(t):
    existing = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    incoming = t.orders.filter("o_totalprice > 200000").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("v"))
    return keyed.merge_state(existing, incoming, "o_orderkey", ["v"])


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 6 = 0 THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') AS changed FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0
""")
def snapshot_diff(t):
    after = t.orders.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 4 == 0, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 6 == 0, None).otherwise(F.col("o_totalprice"))})
    return keyed.snapshot_changes(t.orders, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""
SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, upper(n_name) || '!', n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0
""")
def replace_affected(t):
    new = t.nation.filter("n_regionkey = 1 AND n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return keyed.replace_affected(t.nation, new, "n_regionkey").select("n_nationkey", "n_name", "n_regionkey")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0), r AS (
  SELECT src AS start, src AS node, 0 AS depth FROM e UNION ALL SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2
""")
def dependency_closure(t):
    edges = t.part.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return keyed.reachable(edges, edges.select(F.col("src").alias("node")), 64)


@query("""
SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props, count(*) AS changes FROM events GROUP BY 1, 2
""")
def replay_lww(t):
    return keyed.replay_fields(t.events, "user_id", "event_type", "props", ["ts", "event_id"])


LEGAL = [("signup", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view")]


@query(f"""
SELECT event_id, previous, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE previous IS NOT NULL AND (previous, event_type) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in LEGAL)})
""")
def transition_check(t):
    return keyed.illegal_transitions(t.events, "user_id", by_time(), "event_type", LEGAL).select("event_id", "previous", "event_type")


@query("""
SELECT o_custkey, min(o_orderkey) AS next_step, count(*) AS n_open FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') GROUP BY 1
""")
def resume_antijoin(t):
    done = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(done, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.min("o_orderkey").alias("next_step"), F.count("*").alias("n_open"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT user_id, sha256(string_agg(event_type || ':' || event_id, '|' ORDER BY ts, event_id)) AS fingerprint FROM events GROUP BY 1
""")
def revision_fingerprint(t):
    return keyed.fingerprint(t.events, "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@query("""
SELECT event_id, version - 1 AS actual FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) WHERE version - 1 <> event_id % 3
""")
def optimistic_conflicts(t):
    log = t.events.withColumn("expected", F.col("event_id") % 3)
    return keyed.optimistic_conflicts(log, "user_id", by_time(), "expected").select("event_id", "actual")


@query("""
WITH x AS (SELECT user_id, event_id, value, event_type FROM events), l AS (SELECT user_id, min(event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN event_id END, first_id) AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, event_id) AS place FROM x LEFT JOIN l USING (user_id)
""")
def review_queue(t):
    first = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    d = t.events.join(first, "user_id", "left").withColumn("line", F.coalesce(F.when(F.col("event_type") == "view", F.col("event_id")), F.col("first_id")))
    return keyed.versions(d, "user_id", [F.desc(F.col("event_type") == "error"), F.col("event_id")], "place").select("event_id", "line", "place")


@query("""
SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events) AND value > 10
""")
def decision_history_filter(t):
    day = t.events.agg(F.to_date(F.min("ts")).alias("d"))
    d = t.events.filter("event_type = 'purchase' AND value > 10").withColumn("d", F.to_date("ts"))
    return d.join(F.broadcast(day), "d", "left_semi").select("event_id", "user_id")  # one row


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'KEEP' WHEN max(o_orderkey % 3 <> 0) OVER (PARTITION BY o_custkey) THEN 'DELETE' ELSE 'MISSING' END AS repair FROM orders
""")
def orphan_repair(t):
    from pyspark.sql import Window as W

    has = F.col("o_orderkey") % 3 != 0
    return t.orders.select("o_orderkey", F.when(has, "KEEP").when(F.bool_or(has).over(W.partitionBy("o_custkey")), "DELETE").otherwise("MISSING").alias("repair"))


@query("""
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) >= 86400000000 THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM g GROUP BY 1, 2
""")
def gap_sessions(t):
    return sequences.gap_sessions(t.events, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type
""")
def adjacent_collapse(t):
    return sequences.collapse_adjacent(t.events, ["user_id"], by_time(), "event_type").select("event_id")


@query("""
SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 0.04 PRECEDING AND 0.04 FOLLOWING) AS n FROM events) WHERE n = 1
""")
def lone_markers(t):
    return sequences.lone_in_range(t.events, ["event_type"], "value", 0.04).filter("lone").select("event_id")


@query("""
WITH k AS (SELECT event_id, user_id, (event_id % 100 - 37 + 100) % 100 AS d FROM events WHERE event_type = 'error')
SELECT user_id, arg_min(event_id, (d, event_id)) AS next_open FROM k GROUP BY 1
""")
def circular_next(t):
    k = t.events.filter("event_type = 'error'").withColumn("d", F.pmod(F.col("event_id") % 100 - 37, F.lit(100)))
    return k.groupBy("user_id").agg(F.min_by("event_id", F.struct("d", "event_id")).alias("next_open"))


@query("""
WITH r AS (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY round(value) DESC) AS r FROM events)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_id) END AS best FROM r WHERE r = 1 GROUP BY 1
""")
def tied_best_is_null(t):
    from pyspark.sql import Window as W

    best = t.events.withColumn("r", F.rank().over(W.partitionBy("user_id").orderBy(F.desc(F.round("value"))))).filter("r = 1")
    return best.groupBy("user_id").agg(F.when(F.count("*") == 1, F.min("event_id")).alias("best"))


@query("""
WITH RECURSIVE b AS (SELECT o_custkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (
  SELECT o_custkey, i, (s <= 600000)::BIGINT AS files, CASE WHEN s <= 600000 THEN s ELSE 0 END AS total FROM b WHERE i = 1
  UNION ALL SELECT b.o_custkey, b.i, files + (files < 3 AND total + s <= 600000)::BIGINT, CASE WHEN files < 3 AND total + s <= 600000 THEN total + s ELSE total END FROM f JOIN b ON b.o_custkey = f.o_custkey AND b.i = f.i + 1)
SELECT o_custkey, arg_max(files, i) AS accepted, round(arg_max(total, i), 2) AS accepted_size FROM f GROUP BY 1
""")
def upload_limits(t):
    return keyed.accepted_uploads(t.orders, "o_custkey", ["o_orderkey"], "o_totalprice", 3, 600_000).withColumn("accepted_size", F.round("accepted_size", 2))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(1, least(5, p_size) + 1), [(p_size + 2) // 3, (2 * p_size + 2) // 3, p_size]))), ',') AS pages FROM part
""")
def sampled_pages(t):
    return t.part.select("p_partkey", F.array_join(sequences.sampled_pages(F.col("p_size")).cast("array<string>"), ",").alias("pages"))


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 10, p_partkey) AS place FROM part
""")
def natural_version_order(t):
    number = F.concat_ws(".", "p_size", F.col("p_partkey") % 10, "p_partkey")
    return keyed.versions(t.part, "p_brand", [references.version_key(number)], "place").select("p_partkey", "place")


_CHANGES_SQL = """
c AS (SELECT c_custkey AS k, c_custkey % 3 + 1 AS version, c_mktsegment AS v FROM customer WHERE c_custkey % 4 > 0),
h AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderkey % 4 AS expected, CASE WHEN o_orderkey % 4 = 0 THEN 'INSERT' WHEN o_orderkey % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS action, 'v' || o_orderkey % 7 AS v FROM orders),
j AS (SELECT h.*, c.k IS NOT NULL AS known, coalesce(version, 0) AS actual, CASE WHEN action = 'INSERT' THEN c.k IS NULL ELSE c.k IS NOT NULL AND expected = version END AS fits FROM h LEFT JOIN c USING (k)),
f AS (SELECT *, fits AND seq = min(seq) FILTER (WHERE fits) OVER (PARTITION BY k) AS holds FROM j)
"""


def _changed(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    rows = t.customer.filter(k % 4 > 0).select(k.alias("k"), (k % 3 + 1).alias("version"), F.col("c_mktsegment").alias("v"))
    action = F.when(o % 4 == 0, "INSERT").when(o % 5 == 0, "DELETE").otherwise("UPDATE")
    return keyed.versioned_changes(rows, t.orders.select(F.col("o_custkey").alias("k"), o.alias("seq"), (o % 4).alias("expected"), action.alias("action"), F.concat(F.lit("v"), (o % 7).cast("string")).alias("v")), "k", "v")


@query(f"""
WITH {_CHANGES_SQL}, d AS (SELECT k, action, v FROM f WHERE holds)
SELECT coalesce(c.k, d.k) AS k, coalesce(version, 0) + CASE WHEN action IS NULL THEN 0 ELSE 1 END AS version, CASE WHEN action IS NULL THEN c.v ELSE d.v END AS v FROM c FULL JOIN d ON c.k = d.k WHERE action IS DISTINCT FROM 'DELETE'
""")
def versioned_rows(t):
    """Rows after a batch of inserts, versioned updates and deletes."""
    return _changed(t)[0]


@query(f"""
WITH {_CHANGES_SQL} SELECT k, seq, action, CASE WHEN holds THEN 'DONE' WHEN NOT known AND action <> 'INSERT' THEN 'MISSING' ELSE 'CONFLICT' END AS outcome, CASE WHEN coalesce(holds, false) THEN NULL ELSE actual END AS actual FROM f
""")
def versioned_outcomes(t):
    """What became of each change, with the version that a refused one met."""
    return _changed(t)[1]
