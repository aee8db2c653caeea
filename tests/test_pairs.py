"""Operators on pairs of two large tables against loops over small ones."""

from bidloom.functions import quantities, text
from bidloom.operators import decisions, documents, history, matching
from bidloom.plans import audits, registry  # noqa: F401

SCOPES = ["ALL", "LISTED", "UNKNOWN"]


def test_coverage_adds_documents_up_once_a_set_of_listings(spark):
    positions = [(p % 2, p) for p in range(12)] + [(7, 99)]
    listed = [(p % 2, r, p) for p in range(12) for r in (2, 3, 5) if p % r == 0]
    documents = [(d % 2, d, SCOPES[d % 3], (2, 3, 5, None)[d % 4], (True, True, None, False, True)[d % 5]) for d in range(40)]
    want = {}
    for project, p in positions:
        hits = [d for d in documents if d[0] == project and (d[2] == "ALL" or d[2] == "LISTED" and (project, d[3], p) in listed)]
        read, unread, possible = sorted(d[1] for d in hits if d[4]), sum(d[4] is False for d in hits), sum(d[0] == project and d[2] == "UNKNOWN" for d in documents)
        want[p] = (",".join(map(str, read)), unread, possible, "INCOMPLETE" if unread or not read else "UNKNOWN" if possible else "COMPLETE")
    tables = spark.createDataFrame(positions, "project int, position int"), spark.createDataFrame(listed, "project int, listing int, position int"), spark.createDataFrame(documents, "project int, document int, scope string, listing int, read boolean")
    assert {r.position: tuple(r)[2:] for r in history.coverage(*tables).collect()} == want


def test_mentions_of_groups_equal_those_of_pairs(spark):
    missing = [(p, f"0{1 + p % 2}.{p % 5}", p % 3) for p in range(3000)]
    asked = [(d, d % 3) for d in range(7)]
    pages = spark.createDataFrame([(d, g, f"Pos 1.{g}, 2. {(d + g) % 5} und 1.{g}") for d in range(7) for g in range(4)], "document int, page int, content string")
    index = documents.postings(pages, r"[0-9]+(?:\.\s?[0-9]+)+")
    groups = spark.createDataFrame(missing, "position int, reference string, rest int")
    pairs = groups.join(spark.createDataFrame(asked, "document int, rest int"), "rest").drop("rest")
    want = {tuple(map(str, r)) for r in documents.missing_but_mentioned(pairs, index).collect()}
    got = documents.missing_but_mentioned(groups, index.join(spark.createDataFrame(asked, "document int, rest int"), "document"), "rest")
    rows = [tuple(map(str, r)) for r in got.select("position", "document", "pages").collect()]
    assert want == set(rows) and len(want) == len(rows) > 3000


def test_candidates_are_made_once_each(spark):
    words = [["a", "b"], ["b", "c"], ["c"], ["d", "e"], [], None]
    basis = [(p, words[p % 6], (None, "x", "y")[p % 3], str(p % 2), p) for p in range(60)]
    offers = [(o, words[o % 5], (None, "x", "z")[o % 3], str(o % 2), o, o + 5) for o in range(40)]
    hit = lambda b, o: bool(set(b[1] or []) & set(o[1] or [])) or b[2] is not None and b[2] == o[2] or b[3] == o[3] and o[4] <= b[4] <= o[5]
    got = matching.candidate_pairs(spark.createDataFrame(basis, "basis_id int, tokens array<string>, article string, prefix string, first long"), spark.createDataFrame(offers, "offer_id int, tokens array<string>, article string, prefix string, first long, last long"))
    assert sorted(map(tuple, got.collect())) == sorted((b[0], o[0]) for b in basis for o in offers if hit(b, o))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [basis_id" not in plan  # no pair is shuffled to be told apart


def test_memory_compares_requests_that_ask_the_same_once(spark):
    records = [(r, r % 2, "PROJECT", r % 7 > 0, (None, "p", "q")[r % 3], {"s": str(r % 2)} if r % 5 else {}, [str(r % 4)] if r % 3 else []) for r in range(60)]
    scopes = [(s, s % 2, ("p", None, "q")[s % 3], {"s": str(s % 2), "t": "u"}, [str(s % 4), "9"]) for s in range(40)]
    fits = lambda r, s: r[3] and r[1] == s[1] and (r[4] is None or s[2] is None or r[4] == s[2]) and r[5].items() <= s[3].items() and (not r[6] or set(r[6]) & set(s[4]))
    kinds = "brand string, attributes map<string,string>, context array<string>"
    got = decisions.relevant_memory(spark.createDataFrame(records, f"record int, project int, layer string, active boolean, {kinds}"), spark.createDataFrame(scopes, f"scope int, project int, {kinds}"), ["brand"])
    assert sorted(map(tuple, got.collect())) == sorted((r[0], s[0]) for r in records for s in scopes if fits(r, s))
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()


def test_audit_joins_lines_once_for_options_and_links(spark):
    plan = registry.QUERIES["corpus_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan.split("posexplode")[0] and plan.count("max_by") == 1


def test_texts_are_worked_out_once(spark):
    d = spark.createDataFrame([("DN 20 1/2 zoll", "3 Stk 12,50")], "a string, b string")
    plan = lambda c: d.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.attribute_match(d.a, d.a)).count("a#") < 30
    assert plan(quantities.quantity(d.b)).count("b#") < 10
    assert d.select(text.attribute_match(d.a, d.a)).first()[0] == "MATCH" and d.select(quantities.quantity(d.b)).first()[0].quantity == 3


def test_shown_prices_carry_no_evidence(spark):
    plan = registry.QUERIES["price_display"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    best = plan[plan.index("max_by") :]
    assert "says_alternative" not in best[: best.index("\n")]
