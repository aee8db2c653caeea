"""Predicates, gates and rule engines: who enters, what is sound, which rules a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators.matching import NO_OFFER_ROLES

# Document types that enter matching, and disciplines that hold others.
SOURCE_TYPES = ["BASIS_LV", "SUPPLIER_OFFER"]
INCLUDES = {"SANITAER": ["INSTALLATIONSSYSTEME"]}
# Basis recommendation when no option is clear, by priority.
OPTION_PRIORITY = ["TECHNICAL_DEVIATION", "DIFFERENT_SCOPE_OF_SUPPLY", "DECISION_REQUIRED", "MATCHING_UNCLEAR", "PRICE_UNCLEAR", "NOT_COMPARABLE", "NO_OFFER"]


def enters_matching(document_type: Column) -> Column:
    return F.coalesce(document_type.isin(SOURCE_TYPES), F.lit(False))


def body_rows(df: DataFrame, y: str, footer: float, furniture: list[str], content: str) -> DataFrame:
    """Rows above the footer line whose text is no page furniture (patterns over the search-normalised text)."""
    pattern = "|".join(f"(?:{p})" for p in furniture)
    return df.filter((F.col(y) < footer) & ~text.search_normalize(F.col(content)).rlike(pattern))


def discipline_compatible(document: Column, project: Column) -> Column:
    """Equal, unknown on either side, or one that the project's discipline includes."""
    out = (document == project) | (document == "UNKNOWN") | (project == "UNKNOWN")
    for outer, inner in INCLUDES.items():
        out = out | ((project == outer) & document.isin(inner))
    return F.coalesce(out, F.lit(True))


def fully_read(documents: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Documents that finished and have no blocking issue."""
    return documents.filter("state = 'DONE'").join(issues.filter("severity = 'BLOCKING'"), key, "left_anti")


def confirmed_products(products: DataFrame, query: str, fields: list[str], **equal: str) -> DataFrame:
    chosen = products.filter("status = 'CONFIRMED'")
    for name, value in equal.items():
        chosen = chosen.filter(F.col(name) == value)
    return chosen.filter(text.search_contains(F.lit(query), *map(F.col, fields)))


def wildcard_equal(a: Column, b: Column) -> Column:
    """Equal, or null on either side."""
    return a.isNull() | b.isNull() | (a == b)


def map_within(part: Column, whole: Column) -> Column:
    """Every entry of one map stands in the other."""
    return F.forall(F.map_entries(part), lambda e: F.coalesce(F.try_element_at(whole, e["key"]) == e["value"], F.lit(False)))


def extraction_route(mode: Column, chars: Column, items: Column, geometry: Column) -> Column:
    """struct<primary, confidence>: the text layer where it is native, or hybrid and dense; else OCR."""
    dense = (mode == "HYBRID") & (chars >= 160) & (items >= 20) & (geometry >= 0.97)
    primary = F.when((mode == "DIGITAL") | dense, "DETERMINISTIC_TEXT_LAYER").otherwise("OCR_VISUAL")
    return F.struct(primary.alias("primary"), F.least(F.lit(1.0), chars / 800, items / 80, geometry).alias("confidence"))


def all_hold(*gates: Column) -> Column:
    out = F.lit(True)
    for gate in gates:
        out = out & F.coalesce(gate, F.lit(False))
    return out


def any_holds(*gates: Column) -> Column:
    out = F.lit(False)
    for gate in gates:
        out = out | F.coalesce(gate, F.lit(False))
    return out


def evidence_owned(document: Column, page: Column, own_document: Column, own_page: Column, ids: Column, valid: Column) -> Column:
    return (document == own_document) & (page == own_page) & (F.size(F.array_except(ids, valid)) == 0)


def plausible_basis(signals: Column, known: list[str], positions: Column, least: int = 2) -> Column:
    return (F.size(F.array_intersect(signals, F.array(*map(F.lit, known)))) >= least) & (positions > 0)


def machine_validatable(lines: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Lines with verified evidence and no blocking issue."""
    verified = F.exists("evidence_status", lambda s: s.startswith("VERIFIED"))
    return lines.filter(verified).join(issues.filter("severity = 'BLOCKING'"), key, "left_anti")


def preflight(df: DataFrame, blocking: list[tuple[str, Column]], warnings: list[tuple[str, Column]]) -> DataFrame:
    """blocking and warnings as arrays of the codes that hold, and ready."""
    codes = lambda rules: F.array_compact(F.array(*(F.when(holds, code) for code, holds in rules)))
    return df.withColumn("blocking", codes(blocking)).withColumn("warnings", codes(warnings)).withColumn("ready", F.size("blocking") == 0)


def reviewed(lines: DataFrame, actions: DataFrame, key: str, field: str, order: list[str] | None = None) -> DataFrame:
    """Lines after their actions on one field, in order: CLEAR empties, CONFIRM keeps, others set; the field is locked by the first.

    A locked field may only be confirmed; other actions on it give error LOCKED and
    change nothing.  ``actions`` is key, action, new_value and the order's columns
    (without an order, as before, one action a line).
    """
    log = F.array_sort(F.collect_list(F.struct(*(order or []), "action", "new_value")))
    d = lines.join(actions.groupBy(key).agg(log.alias("_log")), key, "left")
    start = F.struct(F.col(field).alias("value"), F.col("verification_status").alias("status"), F.array_contains("locked_fields", field).alias("locked"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, a: Column) -> Column:
        confirm = a["action"] == "CONFIRM"
        value = F.when(a["action"] == "CLEAR", F.lit(None)).when(confirm, s["value"]).otherwise(a["new_value"])
        acted = F.struct(value.alias("value"), F.when(confirm, "HUMAN_CONFIRMED").otherwise("HUMAN_CORRECTED").alias("status"), F.lit(True).alias("locked"), s["error"].alias("error"))
        return F.when(s["locked"] & ~confirm, F.struct(s["value"].alias("value"), s["status"].alias("status"), s["locked"].alias("locked"), F.lit("LOCKED").alias("error"))).otherwise(acted)

    d = d.withColumn("_s", F.when(F.col("_log").isNull(), start).otherwise(F.aggregate("_log", start, step)))
    locks = F.when(F.col("_s.locked"), F.array_union("locked_fields", F.array(F.lit(field)))).otherwise(F.col("locked_fields"))
    return d.withColumns({field: F.col("_s.value"), "verification_status": F.col("_s.status"), "locked_fields": locks, "error": F.col("_s.error")}).drop("_log", "_s")


def decision_comment_ok(outcome: Column, comment: Column, needing: list[str], chars: int = 40, words: int = 5) -> Column:
    """Outcomes that need a reason have a comment of so many characters and words."""
    c = F.trim(F.coalesce(comment, F.lit("")))
    return ~outcome.isin(needing) | ((F.length(c) >= chars) & (F.size(F.split(c, r"\s+")) >= words))


def within(selected: Column, allowed: Column) -> Column:
    return F.size(F.array_except(selected, allowed)) == 0


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """key, code, severity, field: one row for each rule (code, severity, field, broken) that a row breaks; one pass over the rows."""
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for c, s, f, broken in rules)))
    return df.select(key, F.explode(found).alias("_i")).select(key, "_i.*")


def line_rules(c=F.col) -> list[tuple[str, str, str, Column]]:
    """Rules of an offer line: role, quantity, unit_price, total_price, price_basis, group_id, continuation, n_evidence, completeness."""
    priced = c("unit_price").isNotNull() | c("total_price").isNotNull()
    both = c("unit_price").isNotNull() & c("total_price").isNotNull()
    close = F.abs(c("quantity") * c("unit_price") / F.when(c("price_basis") > 0, c("price_basis")) - c("total_price")) <= F.greatest(F.lit(0.02), F.abs(c("total_price")) * 0.02)
    return [
        ("PRICE_NOT_PRINTED", "BLOCKING", "completeness", (c("completeness") == "PRICED_OFFER") & ~priced),
        ("PRICE_DESPITE_STATUS", "WARNING", "completeness", c("completeness").isin("NOT_OFFERED", "PRICE_ON_REQUEST", "OFFER_WITHOUT_PRICE") & priced),
        ("BASIS_UNKNOWN", "BLOCKING", "price_basis", both & (c("quantity").isNull() | c("price_basis").isNull())),
        ("ARITHMETIC", "BLOCKING", "total_price", both & ~F.coalesce(close, F.lit(True))),
        ("OPTIONAL_WITHOUT_GROUP", "WARNING", "role", (c("role") == "OPTIONAL") & c("group_id").isNull()),
        ("ALTERNATIVE_WITHOUT_GROUP", "WARNING", "role", (c("role") == "ALTERNATIVE") & c("group_id").isNull()),
        ("NOT_OFFERED_WITH_PRICE", "BLOCKING", "role", (c("role") == "NOT_OFFERED") & priced),
        ("CONTINUATION", "WARNING", "continuation", c("continuation")),
        ("NO_EVIDENCE", "BLOCKING", "evidence", c("n_evidence") == 0),
    ]


def completeness(stated: Column, role: Column, priced: Column, description: Column) -> Column:
    return (
        F.when(stated.isNotNull(), stated)
        .when(role.isin(NO_OFFER_ROLES), "NOT_OFFERED")
        .when(role == "PRICE_ON_REQUEST", "PRICE_ON_REQUEST")
        .when(priced, "PRICED_OFFER")
        .when(F.trim(F.coalesce(description, F.lit(""))) != "", "OFFER_WITHOUT_PRICE")
        .otherwise("EMPTY_LINE")
    )


def basis_recommendations(options: DataFrame, position: str) -> DataFrame:
    """Per position CLEAR_RECOMMENDATION if an option is clear and priced, else the first status of the priority that occurs; and how many are clear."""
    clear = (F.col("status") == "CLEAR_RECOMMENDATION") & F.col("total").isNotNull()
    rank = F.array_position(F.array(*map(F.lit, OPTION_PRIORITY)), F.col("status"))
    d = options.groupBy(position).agg(F.count_if(clear).alias("n_clear"), F.min(F.when(rank > 0, rank)).alias("_r"))
    status = F.when(F.col("n_clear") > 0, "CLEAR_RECOMMENDATION").otherwise(F.coalesce(F.get(F.array(*map(F.lit, OPTION_PRIORITY)), F.col("_r").cast("int") - 1), F.lit("NO_OFFER")))
    return d.select(position, "n_clear", status.alias("status"), (status != "NO_OFFER").alias("needs_operator"))


def display_roles(lines: DataFrame, option: str, seq: str) -> DataFrame:
    """How a line shows within its option: a bundle of alternatives of one reference shows as primary and components."""
    from pyspark.sql import Window as W

    w = W.partitionBy(option)
    bundle = (F.count("*").over(w) > 1) & F.min(F.col("role") == "ALTERNATIVE").over(w) & ~F.max(F.coalesce(F.col("says_alternative"), F.lit(False))).over(w) & (F.size(F.collect_set(F.nullif(F.col("reference"), F.lit(""))).over(w)) == 1)
    first = F.col(seq) == F.min(seq).over(w)
    shown = (
        F.when(F.col("role") == "PRIMARY", "PRIMARY")
        .when(F.col("role") == "MANDATORY_COMPONENT", "REQUIRED_COMPONENT")
        .when(F.col("role").isin("OPTIONAL", "INCLUDED_ACCESSORY"), "OPTIONAL_COMPONENT")
        .when(F.col("role") != "ALTERNATIVE", "UNKNOWN")
        .when(~bundle, "ALTERNATIVE")
        .when(first, "PRIMARY")
        .otherwise("COMPONENT")
    )
    return lines.withColumn("display_role", shown)


def leaves(positions: DataFrame) -> DataFrame:
    """Positions that are no heading."""
    return positions.filter(~F.coalesce("heading", F.lit(False)))


def before_after(rows: DataFrame, before: Column, metrics: list[tuple[str, Column]]) -> DataFrame:
    """metric, before, after, change: how many rows of either state each condition holds for; one aggregation."""
    counts = [F.struct(F.lit(name).alias("metric"), F.count_if(before & holds).alias("before"), F.count_if(~before & holds).alias("after")) for name, holds in metrics]
    return rows.agg(F.array(*counts).alias("m")).select(F.inline("m")).withColumn("change", F.col("after") - F.col("before"))
