"""Decisions, memory, uploads, runs and pages: the rules around them as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.operators import keyed, rules, sequences
from bidloom.operators.documents import codes

# What a readable upload is and starts with, and the limits of a project.
PDF_TYPE, PDF_MAGIC = "application/pdf", "%PDF-"
MAX_FILES, MAX_FILE, MAX_TOTAL, MAX_PAGES = 30, 25_000_000, 60_000_000, 2_000
# From where on a page a position may go on overleaf, and where its footer may begin.
CONTINUES_FROM, FOOTER_FROM, FOOTER_GAP = 0.75, 0.9, 0.018


def relevant_memory(records: DataFrame, scopes: DataFrame, scalars: list[str]) -> DataFrame:
    """record, scope of the memory that applies to each request of its project.

    Scalars match where equal or null on either side, attributes where all of the
    record's are the request's, the context where it is empty or shares an item;
    rule candidates never apply.  Both sides: project, the scalars, attributes
    (map), context (array); records besides: record, layer, active.  Requests that
    ask the same are compared once, as arrays of scopes.
    """
    names = {c: f"_{c}" for c in [*scalars, "context"]}
    asked = scopes.withColumnsRenamed(names).withColumn("_attributes", F.array_sort(F.map_entries("attributes")))
    alike = keyed.chunks(asked, ["project", *names.values(), "_attributes"], "scope")
    d = keyed.dealt_join(records.filter("active AND layer <> 'RULE_CANDIDATE'"), alike, ["project"], "record")
    for c in scalars:
        d = d.filter(rules.wildcard_equal(F.col(c), F.col(names[c])))
    d = d.filter(rules.map_within(F.col("attributes"), F.map_from_entries("_attributes")))
    return d.filter((F.size("context") == 0) | F.arrays_overlap("context", "_context")).select("record", F.explode("scope").alias("scope"))


def reason_errors(decisions: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """key, errors of each decision (reasons array, comment) by the catalogue (code, active, allows_multiple, requires_comment)."""
    picked = decisions.select(key, F.explode(F.array_distinct("reasons")).alias("code")).join(catalog, "code", "left")
    told = picked.groupBy(key).agg(
        F.bool_or(F.col("active").isNull()).alias("unknown"), F.bool_or(~F.col("active")).alias("inactive"), F.bool_or(~F.col("allows_multiple")).alias("single"), F.bool_or(F.col("requires_comment")).alias("commented")
    )
    d = decisions.join(told, key, "left")
    holds = lambda c: F.coalesce(F.col(c), F.lit(False))
    distinct = F.size(F.array_distinct("reasons"))
    found = [
        ("DECISION_REASON_REQUIRED", F.size("reasons") == 0),
        ("DUPLICATE_DECISION_REASON", distinct < F.size("reasons")),
        ("DECISION_REASON_UNKNOWN", holds("unknown")),
        ("DECISION_REASON_INACTIVE", holds("inactive")),
        ("DECISION_REASON_MULTIPLE_NOT_ALLOWED", (distinct > 1) & holds("single")),
        ("DECISION_COMMENT_REQUIRED", holds("commented") & (F.trim(F.coalesce("comment", F.lit(""))) == "")),
    ]
    return d.select(key, codes(found).alias("errors"))


def selection_error(outcome: Column, selected: Column, known: Column, lines: Column, option_lines: Column, rejected: Column, option_ids: Column) -> Column:
    """The first error of a selection; null if it is sound."""
    return (
        F.when(selected.isNotNull() & ~known, "SUPPLIER_OPTION_NOT_FOUND")
        .when((outcome == "SELECTED") & selected.isNull(), "SELECTED_OPTION_REQUIRED")
        .when(selected.isNotNull() & ((F.size(lines) == 0) | (F.size(F.array_except(lines, option_lines)) > 0)), "SELECTED_BUNDLE_LINES_INVALID")
        .when(F.size(F.array_except(rejected, option_ids)) > 0, "REJECTED_OPTION_INVALID")
    )


def upload_outcomes(files: DataFrame, project: str, order: list[str]) -> DataFrame:
    """Each uploaded file's outcome: ACCEPTED, or why not.

    ``files``: name, mime, head (first signs), sha256, size, pages.  A file that is
    no PDF by name, type or content is refused by itself, and so is one of a digest
    that came before; limits count accepted files only, so the rest is a fold over a
    project's files in order.
    """
    c = F.col
    own = F.when(~F.lower("name").endswith(".pdf"), "NAME_INVALID").when(F.coalesce("mime", F.lit("")) != PDF_TYPE, "TYPE_INVALID").when(~F.coalesce("head", F.lit("")).startswith(PDF_MAGIC), "CONTENT_INVALID").when(c("size") > MAX_FILE, "FILE_TOO_LARGE")
    d = files.withColumn("_own", own)
    again = F.row_number().over(W.partitionBy(project, "sha256", F.isnull("_own")).orderBy(*order)) > 1
    d = d.withColumn("_own", F.when(F.isnull("_own") & again, "DUPLICATE").otherwise(F.col("_own")))
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col("size").cast("long").alias("_s"), F.col("pages").cast("long").alias("_p"), "_own")))  # the files of one project
    state = "struct<n:bigint,s:bigint,p:bigint,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        why = F.when(x["_own"].isNotNull(), x["_own"]).when(a["n"] + 1 > MAX_FILES, "TOO_MANY_FILES").when(a["s"] + x["_s"] > MAX_TOTAL, "PROJECT_TOO_LARGE").when(a["p"] + x["_p"] > MAX_PAGES, "TOO_MANY_PAGES").otherwise("ACCEPTED")
        ok = (why == "ACCEPTED").cast("bigint")
        return F.struct((a["n"] + ok).alias("n"), (a["s"] + ok * x["_s"]).alias("s"), (a["p"] + ok * x["_p"]).alias("p"), F.array_append(a["out"], why).alias("out")).cast(state)

    zero = F.expr(f"cast(named_struct('n', 0, 's', 0, 'p', 0, 'out', array()) as {state})")
    g = d.groupBy(project).agg(entries.alias("_e")).withColumn("_o", F.aggregate("_e", zero, step)["out"])
    return g.select(project, F.explode(F.arrays_zip("_e", "_o")).alias("_z")).select(project, *(F.col(f"_z._e.{x}").alias(x) for x in order), F.col("_z._o").alias("outcome"))


def continuations(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """position, quantity, from_seq: for an incomplete position that ends low on its page, the first line with a quantity overleaf, before the next position starts.

    ``positions``: document, page, position, incomplete, bottom; ``lines``: document, page, seq, is_anchor, quantity.
    """
    first = lines.groupBy("document", "page").agg(F.min(F.when(F.col("is_anchor"), F.col("seq"))).alias("_anchor"), F.min(F.when(F.col("quantity").isNotNull(), F.struct("seq", "quantity"))).alias("_q"))
    overleaf = first.select("document", (F.col("page") - 1).alias("page"), "_anchor", "_q")
    wanted = positions.filter(F.col("incomplete") & (F.col("bottom") >= CONTINUES_FROM))
    found = wanted.join(overleaf, ["document", "page"]).filter(F.col("_q").isNotNull() & (F.col("_anchor").isNull() | (F.col("_q.seq") < F.col("_anchor"))))
    return found.select("position", F.col("_q.quantity").alias("quantity"), F.col("_q.seq").alias("from_seq"))


def footer_tops(rows: DataFrame, keys: list[str], y: str) -> DataFrame:
    """keys, footer_top: the top of a page's last cluster of rows, if it starts in the footer and has two rows or more."""
    d = sequences.gap_sessions(rows, keys, F.col(y), FOOTER_GAP)
    clusters = d.groupBy(*keys, "session").agg(F.min(y).alias("top"), F.count("*").alias("n"))
    last = clusters.groupBy(*keys).agg(F.max_by(F.struct("top", "n"), "session").alias("c"))
    return last.filter((F.col("c.top") >= FOOTER_FROM) & (F.col("c.n") >= 2)).select(*keys, F.col("c.top").alias("footer_top"))


def history_filter(decisions: DataFrame, options: DataFrame, **wanted: object) -> DataFrame:
    """Decisions with their option's supplier, by actor, supplier, outcome, kind and day; what is not asked for is not filtered."""
    d = decisions.join(options.select("option", "supplier"), "option", "left")
    for name, value in wanted.items():
        if value is not None:
            d = d.filter((F.to_date("decided_at") if name == "day" else F.col(name)) == F.lit(value))
    return d


def audit(before: DataFrame, after: DataFrame, key: str, status: str, clear: list[str]) -> DataFrame:
    """key, previous, corrected, outcome_changed, and verdict: SAFE unless a row that was open became clear without being looked at."""
    d = before.select(key, F.col(status).alias("previous")).join(after.select(key, F.col(status).alias("corrected"), "reviewed"), key)
    changed = ~F.col("previous").eqNullSafe(F.col("corrected"))
    unsafe = changed & F.col("corrected").isin(clear) & ~F.coalesce("reviewed", F.lit(False))
    return d.select(key, "previous", "corrected", changed.alias("outcome_changed"), F.when(unsafe, "UNSAFE").when(changed, "CHANGED").otherwise("SAFE").alias("verdict"))


def next_steps(steps: DataFrame, done: DataFrame, cached: DataFrame) -> DataFrame:
    """run, seq, step, action of each step of a run: DONE, CACHED, RUN, or STOPPED from the first open step that may not go on.

    A step stops a run where it has a blocking issue, exceeds the cost limit with those that run before it, or failed its self-check.
    """
    d = steps.join(done.select("run", "step", F.lit(True).alias("_d")), ["run", "step"], "left").join(cached.select("cache_key", F.lit(True).alias("_c")), "cache_key", "left")
    open_ = F.col("_d").isNull() & F.col("_c").isNull()
    w = W.partitionBy("run").orderBy("seq")
    spent = F.sum(F.when(open_, F.col("cost")).otherwise(0.0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_stop", open_ & (F.col("blocked") | ~F.col("check_ok") | (spent > F.col("cost_limit"))))
    stopped = F.max(F.col("_stop").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    return d.select("run", "seq", "step", F.when(F.col("_d"), "DONE").when(F.col("_c"), "CACHED").when(stopped, "STOPPED").otherwise("RUN").alias("action"))


def export_lines(positions: DataFrame, options: DataFrame, selections: DataFrame) -> DataFrame:
    """A row of each position, with its selected option's supplier and total where one is selected and known, and its state."""
    chosen = selections.join(options, ["position", "option"], "left").select("position", "option", "supplier", "total")
    d = positions.join(chosen, "position", "left")
    state = F.when(F.col("option").isNull(), "UNSELECTED").when(F.col("supplier").isNull(), "OPTION_LOST").otherwise("SELECTED")
    return d.select("position", "supplier", "total", state.alias("state"))
