"""Operators that join rows with their evidence, links, labels and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import geometry
from bidloom.operators import sequences


def ordered_lookup(owners: DataFrame, owner: str, ids: str, rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each owner's rows in the order of its id array; unknown ids drop, repeated ones stay."""
    exploded = owners.select(owner, F.posexplode(ids).alias("_pos", key))
    joined = exploded.join(rows.select(key, *values), key)
    return joined.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("_pos", key, *values))).alias("rows"))


def linked_lines(links: DataFrame, lines: DataFrame) -> DataFrame:
    """basis_id, line_id, link_id of links (link_id, basis_ids, line_ids, status); a basis with any other link drops its UNMATCHED ones."""
    edges = links.select("link_id", "status", F.explode("basis_ids").alias("basis_id"), "line_ids").select("link_id", "status", "basis_id", F.explode("line_ids").alias("line_id"))
    known = edges.join(lines.select("line_id"), "line_id", "left_semi")
    active = F.max(F.col("status") != "UNMATCHED").over(W.partitionBy("basis_id"))
    return known.withColumn("_a", active).filter((F.col("status") != "UNMATCHED") | ~F.col("_a")).select("basis_id", "line_id", "link_id")


def with_label(df: DataFrame, key: str, labels: DataFrame, label: str, default: str) -> DataFrame:
    found = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    return df.join(found, F.col(key) == F.col("_k"), "left").withColumn(label, F.coalesce("_l", F.lit(default))).drop("_k", "_l")


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired, with their user; 180 days at most."""
    return sessions.filter((F.col("expires_at") > now) & (F.col("created_at") > now - F.expr("INTERVAL 180 DAYS"))).join(users, "user_id")


def covered_flags(items: DataFrame, key: str, own: str, confirmed: DataFrame, theirs: str) -> DataFrame:
    """Whether some confirmation of the key has all its ids within the item's."""
    ok = F.size(F.array_except(F.col("_theirs"), F.col(own))) == 0
    c = confirmed.select(F.col(key).alias("_k"), F.col(theirs).alias("_theirs"))
    d = items.join(c, F.col(key) == F.col("_k"), "left").groupBy(*items.columns).agg(F.max(F.coalesce(ok, F.lit(False))).alias("confirmed"))
    return d


def canonical_evidence(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """Status, text and box of evidence (id, mode, item_ids) from its text items (item_id, item_order, content, box).

    An unknown item makes it CONFLICTING; no items are MISSING on a digital page
    and VISUAL_ONLY_UNCONFIRMED on others; else VERIFIED_NATIVE with the items'
    text in order and their union box.
    """
    wanted = evidence.select("id", "mode", F.size("item_ids").alias("n"), F.explode_outer("item_ids").alias("item_id"))
    d = wanted.join(items, "item_id", "left").groupBy("id", "mode", "n").agg(F.count("content").alias("found"), F.array_sort(F.collect_list(F.struct("item_order", "content"))).alias("_t"), geometry.union_box(F.col("box")).alias("box"))
    status = F.when((F.col("n") > 0) & (F.col("found") < F.col("n")), "CONFLICTING").when(F.col("found") > 0, "VERIFIED_NATIVE").when(F.col("mode") == "DIGITAL", "MISSING").otherwise("VISUAL_ONLY_UNCONFIRMED")
    words = F.array_join(F.transform(F.filter("_t", lambda t: t["content"].isNotNull()), lambda t: t["content"]), " ")
    return d.select("id", status.alias("status"), words.alias("content"), "box")


def per_page(items: DataFrame, owner: str) -> DataFrame:
    """An owner's items by page: distinct ids in order, text and union box."""
    distinct = items.groupBy(owner, "page", "item_id").agg(F.min_by(F.struct("content", "box"), "item_order").alias("_i"), F.min("item_order").alias("item_order"))
    rows = F.array_sort(F.collect_list(F.struct("item_order", "item_id", F.col("_i.content").alias("content"))))
    return distinct.groupBy(owner, "page").agg(rows.alias("_r"), geometry.union_box(F.col("_i.box")).alias("box")).select(owner, "page", F.transform("_r", lambda r: r["item_id"]).alias("item_ids"), F.array_join(F.transform("_r", lambda r: r["content"]), " ").alias("content"), "box")


def best_versions(rows: DataFrame, key: str, evidence: str, seq: str, keep: list[str] | None = None) -> DataFrame:
    """Per key the row with most evidence, the first of equals, and how often the key occurs.  Of the row all columns are carried, or those to ``keep``."""
    rest = keep or [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.size(evidence), -F.col(seq))).alias("_r"), F.count("*").alias("occurrences")).select(key, "_r.*", "occurrences")


def with_blocking_issues(lines: DataFrame, issues: DataFrame, key: str, exempt: list[str]) -> DataFrame:
    """Lines with the codes of their blocking issues; none for exempt roles."""
    codes = issues.filter("severity = 'BLOCKING'").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("blocking"))
    empty = F.array().cast("array<string>")
    return lines.join(codes, key, "left").withColumn("blocking", F.when(F.col("role").isin(exempt), empty).otherwise(F.coalesce("blocking", empty)))


def buckets(df: DataFrame, key: str, kind: str, member: str, names: list[str]) -> DataFrame:
    """One array of members for each kind."""
    return df.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col(kind) == n, F.col(member)))).alias(n) for n in names))


def overlay_latest(rows: DataFrame, log: DataFrame, key: str, order: list[str], status: str, kept: str) -> DataFrame:
    """Rows whose status becomes that of the key's latest log entry, if it has one."""
    last = log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("_s"))
    return rows.join(last, key, "left").withColumn(kept, F.coalesce("_s", kept)).drop("_s")


def counted(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """One count per condition: the metrics of a report in a single pass."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def plan_steps(steps: DataFrame, run: str, seq: str, name: str) -> DataFrame:
    """Steps with an idempotency key and the step they wait for."""
    w = W.partitionBy(run).orderBy(seq)
    key = F.substring(F.sha2(F.concat_ws("|", run, name, seq), 256), 1, 18)
    return steps.withColumn("idempotency_key", key).withColumn("depends_on", F.lag(key).over(w))


def verified_restore(files: DataFrame, checksums: DataFrame, key: str) -> DataFrame:
    """state OK, CORRUPT, MISSING or UNEXPECTED of a backup's files (key, content) against its checksums (key, sha256)."""
    have = files.select(F.col(key).alias("_k"), F.sha2("content", 256).alias("_have"))
    d = have.join(checksums, F.col("_k") == F.col(key), "full_outer")
    state = F.when(F.col("_k").isNull(), "MISSING").when(F.col(key).isNull(), "UNEXPECTED").when(F.col("_have") == F.col("sha256"), "OK").otherwise("CORRUPT")
    return d.select(F.coalesce(F.col(key), F.col("_k")).alias(key), state.alias("state"))


def collapsed_pages(df: DataFrame, group: str, seq: str, collapsed: Column, size: int) -> DataFrame:
    """Groups in order of their first row with their pages: an open group's first and last page, a collapsed one's header page.

    Rows of collapsed groups take no place.  Works on group totals, so only one
    row a group is put in a global order.
    """
    totals = df.groupBy(group).agg(F.min(seq).alias("_first"), F.count("*").alias("n"), F.bool_or(collapsed).alias("is_collapsed"))
    shown = totals.withColumn("_v", F.when(F.col("is_collapsed"), F.lit(0)).otherwise(F.col("n")))
    total = shown.agg(F.coalesce(F.sum("_v"), F.lit(0))).first()[0]
    d = sequences.running_before(shown, [F.col("_first")], "_v", "_o").withColumn("_t", F.lit(total))
    last = F.greatest(F.lit(1), F.ceil(F.col("_t") / size))
    page = F.floor(F.col("_o") / size) + 1
    return d.select(group, "n", "is_collapsed", F.least(page, last).cast("bigint").alias("first_page"), F.when(F.col("is_collapsed"), F.least(page, last)).otherwise(F.floor((F.col("_o") + F.col("n") - 1) / size) + 1).cast("bigint").alias("last_page"))
