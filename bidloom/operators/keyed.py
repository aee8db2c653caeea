"""Operators over rows with keys and an explicit order: dedupe, versions, diffs, merges, closures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.sources.lineage import cut


def _names(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def last_wins(df: DataFrame, keys, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``.  A grouped max_by, so it combines before the shuffle."""
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_k(df: DataFrame, keys, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key by ``order``; Spark drops the rest before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*_names(keys)).orderBy(*order))).filter(F.col(rank) <= k)


def chunks(df: DataFrame, keys, value: str, size: int = 1024) -> DataFrame:
    """keys, value: the values of each key in arrays of ``size`` at most, so that no key is one row."""
    keys = _names(keys)
    at = F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1) / size)
    return df.select(*keys, value, at.alias("_chunk")).groupBy(*keys, "_chunk").agg(F.collect_list(value).alias(value)).drop("_chunk")


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: str, ways: int = 16) -> DataFrame:
    """An inner join on keys of few values: a key's left rows are dealt out by ``by``, its fewer right rows go to each share.

    The number of partitions is the session's, as what is joined is small beside the rows that come of it.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).repartition(partitions, *on, "_way")
    each = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(each.hint("merge"), [*on, "_way"]).drop("_way")


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*_names(keys)).agg(F.count("*").alias("n")).filter("n > 1")


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def zero_filled_histogram(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Counts over all of an enumeration's members (one column, named as the key), 0 where none occurs."""
    return members.join(histogram(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def share_with_examples(df: DataFrame, key: str, example: str, examples: int = 8) -> DataFrame:
    """Counts, percent of all rows to two places, and the smallest examples of each key."""
    few = top_k(df.select(key, example), key, [F.col(example)], examples).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(example)), ",").alias("examples"))
    counted = histogram(df, key).join(few, key)
    total = df.agg(F.count("*").alias("_n"))
    return counted.join(F.broadcast(total)).select(key, "n", (F.floor(F.col("n") * 10000 / F.col("_n") + 0.5) / 100).alias("percent"), "examples")  # total is one row


def versions(df: DataFrame, keys, order: list[Column], name: str = "version") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*_names(keys)).orderBy(*order)).cast("bigint"))


def active_versions(df: DataFrame, family: list[str], order: list[Column], eligible: Column) -> DataFrame:
    """state ACTIVE, SUPERSEDED or EXCLUDED in one pass: the first eligible row by ``order`` of each family is active."""
    ok = F.coalesce(eligible, F.lit(False))
    w = W.partitionBy(*family, ok).orderBy(*order)
    return df.withColumn("state", F.when(~ok, "EXCLUDED").when(F.row_number().over(w) == 1, "ACTIVE").otherwise("SUPERSEDED"))


def superseded(df: DataFrame, keys, order: list[Column], record: str) -> DataFrame:
    """Each record with the one before it on the same keys."""
    return df.withColumn("supersedes", F.lag(record).over(W.partitionBy(*_names(keys)).orderBy(*order)))


def revision_gaps(df: DataFrame, keys, order: list[Column], revision: Column) -> DataFrame:
    """Rows whose revision is not their place in the log."""
    return df.withColumn("expected", F.row_number().over(W.partitionBy(*_names(keys)).orderBy(*order)).cast("bigint")).withColumn("found", revision.cast("bigint")).filter(~F.col("expected").eqNullSafe(F.col("found")))


def illegal_transitions(df: DataFrame, keys, order: list[Column], status: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Rows whose status may not follow the one before; a log's first row always may."""
    previous = F.lag(status).over(W.partitionBy(*_names(keys)).orderBy(*order))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, b in legal))
    return df.withColumn("previous", previous).filter(F.col("previous").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "previous", status)))


def replay_fields(log: DataFrame, entity: str, field: str, value: str, order: list[str]) -> DataFrame:
    """State after a log of field changes: the last value of each field; a null value clears it."""
    return log.groupBy(entity, field).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("changes"))


def replace_affected(current: DataFrame, replacement: DataFrame, keys) -> DataFrame:
    """The relation without the replaced keys' rows, and the replacement."""
    keys = _names(keys)
    return current.join(replacement.select(*keys).distinct(), keys, "left_anti").unionByName(replacement)


def merge_state(existing: DataFrame, incoming: DataFrame, keys, values: list[str]) -> DataFrame:
    """Every key as INSERT, DUPLICATE, CONFLICT or UNCHANGED, by null-safe comparison of the values."""
    keys = _names(keys)
    a = existing.select(*keys, F.struct(*values).alias("_old"))
    b = incoming.select(*keys, F.struct(*values).alias("_new"))
    state = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "UNCHANGED").when(F.col("_old").eqNullSafe(F.col("_new")), "DUPLICATE").otherwise("CONFLICT")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def append_immutable(existing: DataFrame, incoming: DataFrame, keys, values: list[str]) -> DataFrame:
    """Incoming rows to append: those of new keys.  Raises no error; callers check merge_state for conflicts first."""
    return incoming.join(existing.select(*_names(keys)), _names(keys), "left_anti").select(*_names(keys), *values)


def snapshot_changes(before: DataFrame, after: DataFrame, keys, values: list[str]) -> DataFrame:
    """Keys in both snapshots whose values differ, with the names of the changed values."""
    keys = _names(keys)
    a = before.select(*keys, *(F.col(v).alias(f"_a_{v}") for v in values))
    b = after.select(*keys, *(F.col(v).alias(f"_b_{v}") for v in values))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")), v) for v in values)))
    return a.join(b, keys).withColumn("changed", F.array_join(changed, ",")).filter("changed <> ''").select(*keys, "changed")


def optimistic_conflicts(df: DataFrame, keys, order: list[Column], expected: str) -> DataFrame:
    """Log rows that expected another version than the log had."""
    w = W.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn("actual", (F.row_number().over(w) - 1).cast("bigint")).filter(F.col("actual") != F.col(expected))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """start, node, depth: all nodes that edges (src, dst) reach, at their least depth.

    One join per level on the newly found nodes only, so cycles end; levels are
    checkpointed, and the search ends when a level finds nothing.  A graph deeper
    than max_depth is an error, never a partial result.  The joins are merge joins:
    small sides would else be broadcast, level by level, through the driver.
    """
    edges = edges.hint("merge")
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = found
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found.select("start", "node").hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)).select("start", "node", "depth"))
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
    raise RuntimeError(f"nodes lie deeper than {max_depth} steps")


def fingerprint(df: DataFrame, keys, order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 over each key's rows in order."""
    row = F.concat_ws(":", *(F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields))
    rows = F.array_sort(F.collect_list(F.struct(*order, row.alias("_v"))))
    return df.groupBy(*_names(keys)).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["_v"]), "|"), 256).alias("fingerprint"))


def accepted_uploads(df: DataFrame, batch: str, order: list[str], size: str, max_files: int, max_total: float) -> DataFrame:
    """Uploads of a batch that fit: limits count accepted files only, so this is a fold over the ordered batch."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("double").alias("_s"))))
    zero = F.struct(F.lit(0).alias("files"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["files"] < max_files) & (acc["total"] + x["_s"] <= max_total)
        return F.when(fits, F.struct((acc["files"] + 1).alias("files"), (acc["total"] + x["_s"]).alias("total"))).otherwise(acc)

    return df.groupBy(batch).agg(F.aggregate(entries, zero, step).alias("_a")).select(batch, F.col("_a.files").cast("bigint").alias("accepted"), F.col("_a.total").alias("accepted_size"))


def versioned_changes(current: DataFrame, changes: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows after a batch of changes, outcome of each change) of rows (key, version, value) and changes (key, seq, expected, action, value).

    INSERT expects no row (version 0), UPDATE and DELETE the version that is there.
    Of several changes of one row the first that names its version holds and makes
    the next version; the others are conflicts, told with the version they met.
    Changes of a row that is not there, but for inserts, are MISSING.
    """
    there = current.select(key, F.col("version").alias("_version"), F.lit(True).alias("_there"))
    d = changes.join(there, key, "left")
    known, actual = F.coalesce("_there", F.lit(False)), F.coalesce("_version", F.lit(0))
    fits = F.coalesce(F.when(F.col("action") == "INSERT", ~known & (F.col("expected") == 0)).otherwise(known & (F.col("expected") == actual)), F.lit(False))
    d = d.withColumns({"_fits": fits, "_actual": actual, "_known": known})
    first = F.min(F.when(F.col("_fits"), F.col("seq"))).over(W.partitionBy(key))
    d = d.withColumn("_holds", F.coalesce(F.col("_fits") & (F.col("seq") == first), F.lit(False)))
    outcome = F.when(F.col("_holds"), "DONE").when(~F.col("_known") & (F.col("action") != "INSERT"), "MISSING").otherwise("CONFLICT")
    outcomes = d.select(key, "seq", "action", outcome.alias("outcome"), F.when(~F.col("_holds"), F.col("_actual")).alias("actual"))
    done = d.filter("_holds").select(key, F.col("action").alias("_action"), F.col(value).alias("_value"))
    rows = current.join(done, key, "full_outer").filter("_action is null or _action <> 'DELETE'")
    changed = F.col("_action").isNotNull()
    return rows.select(key, (F.coalesce("version", F.lit(0)) + changed.cast("int")).alias("version"), F.when(changed, F.col("_value")).otherwise(F.col(value)).alias(value)), outcomes
