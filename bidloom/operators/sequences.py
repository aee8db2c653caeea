"""Operators over ordered rows: segments, carried state, as-of lookups, context frames, islands."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.sources.lineage import cut


def _running(keys: list[str], order: list[Column]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def blocks(df: DataFrame, keys: list[str], order: list[Column], is_anchor: Column, name: str = "block") -> DataFrame:
    """Each row's block: the number of anchors up to it; 0 before the first."""
    return df.withColumn(name, F.sum(F.when(is_anchor, 1).otherwise(0)).over(_running(keys, order)))


def carry_forward(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_running(keys, order)))


def first_role(df: DataFrame, keys: list[str], order: list[Column], priced: Column, name: str = "role") -> DataFrame:
    """The first priced row of a group is PRIMARY, later priced ones MANDATORY_COMPONENT, others NOTE."""
    before = F.sum(F.when(priced, 1).otherwise(0)).over(_running(keys, order))
    return df.withColumn(name, F.when(~priced, "NOTE").when(before == 1, "PRIMARY").otherwise("MANDATORY_COMPONENT"))


def as_of(df: DataFrame, keys: list[str], order: list[Column], is_lookup: Column, value: Column, name: str) -> DataFrame:
    """For every row, the value of the latest lookup row strictly before it.  One sort, no range join."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_lookup, value), ignorenulls=True).over(w))


def context(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, before: int = 1, after: int = 1) -> DataFrame:
    return df.withColumn(name, F.collect_list(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)))


def neighbour_flag(df: DataFrame, keys: list[str], order: list[Column], same: str, name: str) -> DataFrame:
    """Whether the row before or after has the same value."""
    w = W.partitionBy(*keys).orderBy(*order)
    near = F.coalesce(F.lag(same).over(w) == F.col(same), F.lit(False)) | F.coalesce(F.lead(same).over(w) == F.col(same), F.lit(False))
    return df.withColumn(name, near)


def anchored_islands(df: DataFrame, keys: list[str], seq: str, is_anchor: Column, same_group: Column, has_reference: Column, matches: Column) -> DataFrame:
    """Rows that belong to each key's anchor row.

    Backward from the anchor while rows are of its group, carry a reference and
    match; forward until another group or a reference that does not match, so
    rows without reference are taken in forward only.  The rows strictly between
    the nearest stop on either side.
    """
    everything = W.partitionBy(*keys)
    d = df.withColumn("_a", F.min(F.when(is_anchor, F.col(seq))).over(everything))
    backward = F.max(F.when((F.col(seq) < F.col("_a")) & ~(same_group & has_reference & matches), F.col(seq))).over(everything)
    forward = F.min(F.when((F.col(seq) > F.col("_a")) & (~same_group | (has_reference & ~matches)), F.col(seq))).over(everything)
    d = d.withColumns({"_b": backward, "_f": forward})
    inside = (F.col("_b").isNull() | (F.col(seq) > F.col("_b"))) & (F.col("_f").isNull() | (F.col(seq) < F.col("_f")))
    return d.filter(F.col("_a").isNotNull() & inside).drop("_a", "_b", "_f")


def gap_sessions(df: DataFrame, keys: list[str], order: Column, gap: float, name: str = "session") -> DataFrame:
    """Sessions that end where the step to the next row is ``gap`` or more."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.when(order - F.lag(order).over(w) >= gap, 1).otherwise(0)
    d = df.withColumn("_new", new)
    return d.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def collapse_adjacent(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    return df.withColumn("_p", F.lag(value).over(W.partitionBy(*keys).orderBy(*order))).filter(~F.col("_p").eqNullSafe(F.col(value))).drop("_p")


def lone_in_range(df: DataFrame, keys: list[str], at: str, within: float, name: str = "lone") -> DataFrame:
    """Whether no other row stands within a distance.

    Rows fall into bins as wide as the distance, so those of one bin are near; of
    the bins around only the extremes matter.  A key is many small groups, and no
    group is sorted.
    """
    bins = df.groupBy(*keys, F.floor(F.col(at) / within).alias("_b")).agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    spread = bins.withColumn("_d", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1, 2))))).withColumn("_b", F.col("_b") + F.col("_d"))
    around = spread.groupBy(*keys, "_b").agg(F.sum(F.when(F.col("_d") == 0, F.col("_n"))).alias("_own"), F.max(F.when(F.col("_d") > 0, F.col("_hi"))).alias("_left"), F.min(F.when(F.col("_d") < 0, F.col("_lo"))).alias("_right"))
    near = (F.col("_own") > 1) | F.coalesce(F.col("_left") >= F.col(at) - within, F.lit(False)) | F.coalesce(F.col("_right") <= F.col(at) + within, F.lit(False))
    return df.withColumn("_b", F.floor(F.col(at) / within)).join(around, [*keys, "_b"]).withColumn(name, ~near).drop("_b", "_own", "_left", "_right")


def _swept(items: DataFrame, keys: list[str], columns: list[str], sweep) -> DataFrame:
    """keys, seq, line of items (keys, seq, columns): one pass over each partition's items in their order, page after page.

    ``sweep()`` gives a step that takes whether an item is its page's first, and the item's columns, and returns its line;
    pages are neither gathered nor sent one by one.
    """
    kinds = dict(items.dtypes)
    kept = [*keys, "seq"]

    def run(batches):
        step = sweep()
        for batch in batches:
            values = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_i", *columns))
            lines = [step(i == 1, *item) for i, *item in zip(*values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lines, pa.int32())], names=[*kept, "line"])

    order = [F.col(c).asc_nulls_last() for c in (*columns, "seq")]
    d = items.select(*kept, *columns).withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", line int")


def clustered_lines(items: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Visual lines of text items (keys, seq, y): an item joins the line whose running centre lies within the tolerance.

    The centre moves with every item, so no window can tell; a page is one pass over its ordered items.
    """

    def sweep():
        line, n, centre = 0, 0, 0.0

        def step(first: bool, y: float) -> int:
            nonlocal line, n, centre
            if not first and abs(y - centre) <= tolerance:
                centre += (y - centre) / (n + 1)
                n += 1
            else:
                line, n, centre = 1 if first else line + 1, 1, y
            return line

        return step

    return _swept(items, keys, ["y"], sweep)


def overlapping_lines(items: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Visual lines of text items (keys, seq, y, x, height): an item joins the newest line of which it overlaps some item by ``share`` of the lower of both heights.

    Lines are numbered from 1 by their first item.  Items are taken from the top, so
    boxes that end above the present item are left behind for good.
    """

    def sweep():
        live, last = [], 0  # live: [line, boxes that may still overlap], oldest line first

        def step(first: bool, y: float, _x, h: float) -> int:
            nonlocal live, last
            if first:
                live, last = [], 0
            for line in live:
                line[1] = [b for b in line[1] if b[1] >= y]
            live = [line for line in live if line[1]]
            joined = next((line for line in reversed(live) if any(min(b, y + h) - max(t, y) >= min(b - t, h) * share for t, b in line[1])), None)
            if joined is None:
                last += 1
                joined = [last, []]
                live.append(joined)
            joined[1].append((y, y + h))
            return joined[0]

        return step

    return _swept(items, keys, ["y", "x", "height"], sweep)


def numbered_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in one global order, range-partitioned and checkpointed, with their partition ``_p`` and place ``_i`` in it."""
    placed = cut(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    return placed.withColumns({"_p": F.shiftright("_i", 33), "_i": F.col("_i").bitwiseAND((1 << 33) - 1)})


def running_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before a row in one global order, as its partition's offset and a sum within the partition."""
    placed = numbered_ranges(df, order)
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_p", F.coalesce(F.sum("_sum").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row per partition
    within = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", within).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_p", "_i", "_offset", "_inside")


def pages_of(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """row_number and 1-based page of a result in one global order."""
    d = running_before(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_before").drop("_one")
    number = F.col("_before") + 1
    return d.withColumns({"row_number": number, "page": F.ceil(number / size).cast("bigint")}).drop("_before")


def sampled_pages(n: Column) -> Column:
    """Pages 1 to 5, a third, two thirds and the last, distinct and in order."""
    near = F.sequence(F.lit(1), F.least(F.lit(5), n))
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.concat(near, F.array(F.ceil(n / 3).cast("int"), F.ceil(n * 2 / 3).cast("int"), n)))))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the middle value of each group, the upper one of two; nulls do not count.  Groups are ranked, never gathered."""
    w = W.partitionBy(*keys)
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias(name))
    d = d.withColumns({"_r": F.row_number().over(w.orderBy(name)), "_n": F.count("*").over(w)})
    return d.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")

