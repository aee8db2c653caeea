"""Hard negatives by distributed radix selection over integer scores.

A row's score is its integer inner product with an anchor, of components that are
quantised to floor(scale * x).  An anchor's positives are its best rows of the same
label; each positive opens a window of scores, and the best rows of other labels
inside it are its hard negatives.  Better means a higher score, then a smaller id.

Both choices are one selection.  Rows and anchors are dealt into blocks, and each
pair of blocks is one task's work, so every anchor meets every row and no score is
ever stored.  A round makes a histogram of the leading digit of each open window:
a block reports only the digits down to the one that holds its own kth row, as the
kth row of all cannot lie below.  The summed histogram tells the digit that holds
the kth row; the next round refines that digit.  Where many rows tie at the kth
score, the digits of their ids follow.  A window is settled once at most GATHER
rows are left down to the end of its digit; only those rows are then gathered, and
ranked.

A block's report is at most k digits a window, a settled window at most GATHER rows,
a task one block pair, whatever the data; hot labels, copies and ties change none of
these.  Rounds are bounded by the digits of a score and an id.

Defined results: rows with a null label, a null or empty vector or a null or
non-finite component take no part, nor do rows with a
component of 2**24 or more once quantised, whose scores need not fit 64 bits; vectors of
different length never meet; every row is one of its own, also where rows repeat an
id or a vector (equal rows are each other's neighbours); a null id comes after
any other (the largest 64-bit id is taken for null); anchors without positives or
windows without rows give no rows; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.shared import cut

ROW_BLOCK, ANCHOR_BLOCK, ANCHORS_AT_ONCE, MAX_TASKS = 4096, 1024, 128, 100_000
DIGIT_BITS, GATHER = 16, 64
LIMIT, NO_ID = 1 << 24, (1 << 63) - 1
#: One open or settled window: the anchor, whether labels must be equal, the window's scores, the digit that holds the kth row as scores and ids, and rows still needed within it.
WINDOW = "ak long, pr int, label long, same boolean, q array<int>, lo long, hi long, slo long, shi long, ilo long, ihi long, need int"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, d, q (array of int), key: the rows that take part, each with a key of its own."""
    sound = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    own = vectors.select("vec_id", "label", "embedding").filter(sound)
    own = own.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("d"),
        F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT)))).alias("q"),
    )
    own = own.filter(f"array_max(q) < {LIMIT} and array_min(q) > {-LIMIT}").withColumn("q", F.col("q").cast("array<int>"))
    return cut(own.withColumn("key", F.monotonically_increasing_id()))


_FIELDS = [c.split()[0] for c in WINDOW.split(", ") if not c.startswith("q ")]


def _packed(key, table):
    """One row of a block: keys, ids and labels as int64 and vectors as int32, row by row."""
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4")
    cells = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("key", "id", "label")]
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "rb": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([b], pa.binary()) for c, b in zip(("keys", "ids", "labels", "rows"), [*cells, flat.tobytes()])}})


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and of b: by floats where every sum is a whole number they hold."""
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _meetings(batches: Iterator[pa.RecordBatch]):
    """(window, scores, ids) of the block's rows inside each window of the anchors that meet it."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {c: batch.column(batch.schema.get_field_index(c))[i] for c in ("d", "keys", "ids", "labels", "rows", "wins")}
            keys, ids, labels = (np.frombuffer(cell[c].as_buffer(), "<i8") for c in ("keys", "ids", "labels"))
            rows = np.frombuffer(cell["rows"].as_buffer(), "<i4").reshape(len(keys), cell["d"].as_py()).astype(np.int64)
            told = cell["wins"].values
            vectors = told.field("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(told), -1)
            windows = [dict(zip(_FIELDS, values)) for values in zip(*(told.field(f).to_pylist() for f in _FIELDS))]
            _, first, of = np.unique([w["ak"] for w in windows], return_index=True, return_inverse=True)
            for at in range(0, len(first), ANCHORS_AT_ONCE):
                scores = _products(vectors[first[at : at + ANCHORS_AT_ONCE]], rows)
                for j in np.flatnonzero((of >= at) & (of < at + ANCHORS_AT_ONCE)).tolist():
                    w, own = windows[j], scores[of[j] - at]
                    inside = np.flatnonzero((own >= w["lo"]) & (own <= w["hi"]))
                    inside = inside[((labels[inside] == w["label"]) == w["same"]) & (keys[inside] != w["ak"])]
                    if len(inside):
                        yield w, own[inside], ids[inside]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each window's leading digits in one block, down to the digit of the block's own kth row."""
    out: list[tuple] = []
    for w, scores, ids in _meetings(batches):
        by_id = w["slo"] == w["shi"]
        if by_id:
            first, last = w["ilo"], w["ihi"]
            places = ids[(scores == w["slo"]) & (ids >= first) & (ids <= last)].view(np.uint64) - np.uint64(first % (1 << 64))
        else:
            first, last = w["slo"], w["shi"]
            places = (last - scores[(scores >= first) & (scores <= last)]).view(np.uint64)
        if not len(places):
            continue
        shift = max(0, (last - first).bit_length() - DIGIT_BITS)
        digits = places >> np.uint64(shift)
        if len(digits) > w["need"]:
            digits = digits[digits <= np.partition(digits, w["need"] - 1)[w["need"] - 1]]
        for digit, n in zip(*(x.tolist() for x in np.unique(digits, return_counts=True))):
            near, far = digit << shift, (digit + 1 << shift) - 1
            out.append((w["ak"], w["pr"], digit, *((first + near, min(first + far, last)) if by_id else (max(last - far, first), last - near)), n, w["need"]))
        if len(out) >= 50_000:
            yield _batch(out, HISTOGRAM)
            out = []
    if out:
        yield _batch(out, HISTOGRAM)


def _gathered(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each settled window in one block, its best k at most."""
        out: list[tuple] = []
        for w, scores, ids in _meetings(batches):
            own = (scores > w["shi"]) | ((scores >= w["slo"]) & ((w["slo"] < w["shi"]) | (ids <= w["ihi"])))
            scores, ids = scores[own], ids[own]
            for j in np.lexsort((ids, -scores))[:k].tolist():
                out.append((w["ak"], w["pr"], int(scores[j]), int(ids[j])))
            if len(out) >= 50_000:
                yield _batch(out, GATHERED)
                out = []
        if out:
            yield _batch(out, GATHERED)

    return run


HISTOGRAM = pa.schema([("ak", pa.int64()), ("pr", pa.int32()), ("digit", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("need", pa.int32())])
GATHERED = pa.schema([("ak", pa.int64()), ("pr", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Grid:
    """Row blocks that any windows can be held against, block by block."""

    def __init__(self, rows: DataFrame, n_rows: int, n_anchors: int, row_block: int, anchor_block: int):
        self.row_blocks, self.anchor_blocks = -(-n_rows // row_block), -(-n_anchors // anchor_block)
        self.tasks = min(MAX_TASKS, 2 * self.row_blocks * self.anchor_blocks)
        dealt = rows.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(self.row_blocks)).cast("int"))
        self.blocks = cut(dealt.groupBy("d", "rb").applyInArrow(_packed, "d int, rb int, keys binary, ids binary, labels binary, rows binary"))

    def held(self, windows: DataFrame) -> DataFrame:
        """A row for each block pair: the rows' block and the windows of an anchors' block."""
        fields = [c.split()[0] for c in WINDOW.split(", ")]
        probes = windows.groupBy("d", F.pmod(F.xxhash64("ak"), F.lit(self.anchor_blocks)).cast("int").alias("ab")).agg(F.collect_list(F.struct(*fields)).alias("wins"))
        probes = probes.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(self.row_blocks - 1)))).repartition(self.tasks, "d", "ab", "rb")
        blocks = self.blocks.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(self.anchor_blocks - 1)))).repartition(self.tasks, "d", "ab", "rb")
        return blocks.join(probes.hint("shuffle_hash"), ["d", "ab", "rb"]).select("d", "keys", "ids", "labels", "rows", "wins")

    def best(self, windows: DataFrame, k: int) -> DataFrame:
        """ak, pr, rank, score, id: the first k rows of each window (WINDOW with d)."""
        columns, pair = windows.columns, ["ak", "pr"]
        settled, pending = None, cut(windows)
        while pending.head(1):
            counts = self.held(pending).mapInArrow(_histograms, "ak long, pr int, digit long, first long, last long, n long, need int")
            counts = counts.groupBy(*pair, "digit").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("need").alias("asked"))
            counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*pair).orderBy("digit")))
            found = counts.filter("upto - n < asked and asked <= upto").select(*pair, "first", "last", "n", (F.col("asked") - (F.col("upto") - F.col("n"))).cast("int").alias("rest"))
            # Grouped rather than joined: the planner's size estimate of a join is a product, which rounds would raise to powers.
            both = pending.unionByName(found, allowMissingColumns=True)
            told = both.groupBy(*pair).agg(*(F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in pair))
            by_id, some = F.col("slo") == F.col("shi"), F.col("n").isNotNull()
            told = told.withColumns(
                {
                    "slo": F.when(some & ~by_id, F.col("first")).otherwise(F.col("slo")),
                    "shi": F.when(some & ~by_id, F.col("last")).otherwise(F.col("shi")),
                    "ilo": F.when(some & by_id, F.col("first")).otherwise(F.col("ilo")),
                    "ihi": F.when(some & by_id, F.col("last")).otherwise(F.col("ihi")),
                    "need": F.coalesce("rest", "need"),
                }
            )
            done = ~some | (k - F.col("need") + F.col("n") <= GATHER) | ((F.col("slo") == F.col("shi")) & (F.col("ilo") == F.col("ihi")))
            told = cut(told.select(*columns, done.alias("done")))
            ended, pending = told.filter("done").select(columns), told.filter("not done").select(columns)
            settled = ended if settled is None else settled.union(ended)
        rows = self.held(windows if settled is None else settled).mapInArrow(_gathered(k), "ak long, pr int, score long, id long")
        order = W.partitionBy(*pair).orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchor: str,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of ``vectors`` (vec_id, label, embedding).

    ``anchor`` is a condition on vec_id, as SQL; rows without an id are no anchors.
    A negative's score lies between low and high percent of the positive's.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = quantised(vectors, scale)
    anchors = rows.filter(F.col("id") != NO_ID).withColumn("vec_id", F.col("id")).filter(anchor).drop("vec_id")
    span = rows.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.array_max(F.transform("q", F.abs))).alias("most"), F.max("d").alias("d")).first()
    n_anchors = anchors.count()
    if not span.n or not n_anchors:
        return vectors.sparkSession.createDataFrame([], result)
    bound = max(1, span.most**2 * span.d)
    grid = Grid(rows, span.n, n_anchors, row_block, anchor_block)
    everything = {"lo": -bound, "hi": bound, "slo": -bound, "shi": bound, "ilo": span.first, "ihi": span.last}
    opened = anchors.select("d", F.col("key").alias("ak"), F.lit(0).alias("pr"), "label", F.lit(True).alias("same"), "q", *(F.lit(v).cast("long").alias(c) for c, v in everything.items()), F.lit(positives).alias("need"))
    best = cut(grid.best(opened, positives).select("ak", F.col("rank").alias("pr"), F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    least = F.expr(f"({low} * positive_score + {high - 1}) div {high}")
    around = best.filter("positive_score >= 0").withColumns({"lo": least, "hi": F.col("positive_score")})  # below 0 no score is between low and high percent
    limits = {"slo": F.col("lo"), "shi": F.col("hi"), "ilo": F.lit(span.first).cast("long"), "ihi": F.lit(span.last).cast("long")}
    windows = around.join(opened.select("d", "ak", "label", "q"), "ak").select("d", "ak", "pr", "label", F.lit(False).alias("same"), "q", "lo", "hi", *(v.alias(c) for c, v in limits.items()), F.lit(negatives).alias("need"))
    found = grid.best(windows, negatives).join(best, ["ak", "pr"]).join(anchors.select(F.col("key").alias("ak"), F.col("id").alias("anchor_id")), "ak")
    shown = [F.nullif(F.col(c), F.lit(NO_ID)).alias(f"{c}_id") for c in ("positive", "negative")]
    return found.withColumn("negative", F.col("id")).select("anchor_id", shown[0], "rank", shown[1], "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
