"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors of one label are normalised, so cosine c means distance sqrt(2 - 2c).
Each of several tables quantises K random Gaussian projections with width W; two
vectors meet where all K quantised values agree.  The number of tables follows
from the recall wanted at the threshold.  Vectors that meet are compared exactly
in double precision, in blocks inside a bucket: a bucket's task returns counts
and a spanning forest of the links it found, never the pairs; a bucket of more
than BLOCK vectors is dealt out as pairs of blocks, so no task holds a whole hot
bucket.  Equal vectors of a label are one class from the start, keyed by a 128-bit
digest and never by an id.  Exact counts need every pair of different vectors of
a bucket: one of n vectors ships each of them n / BLOCK times.

A pair that meets in several tables counts in the first of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing (0 links, own
component, kept); vectors of different length never link; every input row is a
vector of its own, also rows that repeat a vec_id or have none (a null id is
larger than any other); an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.links import components
from bidloom.llm.shared import cut, looked_up

PROJECTIONS, WIDTH, BLOCK, SEED = 14, 1.6, 2048, 20


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two points at this distance."""
    if distance <= 0:
        return 1.0
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def tables_for(threshold: float, recall: float, projections: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Tables that find a pair right at the threshold with this probability."""
    meet = agreement(math.sqrt(2 - 2 * threshold), width) ** projections
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of extreme values neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signatures(x: np.ndarray, tables: int) -> np.ndarray:
    """int64 (rows, tables): the hash of each table's K quantised projections."""
    draw = np.random.default_rng([SEED, x.shape[1]])
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        a, b = draw.standard_normal((x.shape[1], PROJECTIONS)), draw.uniform(0, WIDTH, PROJECTIONS)
        q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64)
        h = np.full(len(x), t + 1, np.uint64)
        for k in range(PROJECTIONS):
            h = (h ^ q[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = h.view(np.int64)
    return out


def _hashed(tables: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            sizes = np.diff(vectors.offsets.to_numpy())
            sig = np.zeros((batch.num_rows, tables), np.int64)
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                own = flat[starts[rows][:, None] + np.arange(size)]
                sig[rows] = _signatures(_unit(own, len(rows)), tables)
            made = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * tables + 1, tables, np.int32), sig.reshape(-1))
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            kind = np.dtype(flat.dtype).itemsize
            data = flat.tobytes()
            reps = [xxhash.xxh3_128_digest(data[a * kind : (a + n) * kind], seed=xxhash.xxh3_64_intdigest(repr(x))) for a, n, x in zip(starts.tolist(), sizes.tolist(), labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns, made, pa.array(reps, pa.binary())], [*batch.schema.names, "sig", "rep"])

    return run


def _links_in_block(threshold: float):
    """(node, links, root) of the nodes of one bucket block that have links."""

    def run(key, table):
        t, lo, hi = key[0].as_py(), key[-2].as_py(), key[-1].as_py()
        empty = pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        n = table.num_rows
        if n < 2:
            return empty
        table = table.sort_by([("c", "ascending"), ("rep", "ascending")]).combine_chunks()
        ids, copies, chunk = table.column("rep"), table.column("copies").to_numpy(), table.column("c").to_numpy()
        x = _unit(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), n)
        sig = table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        split = int((chunk == lo).sum()) if lo != hi else 0
        links, parent = np.zeros(n, np.int64), np.arange(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, split or n, 256):
            rows = np.arange(at, min(at + 256, split or n))
            first = split or at
            near = x[rows] @ x[first:].T >= threshold
            if not split:
                near &= rows[:, None] < np.arange(first, n)[None, :]
            i, j = np.nonzero(near)
            i, j = rows[i], j + first
            for s in range(t):  # counted in an earlier table
                fresh = sig[i, s] != sig[j, s]
                i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        own = np.flatnonzero(links)
        if not len(own):
            return empty
        return pa.table({"node": ids.take(pa.array(own)), "links": pa.array(links[own], pa.int64()), "root": ids.take(pa.array([root(i) for i in own.tolist()]))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    tables = tables_for(threshold, recall)
    own = vectors.select("vec_id", "embedding", "label")
    sound = F.col("label").isNotNull() & F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    valid = own.filter(sound)
    first = F.min(F.struct(F.isnull("vec_id").alias("z"), F.coalesce("vec_id", F.lit(0)).cast("long").alias("k"))).alias("first")
    classes = valid.groupBy("label", "embedding").agg(first, F.count("*").alias("copies"))
    kinds = dict(own.dtypes)
    columns = f"label {kinds['label']}, embedding {kinds['embedding']}, first struct<z: boolean, k: long>, copies long, sig array<long>, rep binary"
    reps = cut(classes.mapInArrow(_hashed(tables), columns))
    met = reps.select("rep", "label", F.size("embedding").alias("d"), F.posexplode("sig").alias("t", "bucket"))
    crowded = met.groupBy("t", "bucket", "label", "d").agg(F.count("*").alias("n")).filter("n > 1")
    members = met.join(crowded, ["t", "bucket", "label", "d"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    dealt = members.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("t", "bucket", "label", "d", "rep", "c", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"))
    full = dealt.join(reps.select("rep", "embedding", "copies", "sig"), "rep")
    found = cut(full.groupBy("t", "bucket", "label", "d", "lo", "hi").applyInArrow(_links_in_block(threshold), "node binary, links long, root binary"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "rep")
    member_of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    member_of = member_of.join(reps.select("rep", "first"), "rep")
    least = member_of.groupBy("component").agg(F.min("first").alias("reached"))
    known = reps.select("rep", "label", "embedding", "copies", "first").join(degree, "rep", "left").join(member_of.join(least, "component").select("rep", "reached"), "rep", "left")
    told = known.select("label", "embedding", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "first").alias("reached"))
    linked = looked_up(valid, told, ["label", "embedding"]).select("vec_id", "n_links", F.when(~F.col("reached.z"), F.col("reached.k")).alias("component_id"))
    alone = own.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
