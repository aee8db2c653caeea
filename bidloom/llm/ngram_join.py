"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document's set is that of its five-word n-grams (lower case, runs of letters
and digits; a shorter text is one n-gram).  Documents with equal sets are one
class, keyed by a 128-bit digest of the set and never by an id.  Classes shuffle
on band hashes; band and row counts follow from the recall wanted at the
threshold.  Where classes meet in a band, sketches of 64 bytes, shipped along,
drop pairs far below the threshold (a pair at the threshold is lost with a
chance of about 0.0001, besides what the bands lose), and a spanning forest of
the rest names candidate groups.  One text of each class in a group is shipped,
and every pair of classes is verified on its full n-gram sets; what leaves a
task is a count for each class and a spanning forest of the links.

A bucket or group beyond its block size is dealt out as pairs of blocks, so no
task holds a hot one, and no step makes a row for a pair.  The price is that a
group of n different texts ships each of them n / GROUP_BLOCK times: exact link
counts need every pair of different texts.

Defined results: null text counts as empty; texts without a word link with
nothing; documents of equal sets link with each other; every input row is a
document of its own, also rows that repeat a doc_id or have none (a null id is
larger than any other); an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.links import components
from bidloom.llm.shared import cut, keyed, looked_up

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
ROWS, SKETCH, LOOSE = 8, 64, 0.6
BUCKET_BLOCK, GROUP_BLOCK = 2048, 256
MEMO_WORDS = 500_000
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows that let a pair at the threshold meet with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class Shingler(dict):
    """Text -> its sorted distinct n-gram hashes; remembers the hashes of words."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def grams(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        size = min(self.n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * _PRIME
            out ^= out >> np.uint64(32)
        return np.unique(out)


class MinHash:
    """Band hashes and sketch of a set by multiply-shift functions on 32 bits."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(8)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 2**32, k, np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 2**32, k, np.uint32)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        x = (grams ^ grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            part = self.a[:, None] * x[None, at : at + 1024]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            part += self.b[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        cells = least.reshape(self.bands, self.rows).astype(np.uint64)
        for r in range(self.rows):
            h = (h ^ cells[:, r]) * _PRIME
            h ^= h >> np.uint64(29)
        return h.view(np.int64), (least[:SKETCH] * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), digest of the n-gram set (null without words), bands array<long>, sketch binary."""

    def run(batches):
        shingler, minhash = Shingler(n), MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                digests, sketches, hashes = [], [], []
                for text in part.column(2).to_pylist():
                    grams = shingler.grams(text)
                    if len(grams):
                        h, s = minhash(grams)
                        digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                        sketches.append(s)
                        hashes.append(h)
                    else:
                        digests.append(None)
                        sketches.append(None)
                        hashes.append(np.zeros(0, np.int64))
                offsets = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                made = pa.ListArray.from_arrays(offsets, np.concatenate(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(digests, pa.binary()), made, pa.array(sketches, pa.binary())], ["doc_id", "th", "digest", "bands", "sketch"])

    return keyed(docs).select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, digest binary, bands array<long>, sketch binary")


def deal(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``members`` with column n (their group's size) as pairs of blocks: columns c (own block), lo, hi.

    A group within the block size stays whole; of a larger one every member goes
    to as many block pairs as there are blocks.
    """
    parts = members.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int"))
    return parts.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"lo": F.least("c", "j"), "hi": F.greatest("c", "j")}).drop("n", "nb", "j")


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _pairs(table: pa.Table, lo: int, hi: int):
    """The block's rows in key order, with the first ``split`` of them the lower block; 0 if it is one block."""
    table = table.sort_by([("c", "ascending"), ("rep", "ascending")]).combine_chunks()
    return table, int((table.column("c").to_numpy() == lo).sum()) if lo != hi else 0


def _candidates(key, table):
    """(a, b): a forest over those of one bucket block whose sketches agree."""
    lo, hi = key[-2].as_py(), key[-1].as_py()
    nothing = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    if table.num_rows < 2:
        return nothing
    table, split = _pairs(table, lo, hi)
    ids = table.column("rep")
    n = len(ids)
    x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
    forest = Forest(n)
    for i in range(split or n):
        first = split or i + 1
        agree = np.count_nonzero(x[first:] == x[i], axis=1)
        for j in np.flatnonzero(agree >= LOOSE * SKETCH).tolist():
            forest.join(i, first + j)
    roots = np.array([forest.root(i) for i in range(n)])
    own = np.flatnonzero(roots != np.arange(n))
    return pa.table({"a": ids.take(pa.array(own)), "b": ids.take(pa.array(roots[own]))})


def _verified(n: int, threshold: float):
    """(node, links, root): links of one group block, counted in documents, by full n-gram sets."""

    def run(key, table):
        lo, hi = key[-2].as_py(), key[-1].as_py()
        nothing = pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        if table.num_rows < 2:
            return nothing
        table, split = _pairs(table, lo, hi)
        ids, copies = table.column("rep"), table.column("copies").to_numpy()
        shingler = Shingler(n)
        sets = [shingler.grams(t) for t in table.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        count = len(ids)
        links, forest = np.zeros(count, np.int64), Forest(count)
        has = np.zeros(flat.max() + 1, np.uint8)
        for i in range(split or count):
            first = split or i + 1
            if first >= count:
                break
            own = flat[starts[i] : starts[i] + sizes[i]]
            has[own] = 1
            shared = np.add.reduceat(has[flat[starts[first] :]].astype(np.int32), starts[first:] - starts[first])
            has[own] = 0
            near = np.flatnonzero(shared >= threshold * (sizes[i] + sizes[first:] - shared) - 1e-9)
            if len(near):
                j = near + first
                links[i] += copies[j].sum()
                links[j] += copies[i]
                for k in j.tolist():
                    forest.join(i, k)
        own = np.flatnonzero(links)
        roots = np.array([forest.root(i) for i in own.tolist()], np.int64)
        return pa.table({"node": ids.take(pa.array(own)), "links": pa.array(links[own], pa.int64()), "root": ids.take(pa.array(roots))}) if len(own) else nothing

    return run


def _classes(known: DataFrame) -> DataFrame:
    """digest, copies, first (the class's least id and text hash, null ids last), bands, sketch of each class."""
    first = F.min(F.struct(F.isnull("doc_id").alias("z"), F.coalesce("doc_id", F.lit(0)).alias("k"), "th")).alias("first")
    return known.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def _told(docs: DataFrame, known: DataFrame, n: int, threshold: float, bucket_block: int, group_block: int) -> DataFrame:
    """digest, copies, n_links, class_first (the least ``first`` of the classes that links reach) of each class."""
    classes = cut(_classes(known))
    met = classes.select(F.col("digest").alias("rep"), "sketch", F.explode("bands").alias("band"))
    crowded = met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = deal(met.join(crowded, "band"), ["band"], bucket_block)
    groups = components(dealt.groupBy("band", "lo", "hi").applyInArrow(_candidates, "a binary, b binary"))
    groups = groups.withColumnRenamed("node", "rep").withColumnRenamed("component", "g")
    sized = groups.join(groups.groupBy("g").agg(F.count("*").alias("n")), "g").join(classes.select(F.col("digest").alias("rep"), "copies", "first.*"), "rep")
    # One text of a class, also where rows repeat both id and text; equal rows meet before the shuffle.
    texts = keyed(docs).drop("doc_id").join(sized, ["k", "z", "th"]).groupBy("rep").agg(*(F.first(c).alias(c) for c in ("text", "g", "n", "copies")))
    found = cut(deal(texts, ["g"], group_block).groupBy("g", "lo", "hi").applyInArrow(_verified(n, threshold), "node binary, links long, root binary"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "digest")
    member_of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    member_of = member_of.join(classes.select("digest", "first"), "digest")
    least = member_of.groupBy("component").agg(F.min("first").alias("class_first"))
    member_of = member_of.join(least, "component").select("digest", "class_first")
    told = classes.select("digest", "copies", "first").join(degree, "digest", "left").join(member_of, "digest", "left")
    return told.select("digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_first", "first").alias("class_first"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, bucket_block: int = BUCKET_BLOCK, group_block: int = GROUP_BLOCK) -> DataFrame:
    """doc_id, n_links (other rows at the threshold or above), class_id (smallest doc_id that links reach, itself included), kept (whether that is its id)."""
    known = cut(signatures(docs, n, bands_for(threshold, recall, rows), rows))
    told = _told(docs, known, n, threshold, bucket_block, group_block)
    class_id = F.when(~F.col("class_first.z"), F.col("class_first.k")).alias("class_id")
    linked = looked_up(known.select("doc_id", "digest"), told, ["digest"]).select("doc_id", "n_links", class_id)
    alone = known.filter("digest is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicated(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with one row of each group: the one of the smallest id, null ids last.

    Rows without a word are groups of their own.  Of rows that repeat a group's
    first id and text one stays.
    """
    known = cut(signatures(docs, n, bands_for(threshold, recall, rows), rows))
    first = _told(docs, known, n, threshold, BUCKET_BLOCK, GROUP_BLOCK).select("class_first.*").distinct()
    columns = ("lang", "source", "n_chars")
    own = keyed(docs.withColumn("_text", F.col("text")), ("_text", *columns))
    wordless = known.filter("digest is null").select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.isnull("doc_id").alias("z"), "th").distinct()
    kept = own.join(first, ["k", "z", "th"], "left_semi").dropDuplicates(["k", "z", "th"]).unionByName(own.join(wordless, ["k", "z", "th"], "left_semi"))
    return kept.select("doc_id", F.col("_text").alias("text"), *columns)
