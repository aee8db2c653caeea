"""Stupid-backoff language-model scores, computed relationally.

Every document is scored by the n-gram counts of all other documents (its own
are taken off the corpus totals, else every n-gram would vouch for itself):

    S(w | u v) = c(u v w) / c(u v)            if c(u v w) > 0
               = BACKOFF * S(w | v)           otherwise
    S(w | v)   = c(v w) / c(v)                if c(v w) > 0
               = BACKOFF * S(w)               otherwise
    S(w)       = max(c(w), 1) / N

The first words of a document start at the order that their history allows.

Documents fall into blocks by hash, and a block counts its distinct n-grams of
orders 1 to ORDER (so an n-gram of a third of all documents counts once a block).
Its hashes are sorted, cut into ranges and packed as the steps from one to the
next; a range adds up all blocks and answers each cell with how often the other
blocks hold its n-grams, in the cell's own order, so that no n-gram travels back.
The answers meet the block's documents, whose n-grams fall in the same order
again, and the words' scores are summed per document.  The corpus total travels
as the n-gram of order 0.

Nothing is broadcast or collected; all n-grams of all texts count.  N-grams are
told apart by 64-bit hashes.

Defined results: words are runs of letters and digits, lower case; null text
counts as empty; a text without words has 0 words and score 0; every input row
is a document of its own, also where rows repeat; one document alone meets
unseen words only; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.packing import range_width, ranges, squeeze, unsqueeze

BACKOFF, ORDER = 0.4, 3
BLOCK_BYTES, SLICES = 16 << 20, 8
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_TOTAL = np.uint64(0)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _explode(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The document of each word; and for each order the hashes of its n-grams and the index of their last word."""
    memo = _Hashes()
    found = [np.array([memo[w] for w in _WORD.findall(t.lower())], np.uint64) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f in found])
    words = np.concatenate([np.zeros(0, np.uint64), *found])
    hashes, last = [words], [np.arange(len(words), dtype=np.int32)]
    for k in range(1, order):
        # n-gram of order k + 1: the one of order k that ends a word before, and the word
        whole = np.flatnonzero(doc[k:] == doc[: len(doc) - k]) + k if len(doc) > k else np.zeros(0, np.int64)
        before = hashes[-1][np.searchsorted(last[-1], whole - 1)]
        h = (before * _PRIME ^ words[whole]) * _PRIME
        hashes.append(h ^ h >> np.uint64(29))
        last.append(whole.astype(np.int32))
    return doc, hashes, last


def _count(order: int, parts: int):
    """(part, block, n, steps, counts): the hashes of a block's distinct n-grams in each range of hashes, and how often it holds them."""

    def run(key, table):
        doc, hashes, _ = _explode(table.column("text").to_pylist(), order)
        h = np.concatenate(hashes)
        hashes.clear()  # as large as what follows
        h.sort()
        new = _begins(h)
        keys, counts = np.append(_TOTAL, h[new]), np.append(len(doc), _lengths(new)).astype(np.uint32)
        del h, new
        own = ranges(keys, parts)
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in own], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(own), pa.int32()),
                "n": pa.array([b - a for _, a, b in own], pa.int32()),
                "steps": pa.array([squeeze(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in own], pa.binary()),
                "counts": pa.array([squeeze(counts[a:b]) for _, a, b in own], pa.binary()),
            }
        )

    return run


def _elsewhere(key, table):
    """(part, block, n, elsewhere): how often other blocks hold the n-grams of each cell."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(unsqueeze(d, n, np.uint64), dtype=np.uint64) for d, n in zip(table.column("steps").to_pylist(), sizes)])
    counts = np.concatenate([unsqueeze(d, n, np.uint32) for d, n in zip(table.column("counts").to_pylist(), sizes)]).astype(np.int64)
    _, at = np.unique(keys, return_inverse=True)
    others = np.bincount(at, counts).astype(np.int64)[at] - counts
    ends = np.cumsum(sizes).tolist()
    return table.select(["part", "block", "n"]).append_column("elsewhere", pa.array([squeeze(others[e - n : e]) for n, e in zip(sizes, ends)], pa.binary()))


def _known(hashes: list[np.ndarray], docs: list[np.ndarray], elsewhere: np.ndarray) -> list[np.ndarray]:
    """For each order, how often documents other than its own hold each n-gram; ``elsewhere`` is in the order of the block's sorted hashes."""
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    hashes.clear()  # as large as what follows
    known, at = np.empty(len(h), np.int64), 0
    for k in range(SLICES):  # in the order of the hashes, so that what a sort needs is a part of the block
        own = np.flatnonzero(h // np.uint64(range_width(SLICES)) == k)
        own = own[np.argsort(h[own], kind="stable")]  # equal n-grams stay in the order of their documents
        new = _begins(h[own])
        count = _lengths(new)
        mine = _lengths(new | _begins(doc[own]))
        others = elsewhere[at : at + len(count)]
        known[own] = np.repeat(count + others, count) - np.repeat(mine, mine)
        at += len(count)
    if at != len(elsewhere):
        raise ValueError(f"a block of {at} n-grams was answered for {len(elsewhere)}: its documents differ between two reads")
    return np.split(known, cuts)


def _begins(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.append(np.ones(min(1, len(values)), bool), values[1:] != values[:-1])


def _lengths(new: np.ndarray) -> np.ndarray:
    """The length of each run, given where runs begin."""
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _score(backoff: float, order: int):
    def run(key, docs, answers):
        texts = docs.column("text").to_pylist()
        doc, hashes, last = _explode(texts, order)
        answers = answers.sort_by("part")
        others = np.concatenate([unsqueeze(d, n, np.int64) for d, n in zip(answers.column("elsewhere").to_pylist(), answers.column("n").to_pylist())])
        count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        n = len(doc) + others[0]  # the n-gram of order 0 is the least
        known = _known(hashes, [doc[at] for at in last], others[1:])
        share = np.maximum(known[0], 1) / np.maximum(n - count[doc], 1)
        full = np.zeros(len(doc), bool)
        for k in range(1, order):
            c = known[k]
            context = known[k - 1][np.searchsorted(last[k - 1], last[k] - 1)]
            share[last[k]] *= backoff
            hit = c > 0
            share[last[k][hit]] = c[hit] / context[hit]
            full[last[k]] = hit
        logs = np.log(share)
        if order > 1:  # the full order's hits only
            whole = np.zeros(len(doc), bool)
            whole[last[-1]] = True
            full &= whole
        total = np.bincount(doc, logs, minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        hits = np.bincount(doc[full], minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(count, pa.int64()), "n_hits": pa.array(hits, pa.int64()), "log_score": pa.array(total, pa.float64())})

    return run


def stupid_backoff(docs: DataFrame, backoff: float = BACKOFF, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hits (words found at the full order), log_score (sum of ln S), mean_log_score (per word; 0 without words)."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    cells = dealt.groupBy("block").applyInArrow(_count(order, blocks), "part int, block int, n int, steps binary, counts binary")
    answers = cells.groupBy("part").applyInArrow(_elsewhere, "part int, block int, n int, elsewhere binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(backoff, order), "doc_id long, n_words long, n_hits long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", "n_hits", "log_score", mean.alias("mean_log_score"))


def scores(docs: DataFrame) -> DataFrame:
    """``stupid_backoff`` with scores to six places, so that the order of summation does not show."""
    return stupid_backoff(docs).select("doc_id", "n_words", "n_hits", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents
), x AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t
), g AS (
  SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT doc_id, i,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) ELSE 0 END AS c2,
    CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM g
), s AS (
  SELECT doc_id, i, c1, c2, c3, n, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), l AS (
  SELECT doc_id, c3 > 0 AS hit, ln(CASE
    WHEN c3 > 0 THEN c3 / b2::DOUBLE
    WHEN c2 > 0 THEN (CASE WHEN i >= 3 THEN {BACKOFF} ELSE 1 END) * c2 / b1::DOUBLE
    ELSE (CASE WHEN i >= 3 THEN {BACKOFF}::DOUBLE * {BACKOFF} WHEN i = 2 THEN {BACKOFF} ELSE 1 END) * greatest(c1, 1) / greatest(n, 1)::DOUBLE END) AS l
  FROM s
), d AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE hit) AS n_hits, sum(l) AS l FROM l GROUP BY doc_id
)
SELECT t.doc_id, coalesce(d.n_words, 0)::BIGINT AS n_words, coalesce(d.n_hits, 0)::BIGINT AS n_hits,
  round(coalesce(d.l, 0), 6) AS log_score, round(coalesce(d.l / d.n_words, 0), 6) AS mean_log_score
FROM t LEFT JOIN d ON d.doc_id = t.doc_id
"""
