import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from bidloom.llm import lm_score
from data import DOCS, docs
from pyspark.sql import functions as F

TEXTS = [None, "", "...", "a b a b c", "A B, a b; c d", "x", "x y z", "é ü é ü", "a b a b c", "b a b", "w " * 3000, "w w w"]


def brute(texts, order=3):
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    grams = [[tuple(ws[i - k + 1 : i + 1]) for ws in [ws] for k in range(1, order + 1) for i in range(k - 1, len(ws))] for ws in words]
    all_of = Counter(g for gs in grams for g in gs)
    n = sum(map(len, words))
    out = []
    for ws, gs in zip(words, grams):
        own = Counter(gs)

        def c(g):
            return all_of[g] - own[g]

        total, hits = 0.0, 0
        for i, w in enumerate(ws):
            k, factor = min(i, order - 1), 1.0
            while k and not c(tuple(ws[i - k : i + 1])):
                k, factor = k - 1, factor * lm_score.BACKOFF
            hits += k == order - 1 and order > 1
            total += math.log(factor * (c(tuple(ws[i - k : i + 1])) / c(tuple(ws[i - k : i])) if k else max(c((w,)), 1) / max(n - len(ws), 1)))
        out.append((len(ws), hits, total))
    return out


def test_scores_equal_brute_force_for_any_blocks_and_orders(spark):
    frame = docs(spark, TEXTS).repartition(3).withColumn("block", F.lit(1)).withColumn("h", F.lit("x"))
    for size, order in ((1 << 20, 3), (64, 3), (64, 2)):
        got = sorted(lm_score.stupid_backoff(frame, block_bytes=size, order=order).collect())
        assert len(got) == len(TEXTS)
        for row, (n, hits, total) in zip(got, brute(TEXTS, order)):
            assert (row.n_words, row.n_hits) == (n, hits) and math.isclose(row.log_score, total, rel_tol=1e-9, abs_tol=1e-9), (row, n, hits, total)


def test_rows_that_repeat_are_documents_of_their_own(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(None, "a b x", "en", "s", 5)] * 2
    got = sorted((r.n_words, r.n_hits) for r in lm_score.stupid_backoff(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(3, 1), (3, 1), (4, 2), (4, 2), (4, 2)]


def test_empty_table(spark):
    assert lm_score.stupid_backoff(spark.createDataFrame([], DOCS)).count() == 0


def test_ngrams_travel_packed_and_are_answered_in_place():
    rng = np.random.default_rng(1)
    texts = [[" ".join(f"w{x}" for x in rng.integers(0, 3000, 2000)) for _ in range(20)] for _ in range(3)] + [["", ""]]
    cells = [lm_score._count(3, 4)((pa.scalar(b),), pa.table({"text": t})) for b, t in enumerate(texts)]
    n = sum(sum(c.column("n").to_pylist()) for c in cells)
    assert n > 200_000 and sum(c.column(k).nbytes for c in cells for k in ("steps", "counts")) < 7 * n
    table = pa.concat_tables(cells)
    answers = pa.concat_tables([lm_score._elsewhere(None, table.filter(pc.equal(table.column("part"), p))) for p in range(4)])
    assert answers.column("elsewhere").nbytes < n / 2
    assert answers.select(["part", "block", "n"]).sort_by([("block", "ascending"), ("part", "ascending")]) == table.select(["part", "block", "n"])


def test_a_block_that_is_not_the_one_counted_is_refused():
    with pytest.raises(ValueError):
        lm_score._known([np.array([5, 9], np.uint64)], [np.array([0, 1])], np.zeros(3, np.int64))
