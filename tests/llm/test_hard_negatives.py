import math

import numpy as np
import pytest
from bidloom.llm import hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"
ANCHOR = "vec_id % 10 = 0"


def brute(rows, anchor=lambda i: i % 10 == 0, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows if lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    good = [(i, q, lab) for i, q, lab in good if max(map(abs, q)) < 1 << 24]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, qa, la) in enumerate(good):
        if a is None or not anchor(a):
            continue
        met = [(-sum(x * y for x, y in zip(qa, q)), last(i), i, lab) for m, (i, q, lab) in enumerate(good) if m != n and len(q) == len(qa)]
        for s, _, p, _ in sorted(x for x in met if x[3] == la)[:k]:
            fit = sorted(x for x in met if x[3] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, _, i, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(frame, **more):
    return sorted((tuple(r) for r in hard_negatives.mine(frame, ANCHOR, **more).collect()), key=str)


def data(n=400, d=8, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, d))
    return [(i, (centres[i % 6] + draw.standard_normal(d) * 0.4).astype(np.float32).tolist(), int(draw.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("more", [{}, {"row_block": 150, "anchor_block": 20}])
def test_equals_brute_force(spark, more):
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "id": F.lit(None).cast("int"), "q": F.lit(0)})
    want = brute(rows)
    assert len(want) > 500 and mined(frame, **more) == want


def test_ties_are_settled_by_id(spark):
    """Hundreds of copies at the kth score, with ids that need several digits, negative and large ones too."""
    a, b = [0.5, 0.5, 0.1], [0.5, 0.45, 0.1]
    ids = [-(2**62), -5, 10, *range(10**6, 10**6 + 150), *range(2**61, 2**61 + 150)]
    rows = [(0, a, 1), (11, a, 1), (20, a, 1), *((i, b, 2) for i in ids[::-1])]
    got = mined(spark.createDataFrame(rows, SCHEMA), row_block=200)
    assert got == brute(rows)
    assert [r[3] for r in got if r[:2] == (0, 11)] == sorted(ids)[:5]


def test_awkward_rows(spark):
    rows = data(60)
    v = rows[3][1]
    rows += [(100, None, 1), (101, [], 1), (110, [None, *v[1:]], 1), (120, [float("nan"), *v[1:]], 1), (130, [float("inf"), *v[1:]], 1), (140, v, None), (150, [x * 1e30 for x in v], 1)]
    rows += [(160, v[:3], 1), (161, v[:3], 1), (162, v[:3], 2), (170, [0.0] * 8, 1), (None, v, 1), (None, v, 1), (None, v, 2), (180, v, 1), (180, v, 1), (180, v, 2), (180, v, 2), (190, [-x for x in v], 3)]
    rows += [(200, [x * 9e3 for x in v], 1), (201, [x * 8e3 for x in v], 1), (202, [x * 8.1e3 for x in v], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_fewer_rows_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]
    assert mined(spark.createDataFrame(rows[:2], SCHEMA)) == mined(spark.createDataFrame(rows[1:], SCHEMA)) == mined(spark.createDataFrame([], SCHEMA)) == []
