import numpy as np
from bidloom.llm import embedding_lsh

SCHEMA = "vec_id long, embedding array<float>, label int"


def data():
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((12, 24))
    rows = []
    for i in range(300):
        v = centres[i % 12] + draw.standard_normal(24) * draw.choice([0.02, 0.1, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(40)] + [(500, [x * 1e30 for x in rows[5][1]], rows[5][2])]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 24, 1), (603, [float("nan")] * 24, 1), (604, [None] * 24, 1), (605, rows[5][1], None), (606, rows[5][1][:20], rows[5][2]), (607, [float("inf")] * 24, 1)]
    return rows


def brute(rows):
    good = [(i, np.array(e, np.float64), lab) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links = {i: set() for i, _, _ in rows}
    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j), links[j].add(i)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return {i: (len(links[i]), out[i]) for i in links}


def test_links_and_components_equal_brute_force(spark):
    want = brute(data())
    assert sum(n for n, _ in want.values()) > 1000
    for block in (2048, 16):  # 16: hot buckets are dealt out as pairs of blocks
        got = embedding_lsh.near_duplicates(spark.createDataFrame(data(), SCHEMA), block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_rows_empty_table_and_recall(spark):
    got = embedding_lsh.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, -1.0], 0)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert embedding_lsh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    meet = embedding_lsh.agreement(0.2) ** embedding_lsh.PROJECTIONS
    assert 1 - (1 - meet) ** embedding_lsh.tables_for(0.98, 0.9999) >= 0.9999


def test_every_row_is_a_vector_of_its_own(spark):
    a, b, c = [1.0, 2.0, 0.5], [1.0, 2.0, 0.51], [-3.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (1, c, 0), (None, a, 0), (None, b, 1), (None, b, 1), (2**60 + 1, c, 0), (2**60, c, 1)]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA + ", sig int, copies int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embedding_lsh.near_duplicates(frame).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (-1, 2, 1, False), (-1, 1, -1, True), (-1, 1, -1, True), (2**60 + 1, 1, 1, False), (2**60, 0, 2**60, True)])
