import random

from bidloom.llm import ngram_join
from data import DOCS, docs


def texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(draw.choices(words, k=80)) for _ in range(12)]
    out = [None, "", "!!!", "one two", "One  two.", "one two three"]
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 6):
            w = b.split()
            for _ in range(edits):
                w[draw.randrange(len(w))] = draw.choice(words)
            out.append(" ".join(w))
    shared = " ".join(draw.choices(words, k=60))
    return out + [shared + " " + " ".join(draw.choices(words, k=60)) for _ in range(30)] + [base[0]] * 5 + [" ".join(draw.choices(words, k=5000))] * 2


def brute(ts):
    shingler = ngram_join.Shingler(5)
    sets = [set(shingler.grams(t or "").tolist()) for t in ts]
    links = {i: {j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9} for i, a in enumerate(sets)}
    out = {}
    for i in links:
        todo = [i] if i not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return {i: (len(links[i]), out[i]) for i in links}


def test_links_and_classes_equal_brute_force(spark):
    want = brute(texts())
    assert sum(n for n, _ in want.values()) > 100
    for blocks in ({}, {"bucket_block": 4, "group_block": 4}):
        got = ngram_join.near_duplicates(docs(spark, texts()).repartition(3), **blocks).collect()
        assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want


def test_one_document_of_each_group_stays(spark):
    want = brute(texts())
    kept = {r.doc_id for r in ngram_join.deduplicated(docs(spark, texts())).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_repeated_rows_empty_table_and_recall(spark):
    rows = [(7, "a b c d e f", "en", "s", 11)] * 3 + [(None, "other words here", "en", "s", 1)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == [(-1, 0), (7, 2), (7, 2), (7, 2)]
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    b = ngram_join.bands_for()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL


def test_every_row_is_a_document_of_its_own(spark):
    base = [f"w{i}" for i in range(60)]
    t, near, other = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))

    def links(rows):
        got = ngram_join.near_duplicates(spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS)).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, -1 if r.class_id is None else r.class_id) for r in got)

    def kept(rows):
        got = ngram_join.deduplicated(spark.createDataFrame([(i, x, "en", "s", k) for k, (i, x) in enumerate(rows)], DOCS)).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got)

    assert links([(1, t), (1, t), (2, near)]) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert links([(1, t), (1, near)]) == [(1, 1, 1), (1, 1, 1)]
    assert links([(None, t), (None, near), (3, t)]) == [(-1, 2, 3), (-1, 2, 3), (3, 2, 3)]
    assert links([(None, t), (None, near), (2**60 + 1, other)]) == [(-1, 1, -1), (-1, 1, -1), (2**60 + 1, 0, 2**60 + 1)]
    assert kept([(1, t), (1, other)]) == sorted([(1, t), (1, other)])
    assert [i for i, _ in kept([(5, t), (None, near), (None, "!"), (None, "!"), (4, None)])] == [-1, -1, 4, 5]
    assert [(i, x) for i, x in kept([(None, t), (None, near)])] in ([(-1, t)], [(-1, near)])


def test_recall_of_near_copies_against_all_pairs(spark):
    """Pairs from 0.8 to 0.9, where bands and sketches may lose one, against all pairs."""
    draw = random.Random(5)
    ts = []
    for _ in range(150):
        w = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        ts.append(" ".join(w))
        for edits in (1, 2):
            v = list(w)
            for i in draw.sample(range(10, 110, 12), edits):
                v[i] = "changed"
            ts.append(" ".join(v))
    want = brute(ts)
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs(spark, ts)).collect()}
    assert sum(got.values()) >= 0.999 * sum(n for n, _ in want.values()) > 0
