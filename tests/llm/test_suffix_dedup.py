import hashlib
import random

from bidloom.llm import suffix_dedup as sd
from data import DOCS, docs


def brute(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if covered[j] and (j == 0 or not covered[j - 1]))
        out[i] = (len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    return out


def texts():
    draw = random.Random(5)
    prose = lambda k: "".join(draw.choices("abcdeé \n", k=k))
    a, b = prose(900), prose(400)
    out = [None, "", "short", a, prose(300) + a[100:350] + prose(50), b + b, a, "x" * 700, "ab" * 300, prose(99), b[:99], b[1:101], a[:100]]
    for _ in range(25):
        t = list(a)
        for _ in range(3):
            t[draw.randrange(len(t))] = "#"
        out.append("".join(t))
    return out + [prose(3000) + a + prose(3000)]


def test_removed_bytes_equal_brute_force(spark):
    ts = texts()
    want = brute(list(enumerate(ts)))
    for settings in ({}, {"block_bytes": 3000}, {"block_bytes": 5000, "hot": 3}):
        got = sd.remove_repeats(docs(spark, ts).repartition(3), **settings).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want, settings
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 128)
    text = "".join(random.Random(1).choices("abcdefgh", k=2000)).encode()
    places = {(int(p), int(s)) for a, b, e, _ in sd.anchors(text) for p, x, y in zip(a, b, e) for s in range(x, y + 1)}
    monkeypatch.setattr(sd, "CHUNK", 1 << 20)
    assert places == {(int(p), int(s)) for a, b, e, _ in sd.anchors(text) for p, x, y in zip(a, b, e) for s in range(x, y + 1)}


def test_loser_tree_merges_in_order_with_prefix_lengths():
    draw = random.Random(2)
    runs = []
    for _ in range(7):
        own = sorted(bytes(draw.choices(b"ab", k=draw.randrange(1, 12))) for _ in range(draw.randrange(0, 30)))
        runs.append(([sd._common(x, y, 0) for x, y in zip([b"", *own], own)], own))
    merged = [(same, runs[r][1][i]) for same, r, i in sd.LoserTree(runs)]
    assert [s for _, s in merged] == sorted(s for _, own in runs for s in own)
    assert all(same == sd._common(a, b, 0) for (_, a), (same, b) in zip(merged, merged[1:]))


def test_repeated_rows_and_empty_table(spark):
    row = (1, "q" + "".join(random.Random(9).choices("abcdef", k=300)), "en", "s", 301)
    got = sorted(r.n_removed for r in sd.remove_repeats(spark.createDataFrame([row, row, (None, None, None, None, None)], DOCS)).collect())
    assert got == [0, 0, 301]
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
