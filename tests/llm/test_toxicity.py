import random
import re
import time
from collections import Counter

import numpy as np
from bidloom.llm import toxicity
from data import DOCS, docs
from pyspark.sql import functions as F


def corpus():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklm", k=draw.randrange(3, 8))) for _ in range(600)]
    bad = ["zorgling", "vexxor", "quimplest"]
    out = []
    for i in range(500):
        t = draw.choices(words, k=60)
        if i % 5 == 0:
            for _ in range(4):
                t.insert(draw.randrange(len(t)), draw.choice(bad))
        out.append((" ".join(t), int(i % 5 == 0)))
    return out


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(9999, None), (0, None)], "doc_id long, toxic int")
    texts = [t for t, _ in rows] + [None, "", "you zorglin9 and qu1mplest vexxxor", "plain words"]
    got = {r.doc_id: r for r in toxicity.classify(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert 50 < len(held) < 150
    assert np.mean([got[i].predicted == rows[i][1] for i in held]) > 0.95
    assert got[500].predicted == got[501].predicted == got[503].predicted == 0 and got[502].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_quotation_weighs_less_than_abuse():
    matcher = toxicity.Matcher([("zorgling", "word")])
    quoted, addressed = matcher.features('they said the word "zorgling" is rude'), matcher.features("you zorgling")
    assert quoted[1] > 0 and quoted[2] == 0 and addressed[2] > 0 and addressed[1] == 0


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs(spark, ["a", None]), none).collect()} == {0.0}
    assert toxicity.classify(spark.createDataFrame([], DOCS), none).count() == 0


def test_copies_neither_add_evidence_nor_cancel_it(spark):
    draw = random.Random(6)
    rows = corpus()
    hot = next(t for t, y in rows if y)
    near = hot.split()
    copies = [(hot, 1)] * 400
    for i in range(300):
        w = list(near)
        w[draw.randrange(len(w))] = f"odd{i}"
        copies.append((" ".join(w), 1))
    once = {t for t, _ in toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))}
    assert {"zorgling", "vexxor", "quimplest"} <= once
    assert {"zorgling", "vexxor", "quimplest"} <= {t for t, _ in toxicity.lexicon(spark.createDataFrame(rows + copies, "text string, toxic int"))}
    # A word that only the copies have is no evidence, however often they repeat it.
    alone = [(f"{hot} glarbwick", 1)] * 500
    assert "glarbwick" not in {t for t, _ in toxicity.lexicon(spark.createDataFrame(rows + alone, "text string, toxic int"))}
    assert toxicity.originals(spark.createDataFrame(rows + copies, "text string, toxic int")).count() <= len(rows) + 15


def test_near_equals_edit_distance_with_swaps():
    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    draw = random.Random(9)
    terms = ["".join(draw.choices("abc", k=draw.randrange(4, 12))) for _ in range(80)]
    trie = toxicity.Trie([(t, "word") for t in terms])
    for _ in range(600):
        w = "".join(draw.choices("abcd", k=draw.randrange(1, 14)))
        assert trie.near(w) == {t for t in terms if len(t) >= 5 and distance(w, t) <= 1 + (len(t) >= 9)}, w


def test_misspelt_terms_are_found():
    matcher = toxicity.Matcher([(t, "word") for t in ("idiot", "moron", "worthless", "stupid", "clown")])
    for w in ("odiot", "diot", "xmoron", "wrthles", "idoit", "stuipd", "clwon", "orthless", "diiot"):
        assert matcher[w] == "fuzzy", w
    assert matcher["idiot"] == "exact" and matcher["table"] is None and matcher["riot"] is None


def test_no_filter_before_the_walk_loses_a_term():
    draw = random.Random(10)
    alphabet = "abcdefghijklmnopqrst"
    terms = ["".join(draw.choices(alphabet, k=draw.randrange(5, 13))) for _ in range(60)]
    trie = toxicity.Trie([(t, "word") for t in terms])
    for _ in range(6000):
        term = draw.choice(terms)
        first = 0
        w = term
        for _ in range(2 if len(term) >= 9 else 1):
            # Left to right, so that no edit changes what an earlier one made.
            i = draw.randrange(first, len(w) - 1) if first < len(w) - 1 else first
            kind = draw.randrange(4)
            if i >= len(w) - 1:
                break
            w = (w[:i] + w[i + 1 :], w[:i] + draw.choice(alphabet) + w[i:], w[:i] + draw.choice(alphabet) + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[kind]
            first = i + (0, 1, 1, 2)[kind]
        assert term in trie.near(w), (term, w)


def brute_features(text, terms):
    """The model's inputs by comparing every word with every term."""

    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    words, stems = [t for t, k in terms if k != "stem"], [t for t, k in terms if k == "stem"]
    near = [t for t, k in terms if k == "word" and len(t) >= 5]
    spans = list(toxicity._WORD.finditer(text.lower()))
    tokens = [m.group() for m in spans]
    hits = quoted = addressed = 0
    for i, w in enumerate(tokens):
        folded = re.sub(r"(.)\1{2,}", r"\1", w.translate(toxicity.FOLD))
        whole = w in words or any(w.startswith(x) for x in stems)
        if not whole and not folded in words and not (len(folded) >= 4 and any(distance(folded, t) <= 1 + (len(t) >= 9) for t in near)):
            continue
        hits += 1 if whole else toxicity.FUZZY
        around = tokens[max(0, i - toxicity.WINDOW) : i] + tokens[i + 1 : i + 1 + toxicity.WINDOW // 2]
        s, e = spans[i].span()
        if text[s - 1 : s] in toxicity._QUOTES and s or text[e : e + 1] in toxicity._QUOTES and e < len(text) or any(x in toxicity.QUOTING for x in around):
            quoted += 1
        elif any(x in toxicity.ADDRESS for x in around):
            addressed += 1
    return np.log1p([hits, quoted, addressed])


def test_scores_equal_every_word_against_every_term(spark):
    rows = corpus()
    texts = [t for t, _ in rows[:150]] + [None, "", 'you zorglin9! "vexxor" he said, quimplsts zorglin', "xzorgling vexor quimplestt 5", "zorgling " * 3000]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows[:150])], "doc_id long, toxic int")
    frame = docs(spark, texts)
    model = toxicity.train(frame, labels)
    want = []
    for t in texts:
        x = brute_features(t or "", model.terms)
        want.append(1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1]))))
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert model.terms and np.allclose([got[i] for i in range(len(texts))], want)


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int").withColumn("text", F.lit("zorgling"))
    some = [(i, t, "en", "s", 1, 0.5, 1) for i, (t, _) in enumerate(rows)] + [(None, "you zorgling vexxor", "en", "s", 1, 0.5, 1)] + [(7, "plain", "en", "s", 1, 0.5, 1)] * 2
    frame = spark.createDataFrame(some, DOCS + ", score double, toxic int")
    got = toxicity.classify(frame, labels).collect()
    assert len(got) == len(some) and {r.held_out for r in got if r.doc_id is None} == {False} and all(r.predicted for r in got if r.doc_id is None)
    assert sum(r.doc_id == 7 for r in got) == 3
    kept = toxicity.clean(frame, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.filter("doc_id is null").count() == 0 and kept.filter("doc_id = 7 and text = 'plain'").count() == 2


PLAIN_WORD = re.compile(r"[^\W\d_](?:[\w@$!]*[^\W_])?|[\w@$]*[^\W\d_][\w@$]*[^\W_]")


def test_tokens_are_those_of_the_plain_pattern_and_cost_linear_time():
    draw = random.Random(8)
    for _ in range(4000):
        text = "".join(draw.choices("ab1_@$! ²é.", k=draw.randrange(0, 14)))
        assert toxicity.tokens_of(text) == PLAIN_WORD.findall(text) == [m[0] for m in toxicity.words(text)], text
    began = time.perf_counter()
    for sign in "7_$@!":
        assert toxicity.tokens_of(sign * 1_000_000) == []
        assert toxicity.tokens_of("a" + sign * 1_000_000 + " b") == (["a" + sign * 1_000_000, "b"] if sign == "7" else ["a", "b"])
    assert toxicity.tokens_of("1_" * 300_000 + "x") == ["x"]
    assert time.perf_counter() - began < 20


def test_long_terms_are_found_in_bounded_time():
    draw = random.Random(9)
    terms = ["".join(draw.choices("abcd", k=n)) for n in (24, 25, 26, 40, 400, 5000)]
    began = time.perf_counter()
    trie = toxicity.Trie([(t, "word") for t in terms])
    for t in terms:
        for _ in range(6):
            w = list(t)
            for _ in range(draw.randrange(0, 3)):
                i = draw.randrange(len(w) - 1)
                how = draw.randrange(4)
                if how == 0:
                    del w[i]
                elif how == 1:
                    w.insert(i, "z")
                elif how == 2:
                    w[i] = "y"
                else:
                    w[i : i + 2] = w[i + 1], w[i]
            assert t in trie.near("".join(w))
        w = t[:2] + "xyz" + t[2:]
        assert t not in trie.near(w)
    assert time.perf_counter() - began < 20


def test_long_texts_and_terms_in_a_job(spark):
    scream = "argh" * 1500
    rows = [(f"{scream} zorg{i} you{i} {i}", 1) for i in range(40)] + [(f"calm{i} and plain{i} words", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    texts = [t for t, _ in rows] + ["9" * 1_000_000, "_" * 1_000_000, "$" * 1_000_000, "x" * 1_000_000, scream[:-1] + " here"]
    got = {r.doc_id: r.score for r in toxicity.classify(docs(spark, texts), labels).collect()}
    assert max(got[240 + i] for i in range(4)) < 0.1 and got[244] > 0.3  # one misspelt hit, and none


def test_missed_rows_hold_no_telling_word(spark):
    """Of the toxic rows that are not learned from, those missed hold no word that toxic rows share and clean ones lack."""
    folder = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    told = {r.doc_id: r for r in toxicity.classify(table, labels).collect()}
    rows = [(r.doc_id, set(toxicity.tokens_of((r.text or "").lower())), r.toxic) for r in table.join(labels, "doc_id").collect()]
    bad, good = (Counter(w for _, ws, y in rows if y == kind for w in ws) for kind in (1, 0))
    telling = {w for w, n in bad.items() if n >= 5 and good[w] <= 0.02 * n}
    held = [(i, ws) for i, ws, y in rows if y == 1 and told[i].held_out]
    missed = [ws for i, ws in held if not told[i].predicted]
    assert len(missed) < len(held) and not any(ws & telling for ws in missed)
    assert sum(told[i].predicted for i, _, y in rows if y == 0) <= 1
