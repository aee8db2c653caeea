import hashlib
import re

import numpy as np
import pytest
from bidloom.llm import fill_in_middle as fim
from data import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TEXTS = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc", "ü\nß€\n😀😀\nend", "has <P> in it\nx", "<S", "x <M>\ny", "a<\nP>\n<", "\r\n\r\x0b\n ", "x\n" * 5000 + "last" * 30000, "same\ntwice", "same\ntwice"]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    spm = h4 % 100 < 50
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_examples_equal_brute_force_and_restore(spark):
    frame = docs(spark, TEXTS * 8).union(spark.createDataFrame([(None, "no\nid\nhere", "en", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = frame.select("doc_id", "text").collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1, *brute(r.doc_id, r.text)) for r in rows), key=str)
    clash = frame.withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2.5)})
    made = fim.transform(clash)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in rows)


def test_small_yields_give_the_same_rows(spark, monkeypatch):
    want = sorted(map(str, fim.digests(docs(spark, TEXTS)).collect()))
    batches = [b for b in docs(spark, TEXTS).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()]
    monkeypatch.setattr(fim, "YIELD_BYTES", 5)
    parts = list(fim._arranged(7, 100, 50)(iter(batches)))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == len(TEXTS)
    digests = sorted(hashlib.sha256(o.encode()).hexdigest() for p in parts for o in p.column("output").to_pylist())
    assert digests == sorted(re.search(r"output_sha256='(\w+)'", w)[1] for w in want)


def test_rates(spark):
    frame = docs(spark, [f"a{i}\nb\nc" for i in range(400)])
    forms = {r.form: r["count"] for r in fim.transform(frame, rate=50, spm_rate=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260


def test_empty_table(spark):
    assert fim.digests(docs(spark, [])).count() == 0


@given(st.lists(st.booleans(), max_size=700), st.data())
@settings(max_examples=150, deadline=None)
def test_rank_and_select(marks, data):
    marks = np.array(marks, bool)
    bits = fim.Bits(marks)
    at = np.array(data.draw(st.lists(st.integers(0, len(marks)), min_size=1, max_size=9)))
    assert bits.rank(at).tolist() == [int(marks[:i].sum()) for i in at]
    places = np.flatnonzero(marks)
    assert bits.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n\nb", "é\n" * 100])
def test_lines_are_popcounts(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    assert fim.line_ends(raw, np.array([0, len(raw)])).sum() == len(re.findall(r"[^\n]*\n|[^\n]+", text))
