import re
from collections import Counter

from bidloom.llm import quality_rules
from data import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CLEAN = " ".join(f"word{i} goes on" if i % 3 else f"line{i} ends.\n" for i in range(60))
TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "a b c d a b c", "x y z " * 40, "\n\n same\nother\n same\n\x0b\n", "a b c\x0bd\re\x0cf", "😀 ß # $$ %&|<>*", "#" * 3000, "w" * 100_000, "p q r s " * 20_000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_equal_brute_force(spark):
    frame = docs(spark, TEXTS * 2).withColumns({"lk": F.lit(1), "n": F.lit("x"), "copies": F.lit(0.5), "level": F.lit(0)})
    rows = quality_rules.judge(frame).collect()
    assert len(rows) == 2 * len(TEXTS)
    assert {r.doc_id: counts(r) for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS * 2)}
    assert not any(r.kept and r.base_failed for r in rows)


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_repeated_words(spark, texts):
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i int, w array<string>")
    got = {r.i: r.n for r in frame.select("i", quality_rules.repeated_words(F.col("w")).alias("n")).collect()}
    assert got == {i: brute(" ".join(w))[4] for i, w in enumerate(texts)}


def test_sketch_cells_keep_order_and_value(spark):
    values = [*range(300), 1000, 12345, 10**6, 10**9 + 7, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.cell(F.col("v")).alias("c")).withColumn("low", quality_rules.low_edge(F.col("c"))).collect()
    assert all(r.low <= r.v <= r.low * (1 + 1 / 64) for r in rows)
    assert [r.c for r in rows] == sorted(r.c for r in rows) and len({r.c for r in rows if r.v < 128}) == 128


def test_sketches_merge(spark):
    """Sketches of parts add up to those of the whole, and quartiles are those of the sorted values."""
    frame = quality_rules.measured(docs(spark, [" ".join(f"{'ab' * (1 + (i * k) % 7)}{k}" for k in range(60 + i)) for i in range(90)]))
    whole = quality_rules.sketches(frame)
    parts = quality_rules.sketches(frame.filter("doc_id < 40")).union(quality_rules.sketches(frame.filter("doc_id >= 40")))
    assert sorted(quality_rules.quartiles(whole, ["lk"]).collect()) == sorted(quality_rules.quartiles(parts, ["lk"]).collect())
    values = sorted(r.v for r in frame.filter("lk = '=en' and not base_failed").selectExpr("1000 * word_chars div n_words as v").collect())
    got = quality_rules.quartiles(whole, ["lk"]).filter("lk = '=en'").first()
    for k in (1, 2, 3):
        exact = values[-(-k * len(values) // 4) - 1]
        assert got[f"word_length_q{k}"] <= exact <= got[f"word_length_q{k}"] * (1 + 1 / 64)


def test_thresholds_follow_the_source(spark):
    """Symbols that are usual in one source are junk in another; small sources follow what most documents of their language do."""
    plain, marked = CLEAN, re.sub(r"(word\d+)", r"<b>\1</b>##", CLEAN)
    rows = [(i, plain, "en", "news", 0) for i in range(400)] + [(1000 + i, marked, "en", "code", 0) for i in range(150)]
    rows += [(2000, marked, "en", "news", 0), (2001, plain, "en", "tiny", 0), (2002, marked.replace("#", "#####"), "en", "code", 0), (2003, marked, None, None, 0)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i].kept for i in range(400)) and all(got[1000 + i].kept for i in range(150))
    assert "symbols" in got[2000].failed and "symbols" in got[2002].failed and not got[2000].kept
    assert got[2001].kept and got[2001].level == "language" and got[2003].level == "corpus" and got[0].level == "source"


def test_clean_keeps_columns_and_rows(spark):
    frame = spark.createDataFrame([(1, CLEAN, "en", "s", 1), (1, CLEAN, "en", "s", 1), (1, "short", "en", "s", 1), (None, CLEAN, None, "s", 2), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = quality_rules.clean(frame)
    assert got.columns == frame.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "None"]


def test_empty_table(spark):
    assert quality_rules.judge(docs(spark, [])).count() == 0 and quality_rules.clean(docs(spark, [])).count() == 0
