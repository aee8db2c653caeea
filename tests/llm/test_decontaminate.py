import random

from pyspark.sql import functions as F

from bidloom.llm import decontaminate as d
from data import DOCS, docs

ITEMS = [
    (1, "If Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have left after that day?"),
    (2, "the quick brown fox jumps over the lazy dog while seven cats watch from the tall old tree nearby"),
    (3, "tiny item here"),
    (4, ""),
    (5, None),
]
TEXTS = [
    "Some intro. If Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have left after that day? More.",
    "Yes. If Carol has 40 apples and gives 8 apples to Dan, how many apples does Carol have left after that day?",
    "No. If Carol has 40 apples and gives 8 apples to Dan, how many apples does Erin have left after that day?",
    "entirely different words without any of the benchmark in them at all, which is how most documents are",
    "x THE quick brown fox jumps over the lazy dog while 7 cats watch from the tall old tree nearby y",
    "a tiny item here",
    "",
    None,
    "the quick brown fox jumps over " + "filler " * 5000,
    "the### quick%%% brown$$$ fox&&& jumps%%% over*** the%%% lazy$$$ dog### while%%% seven$$$ cats%%% watch### from%%% the%%% tall%%% old### tree%%% nearby***",
]


def test_exact_and_reparameterised_items_are_caught(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in d.contaminated(docs(spark, TEXTS), items).collect()}
    assert {(0, 1), (1, 1), (4, 2), (5, 3)} <= set(got), got
    assert got[0, 1] == 0 and got[1, 1] > 0
    assert (9, 2) in got and {i for i, _ in got} <= {0, 1, 2, 4, 5, 9}


def brute(texts, items):
    """(text index, item index) -> (covered, words, changed) by comparing every window with every window."""
    out = {}
    for i, text in enumerate(texts):
        slots, values = d.template(text or "")
        for j, item in enumerate(items):
            own, names = d.template(item or "")
            size = min(d.WINDOW, len(own))
            met = []
            for q in range(len(slots) - size + 1 if size else 0):
                for p in range(len(own) - size + 1):
                    if slots[q : q + size] == own[p : p + size]:
                        at = [k for k in range(p, p + size) if own[k] in (d.NUMBER, d.NAME, d.UNIT)]
                        met.append((q - p, p, size, at, [own[k] for k in at], [names[k] for k in at], [values[k + q - p] for k in at]))
            covered, changed = d.cover(met)
            if met and covered >= d.MIN_COVER * len(own):
                out[i, j] = (covered, len(own), changed)
    return out


def test_query_equals_every_window_against_every_window(spark):
    draw = random.Random(1)
    more = []
    for _ in range(60):
        a, b, c = draw.choice(["Alice", "Carol", "Bob"]), draw.choice([12, 7, 5]), draw.choice([5, 12, 9])
        more.append(f"Say. If {a} has {b} apples and gives {c} apples to Bob, how many apples does {draw.choice(['Alice', a])} have left after that day?")
        more.append(" ".join(draw.choices("the quick brown fox jumps over lazy dog 7 5 km Berlin".split(), k=draw.randrange(40))))
    texts, items = TEXTS + more, [t for _, t in ITEMS] + ["the quick brown 7 km the fox 5 km over", "7"]
    got = d.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.covered_words, r.item_words, r.changed_slots) for r in got} == brute(texts, items)
    assert len(got) == len(brute(texts, items)) > 50


def test_rows_that_repeat_ids_are_their_own_documents(spark):
    items = spark.createDataFrame([*ITEMS, ITEMS[1]], "item_id long, text string")
    rows = [(1, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[4]), (1, TEXTS[3]), (None, TEXTS[4]), (None, TEXTS[3]), (None, TEXTS[3])]
    frame = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS).withColumn("h", F.lit(1)).withColumn("item_id", F.lit(9))
    got = sorted((r.doc_id or -1, r.item_id) for r in d.contaminated(frame, items).collect())
    assert got == [(-1, 2), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert sorted((r.doc_id or -1, r.n_chars) for r in d.decontaminated(frame, items).collect()) == [(-1, 5), (-1, 6), (1, 3)]


def test_arrays_equal_the_loop():
    words, vocabulary = d.WordHashes(), d.Vocabulary()
    texts = [t or "" for t in TEXTS] + ["Dr. Who paid 5 km. Km 7% and Km. 3 Km\nNew York", "5. kg 5 kg Kg", "word%%% five %%% km $ $5 5$ % $", "%", "$\n5 % 7"]
    h, doc = vocabulary.templates(texts)
    for k, t in enumerate(texts):
        assert (h[doc == k] if len(t) else h[:0]).tolist() == [words[s] if s in words else words[s] for s in d.template(t)[0]]


def test_slots_must_map_one_to_one():
    assert not d.conflicts({0: ("<num>", "1", "2"), 1: ("<num>", "3", "4"), 2: ("<num>", "1", "2")})
    assert d.conflicts({0: ("<num>", "1", "2"), 1: ("<num>", "1", "3"), 2: ("<num>", "1", "3")}) == {0}
    assert d.conflicts({0: ("<num>", "1", "2"), 1: ("<num>", "3", "2")}) == {1}


def test_one_changed_slot_does_not_hide_a_copy(spark):
    item = "In Berlin 12 trains leave at 5 and in Hamburg 12 ships leave at 9 with 12 guests from Berlin on board every single day"
    texts = [item.replace("12 guests", "13 guests"), item.replace("at 5", "at 4").replace("at 9", "at 4")]
    got = d.contaminated(docs(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1}


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminated(spark.createDataFrame([], DOCS), items).count() == 0
    assert d.contaminated(docs(spark, TEXTS), items.limit(0)).count() == 0
    kept = {r.doc_id for r in d.decontaminated(docs(spark, TEXTS), items).collect()}
    assert {3, 6, 7, 8} <= kept and not kept & {0, 1, 4, 5, 9}
