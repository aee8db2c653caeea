import hashlib

import pytest
from bidloom.llm import chat_format
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "<<SYS>>a<</SYS>>", "<|im_start|>x\n<|im_end|>\n<|im_start|>", "[[INST]]", "", None, "ünï \U0001F600\n\n", "\\", "<", "x" * 5000]


def rows():
    out = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(ODD)]
    out += [(2, 0, "user\nrole\\n", "hi"), (2, 1, None, "no role"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (3, None, "assistant", "no turn"), (None, 0, "user", "no id")]
    return out + [(4, k, "assistant" if k % 3 == 1 else "user", f"t{k} </s>") for k in range(2500)]


def wanted(turns):
    ordered = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ordered)
    loss = "".join(t or "" for _, _, r, t in ordered if r == "assistant")
    return len(ordered), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_equals_brute_force(spark):
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(rows(), TURNS).repartition(3)).collect()}
    ids = {r[0] for r in rows()}
    assert set(got) == ids
    for i in ids:
        r = got[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == wanted([x for x in rows() if x[0] == i]), i


def test_examples_have_all_preceding_turns_as_context(spark):
    df = spark.createDataFrame(rows(), TURNS)
    formatted = chat_format.segments(df)
    whole = {r.conv_id: r.formatted for r in chat_format.renderings(formatted).collect()}
    examples = chat_format.with_prompts(formatted).filter("conv_id = 4").collect()
    assert len(examples) == sum(r[0] == 4 and r[2] == "assistant" for r in rows())
    for e in examples:
        assert whole[4].startswith(e.prompt + e.target + "<|im_end|>")
        assert e.prompt.count("<|im_start|>") == e.turn_index + 1


def test_empty_table_and_extra_columns(spark):
    assert chat_format.digests(spark.createDataFrame([], TURNS)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a", "b", 1)], TURNS + ", segment string, seg_len int")
    assert chat_format.digests(odd).first().n_turns == 1


@pytest.mark.parametrize("column", ["context_chars", "target_start", "target_chars"])
def test_digests_are_made_of_the_examples(spark, monkeypatch, column):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "q"), (1, 3, "assistant", "second")], TURNS)
    whole = chat_format.examples
    monkeypatch.setattr(chat_format, "examples", lambda formatted: whole(formatted).filter("turn_index <> 3"))
    assert chat_format.digests(turns).first().loss_chars == len("first")
    monkeypatch.setattr(chat_format, "examples", lambda formatted: whole(formatted).withColumn(column, F.col(column) + F.when(F.col("turn_index") == 3, 1).otherwise(0)))
    with pytest.raises(Exception, match="mask of turn 3"):
        chat_format.digests(turns).collect()
