r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: every turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Control strings
inside roles and texts get one backslash after their first character, also when
backslashes stand there already (``</s>`` -> ``<\/s>``, ``<\/s>`` -> ``<\\/s>``),
so taking one away again gives the text back.

``segments`` renders each turn once, with its place in the conversation.
``examples`` makes one example of every assistant turn: its context is the
conversation's rendering up to ``context_chars`` (all preceding turns), and only
``target`` is trainable.  An example holds offsets, not a copy of its context,
so its rows stay linear in the turns; ``with_prompts`` copies the contexts out
where a trainer needs plain strings (that output is quadratic by definition).

Places are prefix sums in two levels, within chunks of turns and over chunk
totals, so one conversation with very many turns is not one task's work.

Defined results: null text and null role count as empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have a fixed order
and each stays a turn of its own; conversations without assistant turns have no
examples; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
CONTROL_TAILS = [r"\|im_start\|>", r"\|im_end\|>", r"s>", r"/s>", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>"]
_TAIL = "(?:" + "|".join(CONTROL_TAILS) + ")"
ESCAPE = (rf"([<\[])(\\*{_TAIL})", r"$1\\$2")
UNESCAPE = (rf"([<\[])\\(\\*{_TAIL})", r"$1$2")
TURNS_PER_CHUNK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def escape_role(role: Column) -> Column:
    r"""As escape, and line breaks as \n, for a role ends at the first line break."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, turn_index, role, segment, seg_start, target_from, target_len: one row per turn.

    seg_start is the segment's first code point in its conversation's rendering;
    target_from and target_len place the reply within the segment (assistant
    turns; else null).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    rows = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumns({"head": head, "body": body, "chunk": F.coalesce(F.floor(F.col("turn") / TURNS_PER_CHUNK), F.lit(-(2**40)))})
        .select("conv_id", "turn", "role", "text", "chunk", F.length("head").alias("head_len"), F.length("body").alias("body_len"), F.concat("head", "body", F.lit(END + "\n")).alias("segment"))
        .withColumn("seg_len", F.length("segment").cast("long"))
    )
    totals = rows.groupBy("conv_id", "chunk").agg(F.sum("seg_len").alias("chars"), F.count("*").alias("turns"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base_chars"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("base_turns"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    placed = rows.withColumns(
        {
            "own_chars": F.coalesce(F.sum("seg_len").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "own_turns": F.row_number().over(inside).cast("long") - 1,
        }
    )
    reply = F.col("role") == "assistant"
    return placed.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).select(
        "conv_id",
        (F.col("base_turns") + F.col("own_turns")).alias("turn_index"),
        "role",
        "segment",
        (F.col("base_chars") + F.col("own_chars")).alias("seg_start"),
        F.when(reply, F.col("head_len")).alias("target_from"),
        F.when(reply, F.col("body_len")).alias("target_len"),
    )


def _target() -> Column:
    return F.substring(F.col("segment"), F.col("target_from") + 1, F.col("target_len"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, turn_index, context_turns, context_chars, target_start, target_chars, target: one row per assistant turn of ``segments``.

    target_start and target_chars are the loss mask: the code points of the
    conversation's rendering that are trainable.  ``target`` is still escaped,
    as it stands in the rendering.
    """
    start = F.col("seg_start") + F.col("target_from")
    return formatted.filter("target_from IS NOT NULL").select("conv_id", "turn_index", F.col("turn_index").alias("context_turns"), F.col("seg_start").alias("context_chars"), start.alias("target_start"), F.col("target_len").alias("target_chars"), _target().alias("target"))


def renderings(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation as one string.

    Gathers a conversation in one row, as a whole-conversation string must.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn_index", "segment")))
    return formatted.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"))


def with_prompts(formatted: DataFrame) -> DataFrame:
    """conv_id, turn_index, prompt, target: ``examples`` with their contexts copied out."""
    prompts = renderings(formatted).select("conv_id", "formatted")
    own = examples(formatted)
    header = F.concat(F.lit(START), F.lit("assistant\n"))
    joined = own.withColumnRenamed("conv_id", "own_conv").join(prompts, F.col("own_conv").eqNullSafe(F.col("conv_id")))
    return joined.select("conv_id", "turn_index", F.concat(F.substring(F.col("formatted"), F.lit(1), F.col("context_chars").cast("int")), header).alias("prompt"), "target")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendering: the inverse of the template."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"),
        ),
    )


def masked(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, targets array<string>: each conversation's loss masks, of the rows of ``examples``, applied to its rendering.

    The rendering is cut as UTF-32, where a code point's place is known, so many
    masks do not mean many passes.  A mask whose text is not its example's
    target, or whose context does not end where the reply's header stands, fails.
    """
    masks = F.array_sort(F.collect_list(F.struct("turn_index", "context_chars", "target_start", "target_chars", F.xxhash64("target").alias("h"))))
    own = examples(formatted).groupBy(F.col("conv_id").alias("own_conv")).agg(masks.alias("masks"))
    whole = renderings(formatted)
    header = F.lit(f"{START}assistant\n")

    def piece(start: Column, chars: Column) -> Column:
        # The letter before it keeps a first U+FEFF from being read as a mark.
        cut = F.concat(F.unhex(F.lit("00000041")), F.substring(F.col("wide"), (4 * start + 1).cast("int"), (4 * chars).cast("int")))
        return F.substr(F.decode(cut, "UTF-32"), F.lit(2))

    def applied(m: Column) -> Column:
        text = piece(m["target_start"], m["target_chars"])
        right = (F.xxhash64(text) == m["h"]) & (piece(m["context_chars"], F.length(header)) == header) & (m["target_start"] == m["context_chars"] + F.length(header))
        return F.when(right, text).otherwise(F.raise_error(F.concat(F.lit("mask of turn "), m["turn_index"].cast("string"), F.lit(" is not its target"))).cast("string"))

    joined = whole.join(own, F.col("conv_id").eqNullSafe(F.col("own_conv")), "left").withColumn("wide", F.encode("formatted", "UTF-32"))
    return joined.select("conv_id", "formatted", F.coalesce(F.transform("masks", applied), F.array().cast("array<string>")).alias("targets"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output and the examples' masks."""
    whole = masked(segments(turns)).withColumns(
        {
            "turns": read_back(F.col("formatted")),
            "loss": F.array_join(F.transform("targets", unescape), ""),
        }
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_TAIL = _TAIL.replace("'", "''")
_SQL_ESCAPED = r"regexp_replace({}, '([<\[])(\\*" + _SQL_TAIL + r")', '\1\\\2', 'g')"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, {_SQL_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} AS r,
         {_SQL_ESCAPED.format("text")} AS x FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(r) + length(x))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
