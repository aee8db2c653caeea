r"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document has a few measures (word length, share of symbols, of repeated lines
and of repeated three-word windows).  A measure's thresholds are not fixed: they
follow from its quartiles among the documents of the same language and source that
pass the base rules, as median +- REACH times the larger of the quartile's distance
and the rule's slack.  The quartile on the side away from the threshold is
taken, so up to half of a source may be junk before its own junk sets the limits.

Quartiles are read from log-linear sketches: counts of a measure's values by their
leading seven bits, at most a few thousand cells a group, exact in rank and within
1/64 in value.  Sketches merge by adding cells, so those of a language and of the
whole corpus are sums of those of its sources, and partial ones are added before
any shuffle; they do not depend on order, so a job that runs again gives the same
rows.  A source with fewer than MIN_DOCS documents takes the thresholds of its
language, and such a language those of the corpus.

Texts are read once; what travels are measures (a few numbers a document).  Verdicts
are joined to them by language and source; groups of over a thousandth of all rows
are broadcast (there are less than a thousand), so no hot source is one task.

Defined results: null text has no words; null language or source is a group of its
own; texts of any length are read whole (three-word windows are sorted within the
row); each input row, also a repeated one or one without an id, gives one row;
without a document that passes the base rules nothing else is judged; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.shared import cut, looked_up

#: What a word and a symbol are.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50  # base rules: words at least, percent of words in repeated windows at most
MIN_DOCS, REACH, SUB_BITS = 100, 4, 6
#: Measures as whole numbers: (SQL over the counts, slack below the median or None, slack above it).
MEASURES: dict[str, tuple[str, int | None, int | None]] = {
    "word_length": ("1000 * word_chars div nullif(n_words, 0)", 400, 400),
    "symbols": ("10000 * n_symbols div nullif(n_words, 0)", None, 250),
    "repeated_lines": ("10000 * n_dup_lines div nullif(n_lines, 0)", None, 1250),
    "repeated_words": ("10000 * n_repeat_words div nullif(n_words, 0)", None, 750),
}
_GROUP = ["lk", "sk"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, also inside nested lambdas."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column) -> Column:
    """How many of an array's words lie in three-word windows that occur twice or more.

    Windows are first sorted as whole numbers of some hash bits above their
    place; of those whose bits are not alone, words are compared, so nothing
    rests on a hash.
    """
    places = F.lit((1 << 31) - 1).cast("long")

    def packed(w: Column) -> Column:
        hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(i).bitwiseAND(F.bitwise_not(places)).bitwiseOR(i.cast("long"))))

    def met(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.shiftright(x, 31) == F.shiftright(F.get(s, k), 31), F.lit(False))
        return F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1))

    def window(w: Column, found: Column) -> Column:
        return F.sort_array(F.transform(found, lambda x: _let(x.bitwiseAND(places).cast("int"), lambda i: F.struct(*(F.get(w, i + k).alias(n) for k, n in enumerate("abc")), i.alias("i")))))

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        step = lambda a, i: F.struct(i.alias("last"), (a.total + F.least(F.lit(3), i - a.last)).alias("total"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x.i)), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")), step, lambda a: a.total)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(window(words, _let(packed(words), met)), covered)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lk, sk and the counts of each row's whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c[0] + "k")
    own = docs.select("doc_id", key("lang"), key("source"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), counted.alias("w"), lined.alias("l"))
    rows = own.select("doc_id", *_GROUP, "n_symbols", "w.*", "l.*")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def cell(value: Column) -> Column:
    """The sketch cell of a whole number >= 0: its leading bits and how many follow."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - (SUB_BITS + 1))
    return F.call_function("shiftright", value, shift) + shift * (2 << SUB_BITS)


def low_edge(code: Column) -> Column:
    """The smallest number of a cell."""
    return F.call_function("shiftleft", code % (2 << SUB_BITS), (code / (2 << SUB_BITS)).cast("int"))


def sketches(rows: DataFrame) -> DataFrame:
    """lk, sk, measure, code, n: the cells of each group's measures over documents that pass the base rules."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), cell(F.expr(sql)).alias("code")) for m, (sql, _, _) in MEASURES.items()))
    passed = rows.filter("not base_failed")
    return passed.select(*_GROUP, F.explode(values).alias("m")).groupBy(*_GROUP, "m.measure", "m.code").agg(F.count("*").alias("n"))


def quartiles(cells: DataFrame, group: list[str]) -> DataFrame:
    """group, n and q1, q2, q3 of each measure, from the merged sketches of a group."""
    merged = cells.groupBy(*group, "measure", "code").agg(F.sum("n").alias("n"))
    within = W.partitionBy(*group, "measure")
    placed = merged.withColumns({"upto": F.sum("n").over(within.orderBy("code")), "total": F.sum("n").over(within)})
    read = {f"q{k}": F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("code"))) for k in (1, 2, 3)}
    told = placed.groupBy(*group, "measure").agg(F.max("total").alias("total"), *(c.alias(q) for q, c in read.items()))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    wide = [of(m, low_edge(F.col(q))).alias(f"{m}_{q}") for m in MEASURES for q in read]
    return told.groupBy(*group).agg(F.max("total").alias("n"), *wide)


def thresholds(rows: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """lk, sk, copies (rows), level (source, language or corpus) and {measure}_low, {measure}_high of each group of ``rows``."""
    cells = cut(sketches(rows))
    names = [f"{m}_q{k}" for m in MEASURES for k in (1, 2, 3)]
    corpus = quartiles(cells.withColumn("all", F.lit(0)), ["all"]).first()
    renamed = lambda df, prefix: df.select(*(c for c in df.columns if c in _GROUP), *(F.col(c).alias(prefix + c) for c in ["n", *names]))
    groups = rows.groupBy(*_GROUP).agg(F.count("*").alias("copies"))
    told = groups.join(renamed(quartiles(cells, _GROUP), "s_"), _GROUP, "left").join(renamed(quartiles(cells, ["lk"]), "l_"), "lk", "left")
    level = F.when(F.col("s_n") >= min_docs, "source").when(F.col("l_n") >= min_docs, "language").otherwise("corpus")
    told = told.withColumn("level", level)
    q = {c: F.when(F.col("level") == "source", F.col("s_" + c)).when(F.col("level") == "language", F.col("l_" + c)).otherwise(F.lit(corpus[c] if corpus else None).cast("long")) for c in names}
    limits = []
    for m, (_, below, above) in MEASURES.items():
        low = q[f"{m}_q2"] - reach * F.greatest(q[f"{m}_q3"] - q[f"{m}_q2"], F.lit(below)) if below is not None else F.lit(None).cast("long")
        limits += [low.alias(f"{m}_low"), (q[f"{m}_q2"] + reach * F.greatest(q[f"{m}_q2"] - q[f"{m}_q1"], F.lit(above))).alias(f"{m}_high")]
    return told.select(*_GROUP, "copies", "level", *limits)


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level, failed of each row.

    ``failed`` names the measures outside their thresholds, comma-joined; empty
    where the base rules have failed already.
    """
    rows = cut(measured(docs))
    joined = looked_up(rows, thresholds(rows, min_docs, reach), _GROUP)
    outside = []
    for m, (sql, _, _) in MEASURES.items():
        v = F.expr(sql)
        outside.append(F.when(~F.col("base_failed") & F.coalesce((v < F.col(f"{m}_low")) | (v > F.col(f"{m}_high")), F.lit(False)), m))
    failed = F.concat_ws(",", *outside)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & (failed == "")).alias("kept"), "level", failed.alias("failed"))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows equal in id, text, language and source share a verdict."""
    key = F.struct("doc_id", F.xxhash64("text", "lang", "source"))
    verdicts = judge(docs.select("text", "lang", "source", key.alias("doc_id")))
    good = verdicts.filter("kept").select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(good, "_key", "left_semi").select(docs.columns)


_SQL_MEASURES = {"word_length": "1000 * word_chars // n_words", "symbols": "10000 * n_symbols // n_words", "repeated_lines": "10000 * n_dup_lines // n_lines", "repeated_words": "10000 * n_repeat_words // n_words"}


def _sql_quartiles(name: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    merged = f"SELECT {keys}measure, code, sum(n)::BIGINT AS n FROM cells GROUP BY ALL"
    placed = f"SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY code) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM ({merged})"
    edges = ", ".join(f"min(code) FILTER (WHERE 4 * upto >= {k} * total) AS c{k}" for k in (1, 2, 3))
    values = ", ".join(f"((c{k} % 128) << (c{k} // 128)::INTEGER)::BIGINT AS q{k}" for k in (1, 2, 3))
    return f"{name} AS (SELECT {keys}measure, total, {values} FROM (SELECT {keys}measure, max(total) AS total, {edges} FROM ({placed}) GROUP BY ALL))"


ORACLE_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lk, coalesce('=' || source, '') AS sk, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM w
), x AS (
  SELECT r, i, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS abc FROM t WINDOW o AS (PARTITION BY r ORDER BY i)
), y AS (
  SELECT r, i FROM x WHERE abc IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, abc) > 1
), z AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM y, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM (
    SELECT w.r, doc_id, lk, sk, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN z ON w.r = z.r)
), v AS (
  SELECT r, lk, sk, base_failed, unnest([{", ".join(f"{{'measure': '{m}', 'value': CASE WHEN n_words > 0 THEN {sql} END}}" for m, sql in _SQL_MEASURES.items())}], recursive := true) FROM f
), cells AS (
  SELECT lk, sk, measure, greatest(0, length(bin(value)) - 7) * 128 + (value >> greatest(0, length(bin(value)) - 7)::INTEGER) AS code, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL
), {_sql_quartiles("qs", "lk, sk")}, {_sql_quartiles("ql", "lk")}, {_sql_quartiles("qc", "")}, slack AS (
  SELECT * FROM (VALUES {", ".join(f"('{m}', {'NULL' if below is None else below}, {above})" for m, (_, below, above) in MEASURES.items())}) AS s(measure, below, above)
), told AS (
  SELECT v.*, below, above, CASE WHEN qs.total >= {MIN_DOCS} THEN 'source' WHEN ql.total >= {MIN_DOCS} THEN 'language' ELSE 'corpus' END AS level,
    {", ".join(f"CASE WHEN qs.total >= {MIN_DOCS} THEN qs.q{k} WHEN ql.total >= {MIN_DOCS} THEN ql.q{k} ELSE qc.q{k} END AS q{k}" for k in (1, 2, 3))}
  FROM v JOIN slack USING (measure) LEFT JOIN qs USING (lk, sk, measure) LEFT JOIN ql USING (lk, measure) LEFT JOIN qc USING (measure)
), j AS (
  SELECT r, any_value(level) AS level, coalesce(string_agg(measure, ',' ORDER BY list_position({list(MEASURES)}, measure))
    FILTER (WHERE NOT base_failed AND (value < q2 - {REACH} * greatest(q3 - q2, below) AND below IS NOT NULL OR value > q2 + {REACH} * greatest(q2 - q1, above))), '') AS failed FROM told GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, level, failed FROM f JOIN j USING (r)
"""
