r"""Personal data by weak supervision, in DataFrame and SQL functions only.

Three labelers vote on every candidate span, each 1 (personal), 0 (not) or -1
(abstains): the pattern labeler (the span's form: checks, grouping, leading
zeros), a gazetteer (card issuers, calling and area codes, mail domains, reserved
networks, given names, surname endings, words that are no surnames) and the words
just before the span.  Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability per kind; the posteriors weight the training
counts of a naive Bayes span classifier.

The base kinds email, ip, card and phone are always kept when their check holds.
On the kinds that have no check, ``name`` and ``local_phone``, the classifier
alone decides.

Only vote patterns and feature counts are ever aggregated (a few hundred groups
at any input size), so no document travels; the candidates are checkpointed
once, without texts, for training and decision.

Positions count code points from 0, ends are exclusive.  Defined results: null
text counts as empty; documents without spans have zero counts and the digest
of the empty string; overlapping spans are redacted as one, of the kind of the
first (of equal starts the kind listed first); each input row, also a repeated
one or one without an id, gives one row; empty tables give empty tables; other
columns are not read by ``find``; work is linear in the text and its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.shared import cut

#: Kinds in their order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "local_phone", "name"]
BASE = KINDS[:4]
#: Given names that make a capitalised pair a candidate name.
GIVEN_NAMES = "Alice Andrew Anna Antonio Barbara Carlos Carmen Charles Claire David Elena Emily Emma Francois George Hans Helen Ines Isabel Jack James Jean Jessica John Jose Juan Julia Karl Katharina Laura Linda Luis Manuel Maria Marie Mark Martin Mary Michael Michel Miguel Patricia Paul Pedro Peter Petra Philippe Pierre Robert Sarah Sofia Stefan Susan Thomas Ursula William Wolfgang".split()
TITLES = "Mr Mrs Ms Dr Herr Frau Mme Monsieur Madame Señor Señora".split()
#: Patterns with the same leftmost matches as the base definitions, in forms that
#: never rescan a run: possessive runs that start where no run already stands.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9])(?<!\+[0-9]{1,3}[ .-]{0,2})\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": r"\b(?:(?:" + "|".join(TITLES) + r")\.? |(?:" + "|".join(GIVEN_NAMES) + r") )\p{Lu}\p{L}+",
}
#: What a text must hold for its kind's pattern to be worth running; never stricter than the pattern.
WORTH = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'",
    "card": r"text rlike '[0-9](?:[ -]?[0-9]){12}'",
    "phone": "contains(text, '+')",
    "local_phone": r"text rlike '[0-9]{3}[ .-][0-9]{4}(?![0-9])'",
    "name": r"text rlike '\\b(?:" + "|".join([*TITLES, *GIVEN_NAMES]) + r")\\b'",
}
#: The pattern labeler's votes, as SQL over x.v, the span's text; CHECK stands for the kind's check.
FORMS = {
    "email": r"if(x.v rlike '^[.]|[.][.]|[.]@|@-', 0, if(x.v rlike '[.][A-Za-z]{2,}$', 1, -1))",
    "ip": r"if(not CHECK or x.v rlike '(?:^|[.])0[0-9]', 0, if(x.v rlike '^[0-9][.][0-9][.][0-9][.][0-9]$', -1, 1))",
    "card": r"if(CHECK, if(x.v rlike '^(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5,6}$', 1, -1), 0)",
    "phone": r"if(CHECK, if(x.v rlike '[ ().-]{3}', -1, 1), 0)",
    "local_phone": r"if(x.v rlike '[ ).-][2-9][0-9]{2}[ .-][0-9]{4}$', 1, 0)",
    "name": r"if(x.v rlike ' \\p{Lu}\\p{Ll}{2,}$', 1, 0)",
}
#: Capitalised words that follow a given name or title without being a surname, and endings of surnames.
NO_SURNAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Street|Avenue|Road|Square|University|College|School|Hotel|Hospital|Church|County|River|Island|Straße|Platz|Allee|Kirche|Schule|Rue|Place|Calle|Plaza"
SURNAME_ENDINGS = "son|sen|mann|berg|stein|bauer|meier|meyer|müller|ez|ini|ski|sky|ova|ov|eau|ton|ley|man|er|ith|ard|ell"
#: The gazetteer's votes, as SQL over v, the span's text.
GAZETTEER = {
    "email": r"if(lower(v) rlike '[.](?:com|org|net|edu|gov|info|eu|de|fr|es|uk|ch|at|io)$', 1, -1)",
    "ip": r"if(v rlike '^(?:0|10|127|255|22[4-9]|2[3-5][0-9])[.]' or v rlike '^192[.]168[.]', 0, 1)",
    "card": r"if(v rlike '^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)', 1, 0)",
    "phone": r"if(v rlike '^[+](?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])', 1, -1)",
    "local_phone": r"if(v rlike '^[(]?(?:[2-9]11|[2-9]9[0-9]|37[0-9]|96[0-9]|8(?:00|22|33|44|55|66|77|88))', 0, 1)",
    "name": r"if(v rlike ' (?:" + NO_SURNAMES + r")$', 0, if(v rlike '^(?:" + "|".join(GIVEN_NAMES) + r") |(?:" + SURNAME_ENDINGS + r")$', 1, -1))",
}
#: Words before a span that speak for its kind; and against any.
CUES = {
    "email": "mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|karte|carte|tarjeta|visa|credit|kredit",
    "phone": "tel|phone|call|fon|ruf|mobil|appel|fax",
    "local_phone": "tel|phone|call|fon|ruf|mobil|appel|fax",
    "name": "name|signed|author|contact|call|dear|liebe|cher|querid",
}
AGAINST = "version|release|token|sha|md5|isbn|order|serial|section"
CONTEXT_CHARS, CHUNK, ROUNDS = 24, 512, 25

_SPAN = "struct<s:bigint,e:bigint,v:string,c:string>"


def _matches(kind: str) -> str:
    """SQL: array of the pattern's matches (start, end, text, context), linear in the text.

    Pieces between matches and the matches alternate, so positions are running
    lengths; they are summed chunk by chunk, as appending copies an array.
    """
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    pairs = f"arrays_zip(split(text, '{pattern}', -1), regexp_extract_all(text, '{pattern}', 0))"
    step = f"""named_struct('pos', a.pos + length(x.`0`) + length(x.`1`), 'cur', array_append(a.cur,
        named_struct('s', a.pos + length(x.`0`), 'e', a.pos + length(x.`0`) + length(x.`1`), 'v', x.`1`, 'c', right(x.`0`, {CONTEXT_CHARS}))))"""
    chunk = f"""aggregate(slice(z, k * {CHUNK} + 1, {CHUNK}), named_struct('pos', o.pos, 'cur', cast(array() as array<{_SPAN}>)),
        (a, x) -> {step}, a -> named_struct('pos', a.pos, 'all', array_append(o.all, a.cur)))"""
    found = f"""transform(array(filter({pairs}, x -> x.`1` is not null)), z -> if(size(z) = 0, cast(array() as array<{_SPAN}>),
        flatten(aggregate(sequence(0, (size(z) - 1) div {CHUNK}), named_struct('pos', 0L, 'all', cast(array() as array<array<{_SPAN}>>)), (o, k) -> {chunk}, o -> o.all))))[0]"""
    return f"if({WORTH[kind]}, {found}, cast(array() as array<{_SPAN}>))"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    """SQL: whether 16 to 19 digits pass Luhn's check."""
    d = f"reverse({_digits(v)})"
    double = "transform(array(cast(substr(q, i, 1) as int) * 2), t -> if(t > 9, t - 9, t))[0]"
    total = f"aggregate(sequence(1, length(q)), 0, (t, i) -> t + if(i % 2 = 0, {double}, cast(substr(q, i, 1) as int)))"
    return f"transform(array({d}), q -> if(length(q) between 16 and 19, {total} % 10 = 0, false))[0]"


CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), o -> length(ltrim('0', o)) <= 3 and cast(right(concat('00', o), 3) as int) <= 255)",
    "card": _luhn("x.v"),
    "phone": f"length({_digits('x.v')}) between 8 and 15",
    "local_phone": "true",
    "name": "true",
}


def candidates(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id and spans, an array of candidate structs, for each row of ``docs``; and the ``extra`` columns (a text among them with null as empty)."""
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *(c for c in extra or [] if c != "text"))
    arrays = []
    for k, kind in enumerate(KINDS):
        own = own.withColumn(f"_m{k}", F.expr(_matches(kind)))
        v = "x.v"
        # Long digit runs that are no card at all are left out before the votes: over half of all numbers.
        kept = f"filter(_m{k}, x -> length({_digits(v)}) between 13 and 19)" if kind == "card" else f"_m{k}"
        form = FORMS[kind].replace("CHECK", CHECKS[kind])
        gazetteer = f"transform(array(x.v), v -> {GAZETTEER[kind]})[0]"
        context = f"if(lower(x.c) rlike '\\\\b(?:{CUES[kind]})', 1, if(lower(x.c) rlike '\\\\b(?:{AGAINST})', 0, -1))"
        arrays.append(
            f"""transform({kept}, x -> named_struct('k', {k}, 's', x.s, 'e', x.e, 'b', {CHECKS[kind]}, 'r', {form}, 'g', {gazetteer}, 'c', {context},
            'f', array(concat('d', least(length({_digits(v)}), 20)), concat('p', length(regexp_replace(x.v, '[^ ().-]', ''))), concat('l', least((x.e - x.s) div 4, 12)),
            concat('b', if(x.c = '', '^', if(right(x.c, 1) rlike '\\\\p{{L}}', 'a', right(x.c, 1)))))))"""
        )
    return own.select("doc_id", *(extra or []), F.expr(f"concat({', '.join(arrays)})").alias("spans"))


_PARAMS = ["p", "r1", "g1", "c1", "r0", "g0", "c0"]


def _logit(q: str, x: str) -> str:
    """SQL: log odds of vote pattern x under parameters q."""
    parts = [f"ln({q}.p / (1 - {q}.p))"]
    for j in "rgc":
        parts.append(f"case {x}.{j} when 1 then ln({q}.{j}1 / {q}.{j}0) when 0 then ln((1 - {q}.{j}1) / (1 - {q}.{j}0)) else 0D end")
    return " + ".join(parts)


def reliabilities(spans: DataFrame) -> DataFrame:
    """Per kind k, EM estimates: q.p the share of personal spans, q.j1 and q.j0 how often labeler j says 1 on personal and on other spans."""
    patterns = spans.groupBy("k", "r", "g", "c").agg(F.count("*").cast("double").alias("n")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("r", "g", "c", "n"))).alias("w"))
    posts = f"transform(w, x -> named_struct('r', x.r, 'g', x.g, 'c', x.c, 'n', x.n, 'y', 1 / (1 + exp(-greatest(-50D, least(50D, {_logit('q', 'x')}))))))"
    add = "aggregate({}, 0D, (t, x) -> t + {})".format
    fields = [f"'p', greatest(0.01D, least(0.99D, ({add('z', 'x.n * x.y')} + 1) / ({add('z', 'x.n')} + 2)))"]
    for y, weight in (("1", "x.n * x.y"), ("0", "x.n * (1 - x.y)")):
        for j in "rgc":
            # One added vote of 0.8 (0.2) keeps the labelers' meaning where all abstain.
            hit, seen = add(f"filter(z, x -> x.{j} = 1)", weight), add(f"filter(z, x -> x.{j} >= 0)", weight)
            fields.append(f"'{j}{y}', greatest(0.01D, least(0.99D, ({hit} + {2 * (0.8 if y == '1' else 0.2)}D) / ({seen} + 2)))")
    start = "named_struct('p', 0.5D, 'r1', 0.8D, 'g1', 0.8D, 'c1', 0.8D, 'r0', 0.2D, 'g0', 0.2D, 'c0', 0.2D)"
    step = f"transform(array({posts}), z -> named_struct({', '.join(fields)}))[0]"
    return patterns.select("k", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (q, i) -> {step})").alias("q"))


def classifier(spans: DataFrame) -> DataFrame:
    """One row with ``weights``, a map 'kind:feature' -> log likelihood ratio, and 'kind:' -> log prior odds.

    Counts are weighted by the posteriors of the reliabilities; the votes are
    features beside the span's shape.
    """
    judged = spans.join(F.broadcast(reliabilities(spans)), "k")  # one row per kind
    judged = judged.select(
        "k",
        F.expr("concat(f, array(concat('r', r), concat('g', g), concat('c', c)))").alias("f"),
        F.expr(f"transform(array(named_struct('r', r, 'g', g, 'c', c)), x -> 1 / (1 + exp(-({_logit('q', 'x')}))))[0]").alias("y"),
    )
    totals = judged.groupBy("k").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    counts = judged.select("k", "y", F.explode("f").alias("f")).groupBy("k", "f").agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0"))
    ratios = counts.join(F.broadcast(totals), "k").select(F.concat_ws(":", "k", "f").alias("key"), F.expr("ln(((y1 + 0.5) / (n1 + 10)) / ((y0 + 0.5) / (n0 + 10)))").alias("value"))
    priors = totals.select(F.concat(F.col("k").cast("string"), F.lit(":")).alias("key"), F.expr("ln((n1 + 1) / (n0 + 1))").alias("value"))
    return ratios.union(priors).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("weights"))


def find(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the extra columns, and spans array<struct<k, s, e, base>> in the order of kind, start."""
    found = cut(candidates(docs, extra))
    flat = found.select(F.explode("spans").alias("x")).select("x.*")
    weights = classifier(flat).scalar()
    score = "coalesce(w[concat(x.k, ':')], 0D) + aggregate(concat(x.f, array(concat('r', x.r), concat('g', x.g), concat('c', x.c))), 0D, (t, f) -> t + coalesce(w[concat(x.k, ':', f)], 0D))"
    keep = f"if(x.k < {len(BASE)}, x.b, ({score}) > 0)"
    decided = found.withColumn("w", weights).withColumn("spans", F.expr(f"transform(filter(spans, x -> {keep}), x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'base', x.k < {len(BASE)}))"))
    return decided.select("doc_id", *(extra or []), F.array_sort("spans").alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    found = find(docs)
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    written = f"transform({{}}, x -> concat({names}[x.k], ':', x.s, ':', x.e))"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.expr(f"array_join({written.format('filter(spans, x -> x.base)')}, ',')")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(f"array_join({written.format('spans')}, ',')").alias("spans"))


def _heads(spans: str) -> str:
    """SQL: struct of ``z``, the spans by start that begin where no earlier one still runs (s, k, and m, the greatest end before), and ``m``, the greatest end of all.

    The running greatest end is folded chunk by chunk, as appending copies an array.
    """
    head = "struct<s:bigint,k:int,m:bigint>"
    step = "named_struct('m', greatest(a.m, x.e), 'cur', if(x.s >= a.m, array_append(a.cur, named_struct('s', x.s, 'k', x.k, 'm', a.m)), a.cur))"
    chunk = f"""aggregate(slice(z, i * {CHUNK} + 1, {CHUNK}), named_struct('m', o.m, 'cur', cast(array() as array<{head}>)),
        (a, x) -> {step}, a -> named_struct('m', a.m, 'all', array_append(o.all, a.cur)))"""
    folded = f"aggregate(sequence(0, (size(z) - 1) div {CHUNK}), named_struct('m', 0L, 'all', cast(array() as array<array<{head}>>)), (o, i) -> {chunk}, o -> named_struct('z', flatten(o.all), 'm', o.m))"
    return f"transform(array(array_sort(transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))), z -> {folded})[0]"


def _piece(start: str, end: str | None = None) -> str:
    """SQL: code points from start to end of ``w``, the text as UTF-32; the letter before it keeps a first U+FEFF from being read as a mark."""
    chars = f", int(4 * ({end} - {start}))" if end else ""
    return f"substring(decode(concat(X'00000041', substring(w, int(4 * {start}) + 1{chars})), 'UTF-32'), 2)"


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with every span replaced by its kind, as <EMAIL>; n_chars follows."""
    found = find(docs, ["text", "lang", "source", "n_chars"])
    names = f"array({', '.join(repr(f'<{k.upper()}>') for k in KINDS)})"
    cutting = f"concat(array_join(transform(h.z, x -> concat({_piece('x.m', 'x.s')}, {names}[x.k])), ''), {_piece('h.m')})"
    cut_up = f"transform(array(named_struct('h', {_heads('spans')}, 'w', encode(text, 'UTF-32'))), q -> transform(array(q.h), h -> transform(array(q.w), w -> {cutting})[0])[0])[0]"
    text: Column = F.expr(f"if(size(spans) = 0, text, {cut_up})")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.expr("if(size(spans) = 0, n_chars, null)").alias("n_chars")).withColumn("n_chars", F.coalesce("n_chars", F.length("text").cast("long")))
