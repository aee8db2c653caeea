"""Text normalisation and comparison as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.binding import once


def _plain(letter: str) -> str:
    """A letter's compatibility decomposition without its marks; ß has none."""
    return "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.category(x).startswith("M"))


# Letters with marks, full-width and raised signs, and the one plain sign each decomposes to; built by that rule.
_LETTERS = {chr(c): _plain(chr(c)) for block in (range(0xA0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000), range(0x2070, 0x2090), range(0xFF01, 0xFF5F)) for c in block}
ACCENTED = "".join(a for a, b in _LETTERS.items() if len(b) == 1 and a != b)
PLAIN = "".join(b for a, b in _LETTERS.items() if len(b) == 1 and a != b)
# Signs that decompose to several.
SEVERAL = {x: _plain(x) for x in "ﬀﬁﬂﬃﬄﬆ¼½¾™№"}
# Unit spellings of one canonical unit each.
UNITS = {"piece": ["st", "stk", "stck", "stuck", "stueck"], "meter": ["m", "meter", "lfm"], "kilogram": ["kg", "kilogramm"]}
# Nominal diameter in millimetres of a pipe thread in inches.
NOMINAL_DIAMETERS = {"1/2": 15, "3/4": 20, "1": 25, "1 1/4": 32, "1 1/2": 40, "2": 50}
# First words of subtotal lines.
SUBTOTAL_WORDS = ["objektsumme", "zwischensumme", "subtotal", "section total", "summe"]


def _strip_marks(c: Column) -> Column:
    """Compatibility decomposition without marks."""
    whole = c
    for sign, plain in SEVERAL.items():
        whole = F.replace(whole, F.lit(sign), F.lit(plain.lower()))
    opened = F.when(c.rlike(f"[{''.join(SEVERAL)}]"), whole).otherwise(c)
    stripped = F.regexp_replace(F.translate(opened, ACCENTED, PLAIN), r"\p{M}+", "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(stripped)  # plain ASCII has none


def match_normalize(c: Column) -> Column:
    """Lower case, no marks, runs of other than letters and digits to one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(_strip_marks(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def search_normalize(c: Column) -> Column:
    """Lower case, no marks, white space to one space, punctuation kept."""
    return F.trim(F.regexp_replace(_strip_marks(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct normalised words of more than two letters."""
    return words(match_normalize(c))


def words(normalized: Column) -> Column:
    """Distinct words of more than two letters of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: F.length(w) > 2))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice coefficient of two token arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double") * 2
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b)))


def canonical_unit(c: Column) -> Column:
    def named(unit: Column) -> Column:
        out = F.when(unit == "", F.lit(None).cast("string"))
        for name, spellings in UNITS.items():
            out = out.when(unit.isin(spellings), name)
        return out.otherwise(unit)

    return once(match_normalize(c), named)


def nominal_diameters(c: Column) -> Column:
    """Distinct diameters a text offers: DN numbers, and thread sizes in inches."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[″”]", '"'), r"\s*/\s*", "/"), r"\s+", " ")

    def found(text: Column) -> Column:
        direct = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bdn\s*(\d{1,3})\b"), F.lit(1)), lambda x: x.try_cast("int"))
        inches = []
        for inch, dn in NOMINAL_DIAMETERS.items():
            bare = rf"|(?i)(?:^|\s){inch}(?=\s|,|;|$)" if "/" in inch else ""
            pattern = rf'(?i)(?:^|\s){inch}\s*(?:"|zoll)|(?i)innengewinde\s+{inch}(?=\s|,|;|$)' + bare
            inches.append(F.when(text.rlike(pattern), dn))
        spelt = F.when(text.rlike(r'(?i)["/]|zoll|innengewinde'), F.array_compact(F.array(*inches))).otherwise(F.array().cast("array<int>"))  # every thread size has one of these
        return F.array_distinct(F.concat(direct, spelt))

    return once(plain, found)


def _squeezed(c: Column) -> Column:
    return F.replace(match_normalize(c), F.lit(" "), F.lit(""))


def attribute_wanted(value: Column) -> Column:
    """struct<dn, word>: the diameter that an attribute's value asks for (null if none), and the value without spaces."""
    return F.struct(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)\bdn\s*(\d{1,3})\b", 1).try_cast("int").alias("dn"), _squeezed(value).alias("word"))


def attribute_offered(offered: Column) -> Column:
    """struct<dns, text>: the diameters that a text offers, and the text without spaces."""
    return F.struct(nominal_diameters(offered).alias("dns"), _squeezed(offered).alias("text"))


def attribute_result(wanted: Column, offered: Column) -> Column:
    """MATCH, MISMATCH or UNRESOLVED; only an expected diameter that meets other ones is a mismatch."""
    return (
        F.when(wanted["dn"].isNotNull() & F.array_contains(offered["dns"], wanted["dn"]), "MATCH")
        .when(wanted["dn"].isNotNull() & (F.size(offered["dns"]) > 0), "MISMATCH")
        .when(wanted["dn"].isNull() & (wanted["word"] != "") & F.contains(offered["text"], wanted["word"]), "MATCH")
        .otherwise("UNRESOLVED")
    )


def attribute_match(value: Column, offered: Column) -> Column:
    both = F.struct(attribute_wanted(value).alias("wanted"), attribute_offered(offered).alias("offered"))
    return once(both, lambda x: attribute_result(x["wanted"], x["offered"]))


def type_identifier(c: Column) -> Column:
    """What follows 'Typ:' up to a closing keyword; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\bTyp\s*:\s*(.+?)(?=\s+(?:Komplett|Fabrikat|Art\.?-?Nr\.?)\b|$)", 1)), F.lit(""))


def article_number(c: Column) -> Column:
    """The article number that a text asks for; null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?iu)\b(?:Art\.?\s*-?\s*Nr\.?|Artikelnummer)\s*:?\s*([\p{L}\p{N}][\p{L}\p{N}._/-]{3,})", 1), F.lit(""))


def is_subtotal(description: Column, role: Column, references: Column) -> Column:
    return F.coalesce(role == "NOTE", F.lit(False)) | ((F.size(references) == 0) & starts_as_subtotal(match_normalize(description)))


def starts_as_subtotal(normalized: Column) -> Column:
    return normalized.rlike("^(?:" + "|".join(SUBTOTAL_WORDS) + r")\b")


def brand_key(c: Column) -> Column:
    """Brand names without legal forms, marks and punctuation."""
    return F.trim(F.regexp_replace(match_normalize(c), r"\b(?:gmbh|ag|kg|co|ohg|se|ltd|inc|llc)\b\s*", ""))


def initials(c: Column) -> Column:
    """First letters of the first two words, upper case."""
    words = F.filter(F.split(match_normalize(c), " "), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def collapse_repeats(c: Column) -> Column:
    """A line that repeats the one before it goes, then a word that does."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?iu)\b(\p{L}+)(?:[ \t]+\1\b)+", "$1")


def collapse_sentences(c: Column) -> Column:
    """``collapse_repeats``, and a sentence that repeats the one before it goes."""
    parts = F.split(collapse_repeats(c), r"(?<=[.!?])\s+")
    return F.array_join(F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1))), " ")


def german_order(c: Column, numeric: bool = False) -> Column:
    """A text to order by as a German dictionary does; ``numeric`` orders runs of digits by their value (up to 18 digits)."""
    if numeric:
        parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
        c = F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), 18, "0")).otherwise(x)), "")
    return F.collate(c, "de")


def truncate_label(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"\s+$", ""), F.lit("…"))).otherwise(c)


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, trimmed; null if none does."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)), F.lit("")) for p in patterns))


def search_contains(query: Column, *fields: Column) -> Column:
    """Whether the fields' normalised text holds the query's; an empty query holds everywhere."""
    return F.contains(search_normalize(F.concat_ws(" ", *fields)), search_normalize(query))


def date_hints(c: Column, limit: int = 5) -> Column:
    """The first distinct day.month.year spellings of a text."""
    day, month, year = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:20)?[0-9]{2}"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b{day}[./-]{month}[./-]{year}\b"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, limit)
