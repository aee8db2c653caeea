"""The quantity that a block of text asks for, among candidates of several strengths.

A number with a unit is a candidate unless it belongs to prose: a rate, a dimension,
or words after it other than prices.  It is strongest at the start of its line, weaker
before price columns, weakest at the end of other words.  The strongest candidates
count; where they differ the quantity is ambiguous and stays open.  Without any, a
line of a number and a word that is no known unit names an unknown unit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions import numbers
from bidloom.functions.binding import once

# Numbers, units, prices and the words around them in tenders and offers.
NUMBER = r"\d{1,3}(?:\.\d{3})*(?:,\d+)?|\d+(?:[.,]\d+)?"
UNITS = "Stück|Stk|Std|Stunden?|St|m2|m²|m3|m³|Meter|m|kg|Psch|Tage?|h|d"
MONEY = r"-?\d{1,3}(?:\.\d{3})*,\d{2}"
PRICE = rf"(?:{MONEY}|[.·…]+)"
PRICE_COLUMNS = rf"(?iu)^(?:(?:EP|GP|E-Preis|Einzelpreis|Gesamtpreis)\s*:?\s*)?{PRICE}(?:\s+(?:(?:EP|GP)\s*:?\s*)?{PRICE})*$"
PLAIN_COLUMNS = rf"(?iu)^(?:(?:EP|GP)\s+)?{MONEY}(?:\s+(?:(?:EP|GP)\s+)?{MONEY})*$"
DIMENSIONS = r"(?iu)(?:gewicht|volumenstrom|(?:rohr|kabel|bau)?länge|höhe|breite|tiefe|abmessung|durchmesser|inhalt|leistung|(?:preis(?:e)?|EP)\s+(?:je|pro)|(?:EUR|€)\s*/)\s*:?\s*$"
NO_UNITS = ["bar", "dn", "ep", "eur", "gp", "hz", "kw", "mm", "v"]
QUANTITY = rf"(?iu)(?:{NUMBER})\s+(?:{UNITS})\b"
NAMED = rf"(?u)^\s*({NUMBER})\s+([\p{{L}}][\p{{L}}\d./-]{{0,11}})(.*)$"
LONGEST_NOISE = 60  # of misread price columns after a quantity


def _candidates(line: Column, allow_noise: bool) -> Column:
    """array<struct<raw, strength, noisy>> of one line."""
    woven = lambda a, b: F.array_join(F.flatten(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.array(F.coalesce(z["x"], F.lit("")), F.coalesce(z["y"], F.lit(""))))), "")

    def judged(raw: Column, before: Column, after: Column) -> Column:
        noisy = (before == "") & (after != "") & (F.length(after) <= LONGEST_NOISE) if allow_noise else F.lit(False)

        def of_prices(prices: Column) -> Column:
            prose = after.startswith("/") | ((before != "") & before.rlike(DIMENSIONS)) | ((after != "") & ~prices & ~noisy)
            strength = F.when(before == "", 3).when(prices, 2).otherwise(1)
            return F.when(~prose, F.struct(raw.alias("raw"), strength.alias("strength"), (noisy & ~prices).alias("noisy")))

        return once((after != "") & after.rlike(PRICE_COLUMNS), of_prices)

    def told(found: Column, around: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            before = F.trim(woven(F.slice(around, F.lit(1), i + 1), F.slice(found, F.lit(1), i)))
            after = F.trim(woven(F.slice(around, i + 2, F.size(around)), F.slice(found, i + 2, F.size(found))))
            return once(F.struct(before.alias("before"), after.alias("after")), lambda s: judged(raw, s["before"], s["after"]))

        return F.array_compact(F.transform(found, one))

    return once(F.regexp_extract_all(line, F.lit(QUANTITY), F.lit(0)), lambda found: once(F.split(line, QUANTITY, -1), lambda around: told(found, around)))


def quantity(text: Column, allow_noise: bool = False) -> Column:
    """struct<quantity, unit, raw, reason>; reason is null, OCR_SOURCE, QUANTITY_AMBIGUOUS, UNKNOWN_UNIT or QUANTITY_MISSING.

    ``allow_noise`` takes a quantity that opens its line though what follows is no price, as OCR misreads
    handwritten columns; it is marked OCR_SOURCE.  Null text is missing.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    every = F.flatten(F.transform(lines, lambda x: _candidates(x, allow_noise)))
    value = lambda raw: numbers.strict_number(F.regexp_extract(raw, rf"^({NUMBER})\s", 1))
    unit = lambda raw: F.regexp_extract(raw, r"\s(\S+)$", 1)
    whole = lambda q, u, raw, reason: F.struct(q.cast("double").alias("quantity"), u.cast("string").alias("unit"), raw.alias("raw"), reason.cast("string").alias("reason"))
    none, missing = F.lit(None), whole(F.lit(None), F.lit(None), F.lit(""), F.lit("QUANTITY_MISSING"))

    def chosen(found: Column) -> Column:
        strongest = lambda most: F.filter(found, lambda c: c["strength"] == most)
        return once(once(F.array_max(F.transform(found, lambda x: x["strength"])), strongest), settled)

    def settled(best: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(best, lambda c: F.struct(value(c["raw"]), F.lower(unit(c["raw"]))))))
        first = F.get(best, F.lit(0))
        raws = F.array_join(F.transform(best, lambda c: c["raw"]), " / ")
        one = whole(value(first["raw"]), unit(first["raw"]), first["raw"], F.when(first["noisy"], "OCR_SOURCE"))
        return F.when(distinct > 1, whole(none, none, raws, F.lit("QUANTITY_AMBIGUOUS"))).when(F.size(best) > 0, one)

    def unnamed(line: Column) -> Column:
        part = lambda k: F.regexp_extract(line, NAMED, k)
        rest = F.trim(part(3))
        fits = line.rlike(NAMED) & ((rest == "") | rest.rlike(PLAIN_COLUMNS)) & ~F.lower(part(2)).isin(NO_UNITS)
        return F.when(fits, F.concat(part(1), F.lit(" "), part(2)))

    unknown = F.get(F.array_compact(F.transform(lines, unnamed)), F.lit(0))
    other = once(unknown, lambda u: F.when(u.isNotNull(), whole(none, none, u, F.lit("UNKNOWN_UNIT"))))
    return F.coalesce(once(every, chosen), other, missing)
