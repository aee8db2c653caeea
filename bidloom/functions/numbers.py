"""Numbers, money and tolerances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.binding import once

# tokens' prices in USD for a million: input, cached input, output.
TOKEN_PRICES = {"input": 5.0, "cached": 0.5, "output": 30.0}
# What each doubt takes from a line's extraction confidence.
CONFIDENCE_PENALTIES = {"no_reference": 0.12, "no_quantity": 0.12, "no_unit": 0.10, "no_price": 0.14, "weak_evidence": 0.20, "no_evidence": 0.30, "arithmetic": 0.25}


def _remove(c: Column, sign: str) -> Column:
    return F.replace(c, F.lit(sign), F.lit(""))


def german_number(c: Column) -> Column:
    """The last of ',' and '.' is the decimal sign; several dots without comma group thousands; null if no number."""

    def plain(t: Column) -> Column:
        comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
        has_comma, has_dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        return (
            F.when(has_comma & has_dot & (dot > comma), _remove(t, ","))
            .when(has_comma & (F.length(t) - F.length(_remove(t, ",")) == 1), F.replace(_remove(t, "."), F.lit(","), F.lit(".")))
            .when(has_comma, F.lit(None).cast("string"))
            .when(F.length(t) - F.length(_remove(t, ".")) > 1, _remove(t, "."))
            .otherwise(t)
        )

    number = lambda p: F.when(p.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), p.try_cast("double"))
    return once(once(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.\-+]", ""), plain), number)


def strict_number(c: Column) -> Column:
    """Every dot groups thousands, the comma is the decimal sign."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.\-]", ""), r"\.", ""), ",", ".")
    return F.when(t.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("double"))


def quantity_number(c: Column) -> Column:
    """As strict_number, but one dot before other than three digits is a decimal point."""
    one = F.trim(F.coalesce(c, F.lit(""))).rlike(r"^-?[0-9]+\.[0-9]{1,2}$|^-?[0-9]+\.[0-9]{4,}$")
    return F.when(one, F.trim(c).try_cast("double")).otherwise(strict_number(c))


def cents(c: Column) -> Column:
    """Rounded to cents, halves towards plus infinity."""
    return F.floor(c * 100 + 0.5).cast("double") / 100


def prices_close(quantity: Column, unit_price: Column, total: Column, basis: Column | None = None, tolerance: float = 0.02) -> Column:
    basis = F.lit(1.0) if basis is None else basis.cast("double")
    expected = quantity * unit_price / F.when(basis > 0, basis)
    return F.coalesce(F.abs(expected - total) <= F.greatest(F.lit(0.02), F.abs(total) * tolerance), F.lit(False))


def quantity_close(wanted: Column, offered: Column) -> Column:
    return F.abs(wanted - offered) <= F.greatest(F.lit(0.001), wanted * 0.01)


def money_values(c: Column) -> Column:
    """All money amounts of a line, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![0-9.,])([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}|[0-9]+[.,][0-9]{2})(?![0-9])"), F.lit(1))
    return F.transform(found, german_number)


def price_basis(c: Column) -> Column:
    """'1' where none is stated, the basis where one is, 'unreadable' where several differ or the value is none of 1, 10, 100, 1000."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\b(?:per|pro|je)\s+([0-9]+)\b"), F.lit(1)))
    return F.when(F.size(found) == 0, "1").when((F.size(found) == 1) & F.get(found, F.lit(0)).isin("1", "10", "100", "1000"), F.get(found, F.lit(0))).otherwise("unreadable")


def quantity_with_unit(c: Column) -> Column:
    """struct<quantity, unit> where exactly one distinct quantity with a unit stands in the text; else null."""
    pairs = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)(?<![0-9.,])[0-9][0-9.,]*\s*(?:stk|stck|st|m|lfm|kg|psch)\b"), F.lit(0)))
    only = F.get(pairs, F.lit(0))
    return F.when(F.size(pairs) == 1, F.struct(quantity_number(F.regexp_extract(only, r"^([0-9.,]*[0-9])", 1)).alias("quantity"), F.lower(F.regexp_extract(only, r"([A-Za-z]+)$", 1)).alias("unit")))


def line_confidence(**doubts: Column) -> Column:
    """1 less the penalties of the doubts that hold, 0 at least."""
    total = F.lit(1.0)
    for name, doubt in doubts.items():
        total = total - F.when(doubt, CONFIDENCE_PENALTIES[name]).otherwise(0.0)
    return F.greatest(F.lit(0.0), total)


def token_cost(inputs: Column, cached: Column, outputs: Column) -> Column:
    fresh = F.greatest(inputs - cached, F.lit(0))
    return (fresh * TOKEN_PRICES["input"] + cached * TOKEN_PRICES["cached"] + outputs * TOKEN_PRICES["output"]) / 1e6


def german_format(c: Column) -> Column:
    """Grouped thousands and up to two decimals, as 1.234,5; a dash for null.  What rounds to nothing from below keeps its sign, as -0."""
    fixed = F.translate(F.format_number(F.abs(F.round(c, 2)), 2), ",.", ".,")
    fixed = F.when(c.cast("string").startswith("-"), F.concat(F.lit("-"), fixed)).otherwise(fixed)
    return F.coalesce(F.regexp_replace(fixed, ",00$|(?<=,[0-9])0$", ""), F.lit("—"))
