"""Hierarchical position references (1.2.30, ranges 1.2.10-30) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.binding import once


def _parts(c: Column) -> Column:
    """Numbers of a dotted reference without leading zeros."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("bigint").cast("string"))


def normalize_reference(c: Column) -> Column:
    """Two to eight levels, zeros stripped, an end of the same parent as '-end'; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[.,;:]+$", ""), "[–—]", "-")
    dotted = lambda t: F.when(t.rlike(r"^[0-9]+-[0-9]+-[0-9]+$"), F.replace(t, F.lit("-"), F.lit("."))).otherwise(F.regexp_replace(F.regexp_replace(t, r"\s*\.\s*", "."), r"(?<=[0-9])\s+(?=[0-9])", "."))
    valid = lambda d: d.rlike(r"^[0-9]{1,15}(?:\.[0-9]{1,15}){1,7}(?:\s*-\s*[0-9]{1,15}(?:\.[0-9]{1,15})*)?$")
    parent = lambda x: F.slice(x, F.lit(1), F.size(x) - 1)

    def joined(sides: Column) -> Column:
        start, end = sides[0], F.get(sides, F.lit(1))
        bad_end = (F.size(end) > 1) & ((F.size(end) != F.size(start)) | (parent(end) != parent(start)))
        first = F.array_join(start, ".")
        return F.when(F.size(sides) == 1, first).when(~F.coalesce(bad_end, F.lit(False)), F.concat(first, F.lit("-"), F.element_at(end, -1)))

    return once(once(plain, dotted), lambda d: F.when(valid(d), once(F.transform(F.split(d, r"\s*-\s*"), _parts), joined)))


def parse_reference(normalized: Column) -> Column:
    """struct<prefix, first, last> of a normalised reference; null of null."""
    sides = F.split(normalized, "-")
    start = F.split(F.get(sides, F.lit(0)), r"\.")
    a = F.element_at(start, -1).try_cast("bigint")
    b = F.coalesce(F.get(sides, F.lit(1)).try_cast("bigint"), a)
    prefix = F.array_join(F.slice(start, F.lit(1), F.size(start) - 1), ".")
    return F.when(normalized.isNotNull(), F.struct(prefix.alias("prefix"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))


_NUMBER, _BETWEEN = "([0-9]+)", r"\s*[.\s]\s*"
_TRIPLE = _BETWEEN.join([_NUMBER] * 3)
_SPAN = rf"(?i){_TRIPLE}\s*(?:-|bis)\s*(?:{_NUMBER}{_BETWEEN}{_NUMBER}{_BETWEEN})?{_NUMBER}"
_SINGLE = rf"(?:^|[(:\s]){_TRIPLE}(?:\.|\s|$)"


def has_basis_reference(c: Column) -> Column:
    """Whether ``basis_reference`` finds one in a line."""
    return c.rlike(_SPAN) | c.rlike(_SINGLE)


def basis_reference(c: Column) -> Column:
    """The first three-level reference in a line of text: a range (1.2.10-30, 1.2.10 bis 1.2.30) before a single one; null where there is none."""
    span, single = _SPAN, _SINGLE

    def levels(pattern: str, *groups: int) -> Column:
        return F.array_join(F.array(*(F.regexp_extract(c, pattern, k).try_cast("bigint").cast("string") for k in groups)), ".")

    of_other_parent = F.regexp_extract(c, span, 4) != ""
    end = F.when(of_other_parent, levels(span, 4, 5, 6)).otherwise(levels(span, 1, 2, 6))
    return F.when(c.rlike(span), F.concat(levels(span, 1, 2, 3), F.lit("-"), end)).when(c.rlike(single), levels(single, 1, 2, 3))


def effective_references(source: Column, supplier: Column) -> Column:
    """The source reference alone where it is one; else the supplier's where that is one."""
    s, o = normalize_reference(source), normalize_reference(supplier)
    return F.when(s.isNotNull(), F.array(s)).otherwise(F.array_compact(F.array(o)))


def version_key(c: Column, levels: int = 8) -> Column:
    """Sort key of natural order: the numbers, missing levels as 0."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), levels)), 1, levels)
