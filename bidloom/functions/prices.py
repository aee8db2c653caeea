"""Unit price, total and price basis that a block of an offer's text states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions import numbers

# How prices and price bases are written.
MONEY = r"\d{1,3}(?:\.\d{3})*,\d{2}"
AMOUNT = r"\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:[.,]\d+)?"
NET, UNIT_WORDS, TOTAL_WORDS = r"(?iu)\bPositionsnetto\b", "EP|E-Preis|Einzelpreis", "GP|Gesamtpreis"
LEADING = rf"^\s*-?{MONEY}(?:\s+-?{MONEY})?"
BASIS_WORDS = r"(?iu)(?:\b(?:Einzelpreis|Preise?|EP)\s+(?:je|pro)|(?:EUR|€)\s*/|(?:^|\n|\()\s*per)\s*([^\s)]+)"
BASIS_TOKEN = r"(?iu)^(\d{1,3}(?:\.\d{3})*(?:,0+)?|\d+)(?:Stück|Stk|Std|Stunden?|St|m[23²³]?|kg|Tage?|h|d)?$"
MOST = 1_000_000


def _amounts(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"\b({MONEY})\b"), F.lit(1)), numbers.strict_number)


def _last_two(values: Column, unit_at: int) -> Column:
    """Two amounts are unit price and total, one is a total."""
    return F.struct(F.when(F.size(values) >= 2, F.try_element_at(values, F.lit(unit_at))).alias("unit_price"), F.try_element_at(values, F.lit(-1)).alias("total_price"))


def stated_prices(text: Column) -> Column:
    """struct<unit_price, total_price>: a position's net prices before prices with a word for them, and these before price columns at the start."""
    c = F.coalesce(text, F.lit(""))
    after_net = F.get(F.split(c, NET, 2), F.lit(1))
    word = lambda words: F.regexp_extract(c, rf"(?iu)\b(?:{words})\s*[:.]?\s*({AMOUNT})", 1)
    unit, total = word(UNIT_WORDS), word(TOTAL_WORDS)
    named = F.struct(numbers.strict_number(F.nullif(unit, F.lit(""))).alias("unit_price"), numbers.strict_number(F.nullif(total, F.lit(""))).alias("total_price"))
    net = F.transform(F.array(F.slice(_amounts(after_net), 1, 2)), lambda v: _last_two(v, 1))[0]
    columns = F.transform(F.array(_amounts(F.regexp_extract(c, LEADING, 0))), lambda v: _last_two(v, -2))[0]
    return F.when(after_net.isNotNull(), net).when((unit != "") | (total != ""), named).otherwise(columns)


def stated_basis(text: Column) -> Column:
    """struct<stated, basis>: whether a price basis stands in the text, and which; null where one is unreadable or several differ."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BASIS_WORDS), F.lit(1))
    values = F.transform(tokens, lambda t: numbers.strict_number(F.nullif(F.regexp_extract(t, BASIS_TOKEN, 1), F.lit(""))))
    fine = F.forall(values, lambda v: F.coalesce((v > 0) & (v <= MOST), F.lit(False)))
    one = F.when(fine & (F.size(F.array_distinct(values)) == 1), F.get(values, F.lit(0)))
    return F.struct((F.size(tokens) > 0).alias("stated"), one.alias("basis"))
