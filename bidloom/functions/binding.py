"""Values that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it; a plain column would be worked out anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
