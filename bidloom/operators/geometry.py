"""Operators over boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import geometry


def not_covered(boxes: DataFrame, others: DataFrame, keys: list[str], share: float = 0.35) -> DataFrame:
    """Boxes of a page that no other box there covers by ``share`` of their area: an anti join within the page."""
    o = others.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("box").alias("_box"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return boxes.join(o, [*same, geometry.overlap_share(F.col("box"), F.col("_box")) >= share], "left_anti")


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(geometry.union_box(F.col("box")).alias("box"))
