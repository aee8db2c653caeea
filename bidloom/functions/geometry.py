"""Boxes in page coordinates (0 to 1) as column expressions over x, y, width, height structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


EPSILON = 2.220446049250313e-16


def region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def from_transform(m: Column, width: Column, page_width: Column, page_height: Column) -> Column:
    """Normalised box of a text item with an affine matrix [a, b, c, d, e, f] in points, origin at the bottom left."""
    height = F.hypot(F.get(m, F.lit(2)), F.get(m, F.lit(3)))
    left, top = clamp(F.get(m, F.lit(4)) / page_width), clamp((page_height - F.get(m, F.lit(5)) - height) / page_height)
    return region(left, top, F.least(width / page_width, 1 - left), F.least(height / page_height, 1 - top))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once."""
    return F.transform(F.array(value), f)[0]


def _at(m: Column, k: int) -> Column:
    return F.get(m, F.lit(k)).cast("double")


def _vector(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return _at(m, 0) * x + _at(m, 2) * y, _at(m, 1) * x + _at(m, 3) * y


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return out


def item_region(content: Column, m: Column, width: Column, height: Column, viewport: Column, page_width: Column, page_height: Column) -> Column:
    """Normalised box round the four corners of a text item, seen through the page's viewport matrix; rotation and shear included.

    m and viewport are [a, b, c, d, e, f].  Null for blank items, pages or
    items without size, matrices that are short or not finite, and boxes of no area.
    """
    along, up = F.hypot(_at(m, 0), _at(m, 1)), F.hypot(_at(m, 2), _at(m, 3))
    tall = F.greatest(F.when(_finite(height), height.cast("double")).otherwise(0.0), up, F.lit(1.0))
    right = _vector(viewport, _at(m, 0) / along * width, _at(m, 1) / along * width)
    square = (-_at(m, 1) / along * tall, _at(m, 0) / along * tall)  # upright on the baseline, where the matrix has no height of its own
    own = (_at(m, 2) / F.nullif(up, F.lit(0.0)) * tall, _at(m, 3) / F.nullif(up, F.lit(0.0)) * tall)
    rise = _vector(viewport, *(F.when(up > EPSILON, a).otherwise(b) for a, b in zip(own, square)))
    origin = tuple(a + b for a, b in zip(_vector(viewport, _at(m, 4), _at(m, 5)), (_at(viewport, 4), _at(viewport, 5))))
    sound = (F.trim(content) != "") & _finite(page_width, page_height, width) & (page_width > 0) & (page_height > 0) & (width > 0)
    sound = sound & _finite(*(_at(m, k) for k in range(6)), *(_at(viewport, k) for k in range(6))) & (along > EPSILON)
    box = F.struct(*(c.alias(n) for n, c in zip(["ox", "oy", "rx", "ry", "ux", "uy"], [*origin, *right, *rise])))

    def spanned(c: Column) -> Column:
        ends = []
        for axis, size in (("x", page_width), ("y", page_height)):
            corners = [c["o" + axis], c["o" + axis] + c["r" + axis], c["o" + axis] + c["u" + axis], c["o" + axis] + c["r" + axis] + c["u" + axis]]
            ends += [clamp(F.least(*corners) / size).alias(axis), clamp(F.greatest(*corners) / size).alias(axis + "_end")]
        return F.struct(*ends)

    def held(e: Column) -> Column:
        return F.when((e["x_end"] - e["x"] > 0) & (e["y_end"] - e["y"] > 0), region(e["x"], e["y"], e["x_end"] - e["x"], e["y_end"] - e["y"]))

    return F.when(sound, _bound(_bound(box, spanned), held))


def recognised_item(x0: Column, y0: Column, x1: Column, y1: Column, image_width: Column, image_height: Column, viewport: Column, page_width: Column, page_height: Column) -> Column:
    """struct<width, height, transform> of a recognised word's box in image pixels: the item whose region, seen through the viewport, is that box.

    The viewport matrix is inverted; null where it is singular (determinant under
    1e-9), where page or image have no size, or where the box has no area.
    """
    a, b, c, d, e, f = (_at(viewport, k) for k in range(6))
    determinant = a * d - b * c
    across, down = page_width / F.nullif(image_width, F.lit(0.0)), page_height / F.nullif(image_height, F.lit(0.0))
    left, right = F.least(x0, x1) * across, F.greatest(x0, x1) * across
    top, bottom = F.least(y0, y1) * down, F.greatest(y0, y1) * down
    back = lambda x, y: ((d * x - c * y) / F.nullif(determinant, F.lit(0.0)), (a * y - b * x) / F.nullif(determinant, F.lit(0.0)))
    height = bottom - top
    matrix = F.array(*back(F.lit(1.0), F.lit(0.0)), *back(F.lit(0.0), -height), *back(left - e, bottom - f))
    sound = _finite(a, b, c, d, e, f) & (F.abs(determinant) >= 1e-9) & (image_width > 0) & (image_height > 0) & (page_width > 0) & (page_height > 0) & (right > left) & (height > 0)
    return F.when(sound, F.struct((right - left).alias("width"), height.alias("height"), matrix.alias("transform")))


def pad(r: Column, by: float) -> Column:
    x, y = clamp(r["x"] - by), clamp(r["y"] - by)
    return region(x, y, clamp(r["x"] + r["width"] + by) - x, clamp(r["y"] + r["height"] + by) - y)


def is_valid(r: Column) -> Column:
    inside = (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0) & (r["x"] + r["width"] <= 1) & (r["y"] + r["height"] <= 1)
    return F.coalesce(inside, F.lit(False))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's area that b covers."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    area = a["width"] * a["height"]
    return F.when(area > 0, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / area).otherwise(0.0)


def union_box(r: Column) -> Column:
    """Aggregate: the smallest box around all of a group's boxes."""
    x, y = F.min(r["x"]), F.min(r["y"])
    return region(x, y, F.max(r["x"] + r["width"]) - x, F.max(r["y"] + r["height"]) - y)
