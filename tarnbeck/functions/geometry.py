"""Boxes on pages: [x0, y0, x1, y1] in points from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_box(box: Column) -> Column:
    """Four finite numbers in order; null where the box is null."""
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(box.isNotNull(), (F.size(box) == 4) & F.coalesce(finite, F.lit(False)) & F.coalesce((F.try_element_at(box, F.lit(1)) <= F.try_element_at(box, F.lit(3))) & (F.try_element_at(box, F.lit(2)) <= F.try_element_at(box, F.lit(4))), F.lit(False)))


def clip(box: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies on the page."""
    zero = F.lit(0.0)
    return F.array(*(F.least(F.greatest(box[i], zero), limit) for i, limit in enumerate((width, height, width, height))))


def inside(inner: Column, outer: Column) -> Column:
    """Whether a box lies wholly within another."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def reading_order(box: Column) -> list[Column]:
    """Sort keys: from top to bottom, then from left to right, boxes that are not known last."""
    return [box[1].asc_nulls_last(), box[0].asc_nulls_last()]
