"""Columns for placing coded regions on printed pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dpi(c: Column, default: int = 300, least: int = 0) -> Column:
    """0 or null stands for the default."""
    return F.greatest(F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c), F.lit(least))


def scale(size: Column, pixels: Column, resolution: Column) -> Column:
    """Factor from pixels at a resolution to a box size in points."""
    return size * 72 / (pixels * resolution)


def flipped(page_height: Column, y: Column, height: Column) -> Column:
    """y from the lower edge, as PDF counts."""
    return page_height - y - height


def clamped(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def number_at(json: Column, path: str, default: float = 0.0) -> Column:
    return F.coalesce(F.get_json_object(json, path).try_cast("double"), F.lit(default))
