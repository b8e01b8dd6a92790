"""Sequences of symbols on pages: deltas, regions, integer ranges and contexts, as they are coded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the integer code of ISO/IEC 14492 annex A: (least magnitude, greatest, prefix bits, value bits).
RANGES = [(0, 3, 2, 2), (4, 19, 3, 4), (20, 83, 4, 6), (84, 339, 5, 8), (340, 4435, 6, 12), (4436, 2_000_000_000, 6, 32)]


def range_class(v: Column) -> tuple[Column, Column]:
    """(class, bits) of an integer: sign bit, prefix and value; null above the greatest magnitude."""
    kind = bits = None
    for i, (low, high, prefix, size) in enumerate(RANGES):
        hit = F.abs(v).between(low, high)
        kind = F.when(hit, i) if kind is None else kind.when(hit, i)
        bits = F.when(hit, prefix + size) if bits is None else bits.when(hit, prefix + size)
    return kind.cast("long"), bits.cast("long")


def symbol_deltas(boxes: DataFrame) -> DataFrame:
    """Width differences within each height, in the order of a symbol dictionary; the first of a class is absolute."""
    w = Window.partitionBy("height").orderBy("width", "vec_id")
    return boxes.select("vec_id", "height", "width", (F.col("width") - F.lag("width", 1, 0).over(w)).cast("long").alias("delta_width"))


def instance_deltas(instances: DataFrame, page: str, seq: list[str], x: str, y: str) -> DataFrame:
    """Coordinates as they are coded: x against the instance before (the first absolute), y against the page's first."""
    w = Window.partitionBy(page).orderBy(*seq)
    return instances.select(page, *seq, (F.col(x) - F.lag(x, 1, 0).over(w)).cast("long").alias("delta_s"), (F.col(y) - F.first(y).over(w)).cast("long").alias("delta_t"))


def region_bounds(instances: DataFrame, page: str, x: str, y: str, width: str, height: str) -> DataFrame:
    r = instances.groupBy(page).agg(F.min(x).alias("x"), F.min(y).alias("y"), F.max(F.col(x) + F.col(width)).alias("r"), F.max(F.col(y) + F.col(height)).alias("b"), F.count("*").alias("instances"))
    return r.select(page, "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"), "instances")


def dangling(instances: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Instances whose template isn't in the dictionary."""
    return instances.join(templates, key, "left_anti")


def contexts(rows: list[Column]) -> Column:
    """Array of the 16-pixel causal context of each of 8 x 8 pixels: 5 pixels two rows up, 7 one row up, 4 before it."""
    blank = F.lit(0)
    out = []
    for y in range(8):
        up2, up1, own = (rows[y - 2] if y > 1 else blank), (rows[y - 1] if y else blank), rows[y]
        for x in range(8):
            # bits x - k .. x + k of an 8-bit row; outside is white
            def bits(row: Column, first: int, last: int) -> Column:
                moved = F.shiftright(row, 7 - last) if last <= 7 else F.shiftleft(row, last - 7)
                return moved.bitwiseAND(F.lit((1 << (last - first + 1)) - 1))

            out.append((F.shiftleft(bits(up2, x - 2, x + 2), 11) + F.shiftleft(bits(up1, x - 3, x + 3), 4) + bits(own, x - 4, x - 1)).cast("long"))
    return F.array(*out)
