"""Bilevel rasters: glyphs of 8 x 8 pixels as two 32-bit words, pages as black runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8
MASK = 0xFFFFFFFF


def _word(values: Column, first: int, threshold: float) -> Column:
    return F.aggregate(F.slice(values, first + 1, 32), F.lit(0).cast("long"), lambda s, v: s * 2 + (v > threshold).cast("long"))


def glyphs(embeddings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(vec_id, label, hi, lo): pixels above the threshold are black, packed row by row, leftmost pixel in the highest bit. No shuffle."""
    return embeddings.select("vec_id", F.col("label").cast("long").alias("label"), _word(F.col("embedding"), 0, threshold).alias("hi"), _word(F.col("embedding"), 32, threshold).alias("lo"))


def pixels(embeddings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(vec_id, y, x) of every black pixel."""
    p = embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).where(F.col("v") > threshold)
    return p.select("vec_id", F.floor(F.col("p") / SIDE).cast("long").alias("y"), (F.col("p") % SIDE).cast("long").alias("x"))


def pack_words(black: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, y, w, word): pixels of pages of any width in 32-bit words of padded rows; distinct pixels are assumed."""
    w = F.floor(F.col("x") / 32).cast("long")
    return black.groupBy(key, "y", w.alias("w")).agg(F.sum(F.expr("shiftleft(1L, CAST(31 - x % 32 AS INT))")).alias("word"))


def popcount(*words: str) -> Column:
    total = F.lit(0).cast("long")
    for w in words:
        total = total + F.bit_count(F.col(w))
    return total.cast("long")


def invert(g: DataFrame) -> DataFrame:
    return g.withColumns({w: F.bitwise_not(F.col(w)).bitwiseAND(F.lit(MASK).cast("long")) for w in ("hi", "lo")})


def combine(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """AND, OR and XOR of glyphs of the same size, joined on a key."""
    j = a.select(on, "hi", "lo").join(b.select(on, F.col("hi").alias("bh"), F.col("lo").alias("bl")), on)
    op = lambda f: [getattr(F.col(x), f)(F.col(y)).alias(f"{f[7:].lower()}_{x}") for x, y in (("hi", "bh"), ("lo", "bl"))]
    return j.select(on, *op("bitwiseAND"), *op("bitwiseOR"), *op("bitwiseXOR"))


def boxes(black: DataFrame, key: str = "vec_id") -> DataFrame:
    """Tight bounding box, pixels and first black pixel in row order; a blank page has no row."""
    first = F.min(F.struct("y", "x"))
    out = black.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"), first.alias("f"))
    return out.select(key, "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"), "n", F.col("f.y").alias("first_y"), F.col("f.x").alias("first_x"))


def crop(black: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Pixels inside a rectangle, rebased to its corner; what lies outside reads as white."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return black.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def text_boxes(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page box and pixels from runs; each task adds up its own before the exchange."""
    return runs.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
