"""Bitmaps of any size as columns: width, height and ``words``, 32 pixels each, rows padded, leftmost pixel in the highest bit.

Everything here is an expression or an aggregation; pixels outside a bitmap read as white.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.operators import raster

#: Greatest width and height.
MOST = 1 << 24
#: Greatest unsigned 32-bit integer; a rectangle without bounds has it as width and height.
U32 = (1 << 32) - 1


def stride(width: Column) -> Column:
    """Words of a row."""
    return F.floor((width + 31) / 32).cast("int")


def in_bounds(width: Column, height: Column) -> Column:
    return width.between(1, MOST) & height.between(1, MOST)


def blank(width: Column, height: Column) -> Column:
    """Words of a white bitmap; null where a side is out of bounds."""
    return F.when(in_bounds(width, height), F.array_repeat(F.lit(0).cast("long"), (stride(width) * height).cast("int")))


def get(words: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """0 or 1; any place outside is 0, negative ones too."""
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    word = F.get(words, (y * stride(width) + F.floor(x / 32)).cast("int"))
    return F.when(inside, F.call_function("shiftright", word, (31 - x % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))


def put(words: Column, width: Column, x: Column, y: Column, black: Column) -> Column:
    """The words with one pixel set; places outside change nothing."""
    at = (y * stride(width) + F.floor(x / 32)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (31 - x % 32).cast("int"))
    inside = (x >= 0) & (x < width) & (y >= 0)
    return F.transform(words, lambda w, i: F.when((i == at) & inside, F.when(black, w.bitwiseOR(bit)).otherwise(w.bitwiseAND(F.bitwise_not(bit)))).otherwise(w))


def count_ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def first_black(words: Column, width: Column) -> Column:
    """struct(y, x) of the first black pixel in row order, from the leading zeros of the first word that isn't blank; null if blank."""
    first = F.array_position(F.transform(words, lambda w: w != 0), F.lit(True)) - 1
    word = F.get(words, first.cast("int"))
    zeros = 32 - F.length(F.bin(word))
    y = F.floor(first / stride(width))
    return F.when(first >= 0, F.struct(y.cast("long").alias("y"), ((first % stride(width)) * 32 + zeros).cast("long").alias("x")))


def row_bytes(words: Column, width: Column, height: Column) -> Column:
    """Rows padded to bytes, as hexadecimal."""
    every = F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 8, "0")), "")
    row = stride(width) * 8
    kept = (F.floor((width + 7) / 8) * 2).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), (height - 1).cast("int")), lambda y: F.substring(every, y * row + 1, kept)), "")


def from_bits(width: Column, height: Column, bits: Column) -> Column:
    """Words from a string of 0 and 1, row after row without padding; an error unless it has width * height of them."""
    n = stride(width)
    row = lambda y: F.rpad(F.substring(bits, (y * width + 1).cast("int"), width.cast("int")), (n * 32).cast("int"), "0")
    word = lambda y, i: F.conv(F.substring(row(y), (i * 32 + 1).cast("int"), F.lit(32)), 2, 10).cast("long")
    rows = F.transform(F.sequence(F.lit(0), (height - 1).cast("int")), lambda y: F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(y, i)))
    return F.when(F.length(bits) == width * height, F.flatten(rows)).otherwise(F.raise_error(F.lit("bits don't fill the bitmap")).cast("array<bigint>"))


def from_bytes(width: Column, height: Column, data: Column) -> Column:
    """Words from bytes of 8 pixels without row padding; an error unless they are as many as the pixels need."""
    n = F.floor((width * height + 7) / 8)
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")), 8, "0")), "")
    whole = F.substring(bits, F.lit(1), (width * height).cast("int"))
    return F.when(F.octet_length(data) == n, from_bits(width, height, whole)).otherwise(F.raise_error(F.lit("bytes don't fill the bitmap")).cast("array<bigint>"))


def input_kind(width: Column, height: Column, length: Column) -> Column:
    """What a buffer of so many bytes, one per pixel, is: ok, packed (8 pixels in each byte), short or long."""
    need = width * height
    return F.when(length == need, "ok").when(length == F.floor((need + 7) / 8), "packed").when(length < need, "short").otherwise("long")


def u32(value: Column) -> Column:
    """The value as an unsigned 32-bit one; null where it doesn't fit."""
    return F.when(value.between(0, U32), value.cast("long"))


def infinite() -> Column:
    """The rectangle that every other one lies in."""
    return F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("x", 0), ("y", 0), ("width", U32), ("height", U32))))


def sub_images(black: DataFrame, rects: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, width, height, words) of a rectangle (key, x0, y0, width, height) of each page; what lies outside the page is white.

    A join on the page with the clipped pixels rebased to the corner; pages without a black pixel inside stay, blank.
    """
    b = black.select(F.col(key).alias("_k"), "x", "y")
    inside = (F.col(key) == F.col("_k")) & F.col("x").between(F.col("x0"), F.col("x0") + F.col("width") - 1) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("height") - 1)
    at = (F.col("y") - F.col("y0")) * stride(F.col("width")) + F.floor((F.col("x") - F.col("x0")) / 32)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (31 - (F.col("x") - F.col("x0")) % 32).cast("int"))
    cells = rects.join(b, inside, "left").groupBy(key, "x0", "y0", "width", "height", at.cast("int").alias("at")).agg(F.bit_or(bit).alias("word"))
    held = cells.groupBy(key, "x0", "y0", "width", "height").agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "word")))).alias("m"))
    words = F.transform(blank(F.col("width"), F.col("height")), lambda z, i: F.coalesce(F.element_at("m", i), z))
    return held.select(key, "x0", "y0", "width", "height", words.alias("words"))


def crop(black: DataFrame, rects: DataFrame, sizes: DataFrame, key: str = "vec_id") -> DataFrame:
    """:func:`sub_images` of rectangles that must lie inside their page's (key, page_width, page_height); an error otherwise."""
    fits = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + F.col("width") <= F.col("page_width")) & (F.col("y0") + F.col("height") <= F.col("page_height"))
    checked = rects.join(sizes, key).withColumn("width", F.when(fits, F.col("width")).otherwise(F.raise_error(F.lit("the rectangle leaves the page")).cast("long")))
    return sub_images(black, checked.drop("page_width", "page_height"), key)


def trim(black: DataFrame, key: str = "vec_id") -> DataFrame:
    """Each page cut to the tight box of its black pixels; blank pages have none."""
    return sub_images(black, raster.boxes(black, key).select(key, "x0", "y0", "width", "height"), key)
