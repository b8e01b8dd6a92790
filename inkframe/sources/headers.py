"""Fields of segments as columns of hexadecimal bytes (ITU-T T.88), checks of parameters, and regions of interest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.sources.container import TYPES

#: The usual adaptive pixels of template 0.
AT = [(3, -1), (-3, -1), (2, -2), (-2, -2)]
_AT_HEX = "".join(f"{v & 255:02X}" for xy in AT for v in xy)


@dataclass(frozen=True)
class RegionParameters:
    """Parameters of a generic region or symbol dictionary."""

    template: int = 0
    at: list[tuple[int, int]] = field(default_factory=lambda: list(AT))
    operator: int = 0

    def __post_init__(self) -> None:
        if message := problem(self.template, len(self.at), self.operator):
            raise ValueError(message)


def problem(template: int, at: int, operator: int) -> str | None:
    if not 0 <= template <= 3:
        return "template"
    if at > 4:
        return "adaptive pixels"
    return None if 0 <= operator <= 4 else "operator"


def problem_of(template: Column, at: Column, operator: Column) -> Column:
    """The first parameter that is out of range, or null."""
    return F.when(~template.between(0, 3), "template").when(at > 4, "adaptive pixels").when(~operator.between(0, 4), "operator")


def be(value: Column, size: int) -> Column:
    """The last ``size`` bytes of an integer, highest first, as hexadecimal."""
    return F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)


def varint(value: Column) -> Column:
    """Groups of 7 bits of an unsigned 32-bit integer, lowest first; all but the last have the high bit."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.call_function("shiftright", value, (i * 7).cast("int")))
    live = F.filter(groups, lambda g, i: (i == 0) | (g > 0))
    return F.array_join(F.transform(live, lambda g: be(g.bitwiseAND(F.lit(127).cast("long")) + F.when(g > 127, 128).otherwise(0), 1)), "")


def page_information(width: Column, height: Column, dpi: Column) -> Column:
    metre = F.round(dpi * 10_000 / 254)
    return F.concat(be(width, 4), be(height, 4), be(metre, 4), be(metre, 4), F.lit("010000"))


def _region(width: Column, height: Column, x: Column, y: Column) -> Column:
    return F.concat(be(width, 4), be(height, 4), be(x, 4), be(y, 4))


def generic_region(width: Column, height: Column, x: Column, y: Column, operator: Column) -> Column:
    return F.concat(_region(width, height, x, y), be(operator, 1), F.lit("00" + _AT_HEX))


def symbol_dictionary(template: Column, exported: Column, new: Column) -> Column:
    """Flags hold the template in bits 10 and 11; template 0 has four adaptive pixels, the others one."""
    flags = be(template * 1024, 2)
    return F.concat(flags, F.when(template == 0, _AT_HEX).otherwise(_AT_HEX[:4]), be(exported, 4), be(new, 4))


def text_region(width: Column, height: Column, x: Column, y: Column, strips: Column, corner: Column, offset: Column, instances: Column) -> Column:
    """Arithmetic coding without refinement: strip size, reference corner and offset of S in the flags."""
    flags = strips * 4 + corner * 16 + offset.bitwiseAND(F.lit(31)) * 1024
    return F.concat(_region(width, height, x, y), F.lit("00"), be(flags, 2), be(instances, 4))


def halftone_region(width: Column, height: Column, x: Column, y: Column, grid_width: Column, grid_height: Column, side: Column) -> Column:
    """An upright grid of squares: offset of the region within it, and a vector of ``side`` pixels in 1/256."""
    grid = F.concat(be(grid_width, 4), be(grid_height, 4), be(grid_offset(x, side), 4), be(grid_offset(y, side), 4), be(grid_vector(side), 2), F.lit("0000"))
    return F.concat(_region(width, height, x, y), F.lit("0000"), grid)


def grid_offset(at: Column, side: Column) -> Column:
    return at % side


def grid_vector(side: Column) -> Column:
    return side * 256


def segment_head(number: Column, kind: Column, page: Column, refers: Column, length: Column) -> Column:
    """Segment header. Up to 4 references have the short form; more have a 4-byte count and retention bits."""
    n = F.size(refers)
    count = F.when(n <= 4, be(n * 32, 1)).otherwise(F.concat(be(F.lit(7 << 29) + n, 4), F.repeat(F.lit("00"), F.floor((n + 8) / 8).cast("int"))))
    one = lambda r: F.when(number <= 256, be(r, 1)).when(number <= 65536, be(r, 2)).otherwise(be(r, 4))
    wide = page > 255
    return F.concat(be(number, 4), be(kind + F.when(wide, 64).otherwise(0), 1), count, F.array_join(F.transform(refers, one), ""), F.when(wide, be(page, 4)).otherwise(be(page, 1)), be(length, 4))


def segment_types(spark: SparkSession) -> DataFrame:
    """(code, name) of the types that there are; a table of fixed size."""
    return spark.createDataFrame(sorted(TYPES.items()), "code long, name string")


def decode_types(codes: DataFrame, code: str) -> DataFrame:
    """The rows with the name of their segment type, null for an unknown one."""
    types = segment_types(codes.sparkSession).withColumnRenamed("code", "_code")
    return codes.join(F.broadcast(types), F.col(code) == F.col("_code"), "left").drop("_code")


def regions_of_interest(streams: DataFrame, metadata: DataFrame) -> DataFrame:
    """Streams (page, detection, stream) with their detections in ``metadata`` (page, json), joined by page and place in the list.

    Width, height and resolutions are read from bytes 11 to 27 of a stream; the box falls back to them, resolutions are 72 at least.
    """
    box = "struct<x:double,y:double,width:double,height:double>"
    parsed = metadata.select("page", F.from_json("json", f"struct<detections:array<struct<bbox_pdf:{box}>>>").alias("j"))
    found = parsed.select("page", F.posexplode("j.detections").alias("detection", "d")).select("page", F.col("detection").cast("long").alias("detection"), "d.bbox_pdf")
    number = lambda at: F.conv(F.hex(F.substring("stream", at, 4)), 16, 10).cast("long")
    head = streams.select("page", "detection", *(number(12 + 4 * i).alias(n) for i, n in enumerate(("width", "height", "xres", "yres"))))
    value = lambda n, other: F.coalesce(F.col(f"bbox_pdf.{n}"), other.cast("double")).alias(f"pdf_{n}")
    return head.join(found, ["page", "detection"]).select(
        "page", "detection", "width", "height", *(F.greatest(c, F.lit(72).cast("long")).alias(c) for c in ("xres", "yres")),
        value("x", F.lit(0)), value("y", F.lit(0)), value("width", F.col("width")), value("height", F.col("height")),
    )


def by_page(regions: DataFrame) -> DataFrame:
    """(page, regions, names): how many regions a page has and what draws them, in order."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list("detection")), lambda d: F.concat(F.lit("/Im"), d.cast("string"), F.lit(" Do"))), " ")
    return regions.groupBy("page").agg(F.count("*").alias("regions"), names.alias("names"))


def page_sizes(pages: DataFrame, sizes: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """The pages with the size that ``sizes`` (page, width, height) has for them, or a letter page's."""
    return pages.join(sizes, "page", "left").withColumns({"width": F.coalesce("width", F.lit(width)), "height": F.coalesce("height", F.lit(height))})
