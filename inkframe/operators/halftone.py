"""Gray grids: smoothing, block sums, quantising, ordered patterns, bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import coding


def gray_cells(embeddings: DataFrame) -> DataFrame:
    """(vec_id, y, x, value): embeddings clipped to [-4, 4] as whole gray values 0..255."""
    p = embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v"))
    clipped = F.least(F.greatest(F.col("v").cast("double"), F.lit(-4.0)), F.lit(4.0))
    return p.select("vec_id", F.floor(F.col("p") / 8).cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.floor((clipped + 4) * 255 / 8).cast("long").alias("value"))


def prefilter(cells: DataFrame, side: int = 8) -> DataFrame:
    """Sums with the weights 1 2 1 / 2 4 2 / 1 2 1, white outside; each cell gives nine weighted rows, which are added before the shuffle."""
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((2 - abs(dy)) * (2 - abs(dx))).alias("w")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    e = cells.select("vec_id", "y", "x", "value", F.explode(moves).alias("m")).select("vec_id", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), (F.col("value") * F.col("m.w")).alias("v"))
    return e.where(f"y BETWEEN 0 AND {side - 1} AND x BETWEEN 0 AND {side - 1}").groupBy("vec_id", "y", "x").agg(F.sum("v").alias("sum16"))


def decimate(cells: DataFrame, m: int = 4) -> DataFrame:
    return cells.groupBy("vec_id", F.floor(F.col("y") / m).cast("long").alias("gy"), F.floor(F.col("x") / m).cast("long").alias("gx")).agg(F.sum("value").alias("total"))


def quantize(blocks: DataFrame, m: int = 4, levels: int = 16) -> DataFrame:
    """Block sums to 0..levels - 1, rounded half up."""
    return blocks.withColumn("gray", F.floor(F.col("total") * (levels - 1) / F.lit(255 * m * m) + 0.5).cast("long"))


def planes(gray: DataFrame, bits: int = 4) -> DataFrame:
    """(..., plane, bit, gray_bit): each value's bits, plain and in Gray code."""
    g = gray.withColumn("code", F.col("gray").bitwiseXOR(F.shiftright("gray", 1)))
    e = g.withColumn("plane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits - 1).cast("long"))))
    bit = lambda c: (F.expr(f"shiftright({c}, CAST(plane AS INT))") % 2).cast("long")
    return e.select("vec_id", "gy", "gx", "plane", bit("gray").alias("bit"), bit("code").alias("gray_bit"))


def bayer(x, y):
    """Threshold 0..63 of an ordered 8 x 8 matrix, from the bits of x and y."""
    out = 0
    for i in range(3):
        a, b = (x >> i) & 1, (y >> i) & 1
        out |= ((a ^ b) << 1 | b) << (2 * (2 - i))
    return out


def patterns(spark: SparkSession, m: int = 4, levels: int = 16) -> DataFrame:
    """(i, y, x, black): pattern i has its darkest pixels by an ordered matrix; the table's size depends on the parameters alone."""
    rows = [(i, y, x, int(i * 255 // (levels - 1) > bayer(x, y) * 255 // 63)) for i in range(levels) for y in range(m) for x in range(m)]
    return spark.createDataFrame(rows, "i long, y long, x long, black long")


#: The neighbours that get a cell's error, (dy, dx, weight of 42).
SPREAD = [(0, 1, 8), (0, 2, 4), (1, -2, 2), (1, -1, 4), (1, 0, 8), (1, 1, 4), (1, 2, 2), (2, -2, 1), (2, -1, 2), (2, 0, 4), (2, 1, 2), (2, 2, 1)]


def diffuse(value: np.ndarray, levels: int, sharpen: float) -> np.ndarray:
    """Whole levels of n grids of one size, cell by cell in row order for all of them at once.

    A cell is sharpened by ``sharpen`` times the error of the cell before it, rounded half up within the levels, and hands its error on.
    """
    value, (n, h, w) = value.copy(), value.shape
    out, error = np.zeros(value.shape, np.int64), np.zeros(n)
    for y in range(h):
        for x in range(w):
            own = value[:, y, x] - sharpen * error
            out[:, y, x] = q = np.clip(np.floor(own + 0.5), 0, levels - 1)
            error = own - q
            for dy, dx, weight in SPREAD:
                if y + dy < h and 0 <= x + dx < w:
                    value[:, y + dy, x + dx] += error * weight / 42
    return out


def error_diffusion(blocks: DataFrame, m: int = 4, levels: int = 16, sharpen: float = 0.5) -> DataFrame:
    """(vec_id, gy, gx, gray): block sums quantised with error diffusion; grids of one size in a batch go together."""
    cells = F.array_sort(F.collect_list(F.struct("gy", "gx", "total")))
    grids = blocks.groupBy("vec_id").agg(cells.alias("cells"))

    def run(batches):
        for batch in batches:
            held = batch.column("cells")
            size = np.diff(held.offsets.to_numpy())
            gy, gx, total = (held.flatten().field(i).to_numpy() for i in range(3))
            owner, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            wide = np.maximum.reduceat(gx, start) + 1 if len(size) else size
            gray = np.zeros(len(total), np.int64)
            for shape in np.unique(np.stack([size, wide], 1), axis=0):
                mine = np.flatnonzero((size == shape[0]) & (wide == shape[1]))
                at = (start[mine][:, None] + np.arange(shape[0])).ravel()
                value = total[at] * (levels - 1) / (255 * m * m)
                gray[at] = diffuse(value.reshape(len(mine), -1, shape[1]), levels, sharpen).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(owner)), pa.array(gy), pa.array(gx), pa.array(gray)], names=["vec_id", "gy", "gx", "gray"])

    return grids.mapInArrow(run, "vec_id long, gy long, gx long, gray long")


def depth(gray: DataFrame) -> DataFrame:
    """(vec_id, top, bits): the greatest value of each grid and the bits that it takes, one at least."""
    g = gray.groupBy("vec_id").agg(F.max("gray").alias("top"))
    return g.withColumn("bits", F.length(F.bin(F.greatest("top", F.lit(1)))).cast("long"))


def strip(patterns_: DataFrame, m: int = 4) -> DataFrame:
    """(y, x, black): all patterns side by side."""
    return patterns_.select("y", (F.col("x") + F.col("i") * m).alias("x"), "black")


def smoothed(cells: DataFrame, side: int = 8) -> DataFrame:
    """The cells after :func:`prefilter`, as sixteenths rounded down to whole values."""
    return prefilter(cells, side).select("vec_id", "y", "x", F.floor(F.col("sum16") / 16).cast("long").alias("value"))


def encode(cells: DataFrame, m: int = 4, levels: int = 16, sharpen: float = 0.5) -> DataFrame:
    """(vec_id, grid_width, grid_height, bits, payload): gray cells smoothed, summed by blocks, quantised, and their Gray-coded bit planes coded from the top."""
    gray = error_diffusion(decimate(smoothed(cells), m), m, levels, sharpen)
    grids = gray.groupBy("vec_id").agg((F.max("gx") + 1).alias("grid_width"), (F.max("gy") + 1).alias("grid_height"), F.transform(F.array_sort(F.collect_list(F.struct("gy", "gx", "gray"))), lambda c: c["gray"]).alias("gray"))
    bits = max((levels - 1).bit_length(), 1)

    def run(batches):
        for batch in batches:
            out = []
            for w, h, values in zip(*(batch.column(c).to_pylist() for c in ("grid_width", "grid_height", "gray"))):
                v = np.array(values).reshape(h, w)
                e = coding.Encoder()
                for plane in range(bits - 1, -1, -1):
                    e.bitmap((v ^ v >> 1) >> plane & 1 == 1)
                out.append(e.finish())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "grid_width", "grid_height")), pa.array([bits] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "grid_width", "grid_height", "bits", "payload"])

    return grids.mapInArrow(run, "vec_id long, grid_width long, grid_height long, bits long, payload binary")


def decode(coded: DataFrame) -> DataFrame:
    """(vec_id, gy, gx, gray) of coded grids."""

    def run(batches):
        for batch in batches:
            for i, (w, h, bits, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grid_width", "grid_height", "bits", "payload")))):
                d, above, gray = coding.Decoder(data), np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
                for _ in range(bits):
                    above = d.bitmap(w, h) ^ above
                    gray = gray << 1 | above
                y, x = np.indices((h, w)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.full(h * w, i))), *map(pa.array, (y, x, gray.ravel()))], names=["vec_id", "gy", "gx", "gray"])

    return coded.select("vec_id", "grid_width", "grid_height", "bits", "payload").mapInArrow(run, "vec_id long, gy long, gx long, gray long")
