"""Connected components and what is told from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def components_kernel(embeddings: DataFrame, threshold: float = 0.0, diagonal: bool = True) -> DataFrame:
    """(vec_id, comp, x, y, width, height, n) of the 8-connected components of small glyphs: union-find within a batch.

    A component's number is the place of its first pixel in row order. Components never cross glyphs, so no shuffle.
    """
    import numpy as np
    import pyarrow as pa

    steps = [(0, -1), (-1, 0), *([(-1, -1), (-1, 1)] if diagonal else [])]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(float)
            side = int(v.shape[1] ** 0.5)
            black = (v > threshold).reshape(len(v), side, side)
            big = side * side
            label = np.where(black, np.arange(big).reshape(side, side), big)
            while True:  # spread the least number to all neighbours, for every glyph at once
                new = label.copy()
                for dy, dx in [*steps, *((-a, -b) for a, b in steps)]:
                    to = (slice(None), slice(max(dy, 0), side + min(dy, 0)), slice(max(dx, 0), side + min(dx, 0)))
                    of = (slice(None), slice(max(-dy, 0), side + min(-dy, 0)), slice(max(-dx, 0), side + min(-dx, 0)))
                    new[to] = np.minimum(new[to], label[of])
                new = np.where(black, new, big)
                if (new == label).all():
                    break
                label = new
            g, y, x = np.nonzero(black)
            key = g * big + label[g, y, x]
            comp, inv, n = np.unique(key, return_inverse=True, return_counts=True)
            low, high = (np.full((len(comp), 2), s, np.int64) for s in (big, -1))
            for i, c in enumerate((x, y)):
                np.minimum.at(low[:, i], inv, c)
                np.maximum.at(high[:, i], inv, c)
            ids = batch.column("vec_id").to_numpy()[comp // big]
            columns = [ids, comp % big, low[:, 0], low[:, 1], high[:, 0] - low[:, 0] + 1, high[:, 1] - low[:, 1] + 1, n]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["vec_id", "comp", "x", "y", "width", "height", "n"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, comp long, x long, y long, width long, height long, n long")


def upper_median(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Element floor(n / 2) from 0 of each sorted value. Unlike a median, it is always one of the values."""
    out = None
    for v in values:
        w = Window.partitionBy(key)
        m = df.select(key, v, F.row_number().over(w.orderBy(v)).alias("_i"), F.count("*").over(w).alias("_of")).where("_i = floor(_of / 2) + 1").select(key, F.col(v).alias(f"median_{v}"))
        out = m if out is None else out.join(m, key)
    return out


def dots(comp: DataFrame, key: str = "vec_id", size_ratio: float = 0.5, height_ratio: float = 0.5) -> DataFrame:
    """Components small against their page's upper medians, and about as wide as high."""
    m = upper_median(comp, key, "n", "height")
    j = comp.join(m, key)
    aspect = F.col("width") / F.col("height")
    small = (F.col("n") <= F.floor(F.col("median_n") * size_ratio)) & (F.col("height") <= F.floor(F.col("median_height") * height_ratio))
    return j.where(small & (aspect >= 0.5) & (aspect <= 2)).select(*comp.columns)


def merge_distance(comp: DataFrame, key: str = "vec_id", first: int = 10, pages: DataFrame | None = None) -> DataFrame:
    """How far below a dot its base may begin: from mean and deviation of the first components' heights, within 5 and 30; 10 for one of ``pages`` without components."""
    w = Window.partitionBy(key).orderBy("y", "x", "comp")
    top = comp.withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    d = top.groupBy(key).agg(F.avg("height").alias("mean"), F.stddev_pop("height").alias("sd"))
    raw = F.floor(F.round(0.6 * F.col("mean") + 0.5 * F.col("sd"), 9))
    out = d.select(key, F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.least(F.greatest(raw, F.lit(5)), F.lit(30)).cast("long").alias("distance"))
    return out if pages is None else pages.select(key).join(out, key, "left").withColumn("distance", F.coalesce("distance", F.lit(10).cast("long")))


def nearest_base(dot: DataFrame, base: DataFrame, key: str = "vec_id", most: int = 5) -> DataFrame:
    """(key, dot, base, gap): each dot's nearest component below it whose width, one more on each side, holds the dot's centre."""
    d = dot.select(key, F.col("comp").alias("dot"), (F.col("x") + F.floor(F.col("width") / 2)).alias("centre"), (F.col("y") + F.col("height")).alias("bottom"))
    b = base.select(key, F.col("comp").alias("base"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("width").alias("bw"))
    j = d.join(b, key).where("base != dot AND by >= bottom AND by - bottom <= %d AND centre BETWEEN bx - 1 AND bx + bw" % most)
    best = j.groupBy(key, "dot").agg(F.min(F.struct((F.col("by") - F.col("bottom")).alias("gap"), "base")).alias("m"))
    return best.select(key, "dot", F.col("m.base").alias("base"), F.col("m.gap").cast("long").alias("gap"))


def column_gaps(black: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, gap_x, gap_width, cut): the widest run of white columns between black ones, and where it would be cut."""
    c = black.select(key, "x").distinct()
    w = Window.partitionBy(key).orderBy("x")
    g = c.withColumn("gap_width", F.lead("x").over(w) - F.col("x") - 1).where("gap_width > 0")
    best = g.groupBy(key).agg(F.max(F.struct("gap_width", (-F.col("x")).alias("nx"))).alias("m"))
    x = -F.col("m.nx") + 1
    return best.select(key, x.cast("long").alias("gap_x"), F.col("m.gap_width").cast("long").alias("gap_width"), (x + F.floor(F.col("m.gap_width") / 2)).cast("long").alias("cut"))
