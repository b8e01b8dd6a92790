"""All queries of the raster engine, by name, with their SQL twins.

Tables stand in for rasters as follows: embeddings are 8 x 8 glyphs (black above 0), documents are pages of lines,
lineitem rows are instances of templates (parts) on pages (orders), events are sequences of one user each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions import placement
from inkframe.operators import dictionary, halftone, matching, pages, raster, segment, sequence
from inkframe.sources import container
from inkframe.streaming import templates as streams

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "glyph_dictionary_summary"

_PX = "px AS (SELECT vec_id, label, p // 8 AS y, p % 8 AS x, p FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(embedding) AS v, unnest(range(0, 64)) AS p FROM embeddings) WHERE v > 0)"
_G = _PX + """,
bits AS (SELECT vec_id, CAST(sum(CASE WHEN p < 32 THEN CAST(1 AS BIGINT) << CAST(31 - p AS INT) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN p >= 32 THEN CAST(1 AS BIGINT) << CAST(63 - p AS INT) ELSE 0 END) AS BIGINT) AS lo FROM px GROUP BY vec_id),
g AS (SELECT e.vec_id, CAST(label AS BIGINT) AS label, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM embeddings e LEFT JOIN bits USING (vec_id))"""
_BOX = _PX + ",\nbox AS (SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS n FROM px GROUP BY vec_id)"
_CELL = "cell AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, CAST(floor((least(greatest(CAST(v AS DOUBLE), -4.0), 4.0) + 4) * 255 / 8) AS BIGINT) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS p FROM embeddings))"
_BLOCK = _CELL + ", block AS (SELECT vec_id, y // 4 AS gy, x // 4 AS gx, CAST(sum(value) AS BIGINT) AS total FROM cell GROUP BY 1, 2, 3), q AS (SELECT *, CAST(floor(total * 15 / CAST(4080 AS DOUBLE) + 0.5) AS BIGINT) AS gray FROM block)"
_RUN = """line AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
piece AS (SELECT doc_id, y, unnest(s) AS piece, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, y, string_split(line, ' ') AS s FROM line)),
placed AS (SELECT *, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id, y ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x0 FROM piece),
run AS (SELECT doc_id, y, x0, x0 + length(piece) - 1 AS x1 FROM placed WHERE piece <> '')"""
_COMP = "RECURSIVE " + _PX + """,
reach AS (SELECT vec_id, p, p AS r FROM px
  UNION SELECT b.vec_id, b.p, a.r FROM reach a JOIN px b ON a.vec_id = b.vec_id AND a.r < b.p AND abs(a.p // 8 - b.y) <= 1 AND abs(a.p % 8 - b.x) <= 1),
member AS (SELECT vec_id, p, min(r) AS comp FROM reach GROUP BY 1, 2),
comp AS (SELECT vec_id, comp, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) + 1 AS width, max(p // 8) - min(p // 8) + 1 AS height, count(*) AS n FROM member GROUP BY 1, 2),
mid AS (SELECT DISTINCT vec_id, first_value(n) OVER (PARTITION BY vec_id ORDER BY i DESC) AS median_n, first_value(h) OVER (PARTITION BY vec_id ORDER BY i DESC) AS median_height FROM
  (SELECT a.vec_id, a.n, b.height AS h, a.i FROM (SELECT vec_id, n, row_number() OVER (PARTITION BY vec_id ORDER BY n) AS i, count(*) OVER (PARTITION BY vec_id) AS c FROM comp) a
   JOIN (SELECT vec_id, height, row_number() OVER (PARTITION BY vec_id ORDER BY height) AS i FROM comp) b ON a.vec_id = b.vec_id AND a.i = b.i WHERE a.i = a.c // 2 + 1)),
dot AS (SELECT comp.* FROM comp JOIN mid USING (vec_id) WHERE n <= floor(median_n * 0.5) AND comp.height <= floor(median_height * 0.5) AND CAST(width AS DOUBLE) / comp.height BETWEEN 0.5 AND 2)"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _glyphs(spark, sf_dir):
    return raster.glyphs(_t(spark, sf_dir, "embeddings"))


def _black(spark, sf_dir):
    return raster.pixels(_t(spark, sf_dir, "embeddings"))


def _comps(spark, sf_dir):
    return segment.components_kernel(_t(spark, sf_dir, "embeddings"))


def _instances(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", F.col("l_quantity").cast("long").alias("x"), "l_suppkey")


@query(f"WITH {_G} SELECT label, count(*) AS glyphs, CAST(sum(bit_count(hi) + bit_count(lo)) AS BIGINT) AS black, round(avg(bit_count(hi) + bit_count(lo)), 6) AS mean_black, count(DISTINCT (hi, lo)) AS templates FROM g GROUP BY label")
def glyph_dictionary_summary(spark, sf_dir):
    return dictionary.summary(_glyphs(spark, sf_dir))


@query(f"WITH {_PX} SELECT vec_id, y, x FROM px")
def glyph_pixels(spark, sf_dir):
    return _black(spark, sf_dir)


@query(f"WITH {_G} SELECT vec_id, label, hi, lo FROM g")
def glyph_pack_words(spark, sf_dir):
    return _glyphs(spark, sf_dir)


@query(f"WITH {_PX} SELECT vec_id, y, CAST(0 AS BIGINT) AS w, CAST(sum(CAST(1 AS BIGINT) << CAST(31 - x AS INT)) AS BIGINT) AS word FROM px GROUP BY vec_id, y")
def page_pack_rows(spark, sf_dir):
    return raster.pack_words(_black(spark, sf_dir))


@query(f"WITH {_G} SELECT vec_id, CAST(bit_count(hi) + bit_count(lo) AS BIGINT) AS ones, CAST(64 - bit_count(hi) - bit_count(lo) AS BIGINT) AS zeros FROM g")
def glyph_popcount(spark, sf_dir):
    n = raster.popcount("hi", "lo")
    return _glyphs(spark, sf_dir).select("vec_id", n.alias("ones"), (64 - n).cast("long").alias("zeros"))


@query(f"WITH {_G} SELECT vec_id, label, 4294967295 - hi AS hi, 4294967295 - lo AS lo FROM g")
def glyph_invert(spark, sf_dir):
    return raster.invert(_glyphs(spark, sf_dir))


@query(f"WITH {_G} SELECT a.vec_id, a.hi & b.hi AS and_hi, a.lo & b.lo AS and_lo, a.hi | b.hi AS or_hi, a.lo | b.lo AS or_lo, xor(a.hi, b.hi) AS xor_hi, xor(a.lo, b.lo) AS xor_lo FROM g a JOIN g b ON b.vec_id = a.vec_id + 1")
def glyph_and_or_xor(spark, sf_dir):
    g = _glyphs(spark, sf_dir)
    return raster.combine(g, g.withColumn("vec_id", F.col("vec_id") - 1), "vec_id")


@query(f"WITH {_BOX}, f AS (SELECT vec_id, min(p) AS p FROM px GROUP BY vec_id) SELECT box.*, f.p // 8 AS first_y, f.p % 8 AS first_x FROM box JOIN f USING (vec_id)")
def glyph_trim_bbox(spark, sf_dir):
    return raster.boxes(_black(spark, sf_dir))


@query(f"WITH {_PX} SELECT vec_id, y - 3 AS y, x - 2 AS x FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 7")
def glyph_crop(spark, sf_dir):
    return raster.crop(_black(spark, sf_dir), 2, 3, 4, 5)


@query(f"WITH {_RUN} SELECT doc_id, y, x0, x1 FROM run")
def text_runs(spark, sf_dir):
    return pages.runs(_t(spark, sf_dir, "documents"), None)


@query(f"WITH {_RUN} SELECT doc_id, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n FROM run GROUP BY doc_id")
def text_bbox(spark, sf_dir):
    return raster.text_boxes(pages.runs(_t(spark, sf_dir, "documents"), None))


@query(f"WITH {_G} SELECT hi, lo, min(vec_id) AS template_id, count(*) AS usage FROM g GROUP BY hi, lo")
def template_dedup_exact(spark, sf_dir):
    return dictionary.templates(_glyphs(spark, sf_dir))


@query("SELECT l_partkey, count(*) AS usage, count(DISTINCT l_orderkey) AS pages, min(l_orderkey) AS first_page FROM lineitem GROUP BY l_partkey")
def template_usage(spark, sf_dir):
    return dictionary.usage(_instances(spark, sf_dir), "l_partkey", "l_orderkey")


@query("SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS pages FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey")
def template_page_set(spark, sf_dir):
    return dictionary.page_sets(_instances(spark, sf_dir), "l_partkey", "l_orderkey")


@query("SELECT l_suppkey * 100000 + l_partkey AS template, count(*) AS usage, min(l_orderkey) AS first_page, CASE WHEN count(*) > 1 OR (SELECT count(DISTINCT l_orderkey) FROM lineitem) = 1 THEN 'global' ELSE 'local' END AS scope FROM lineitem GROUP BY 1")
def template_scope_global_local(spark, sf_dir):
    i = _instances(spark, sf_dir).withColumn("template", F.col("l_suppkey") * 100000 + F.col("l_partkey"))
    return dictionary.scope(i, "template", "l_orderkey")


@query(f"WITH {_BOX} SELECT height, count(*) AS symbols, CAST(sum(width) AS BIGINT) AS total_width, height - lag(height, 1, 0) OVER (ORDER BY height) AS delta_height FROM box GROUP BY height")
def dictionary_height_classes(spark, sf_dir):
    return dictionary.height_classes(raster.boxes(_black(spark, sf_dir)))


@query(f"WITH {_BOX} SELECT (10 * height + 10000 * width) % 10000000 AS block, count(*) AS n FROM box GROUP BY 1")
def block_key_bucket(spark, sf_dir):
    b = raster.boxes(_black(spark, sf_dir))
    return b.groupBy(dictionary.block_key(F.col("width"), F.col("height")).alias("block")).agg(F.count("*").alias("n"))


@query(f"WITH {_G}, t AS (SELECT min(vec_id) AS vec_id, hi, lo FROM g GROUP BY hi, lo) SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS d FROM t a JOIN t b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 15")
def hamming_pairs(spark, sf_dir):
    return dictionary.hamming_pairs(_glyphs(spark, sf_dir))


@query(f"WITH {_BOX} SELECT a.width, a.height, a.n, CAST(sum(b.n) AS BIGINT) AS partners FROM (SELECT width, height, count(*) AS n FROM box GROUP BY 1, 2) a JOIN (SELECT width, height, count(*) AS n FROM box GROUP BY 1, 2) b ON abs(a.width - b.width) <= 4 AND abs(a.height - b.height) <= 4 GROUP BY 1, 2, 3")
def size_gate_partners(spark, sf_dir):
    return dictionary.size_gate(raster.boxes(_black(spark, sf_dir)))


_SHIFT = f"""WITH {_PX},
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id),
shift AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
moved AS (SELECT a, b, dx, dy, x + dx AS x, y + dy AS y FROM pair JOIN px ON vec_id = a, shift WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7),
fixed AS (SELECT a, b, dx, dy, x, y FROM pair JOIN px ON vec_id = b, shift WHERE y - dy BETWEEN 0 AND 7),
one AS (SELECT a, b, dx, dy, count(*) AS n FROM (SELECT * FROM moved UNION ALL SELECT * FROM fixed) GROUP BY 1, 2, 3, 4),
two AS (SELECT a, b, dx, dy, count(*) AS n FROM moved JOIN fixed USING (a, b, dx, dy, x, y) GROUP BY 1, 2, 3, 4),
err AS (SELECT pair.a, pair.b, shift.dx, shift.dy, coalesce(one.n, 0) - 2 * coalesce(two.n, 0) AS err FROM pair CROSS JOIN shift LEFT JOIN one ON one.a = pair.a AND one.b = pair.b AND one.dx = shift.dx AND one.dy = shift.dy LEFT JOIN two ON two.a = pair.a AND two.b = pair.b AND two.dx = shift.dx AND two.dy = shift.dy),
best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY err, abs(dx) + abs(dy), dy, dx) AS i FROM err)
SELECT a, b, err, dx, dy FROM best WHERE i = 1"""


@query(_SHIFT)
def shifted_distance_pairs(spark, sf_dir):
    """All pairs of glyphs of one label."""
    rows = F.array(*(F.shiftleft(r.cast("long"), 24) for r in dictionary.byte_rows("hi", "lo")))
    g = _glyphs(spark, sf_dir).select("label", F.col("vec_id").alias("id"), F.lit(raster.SIDE).alias("width"), F.lit(raster.SIDE).alias("height"), rows.alias("words"))
    return matching.compare(g, ["label"], gate=None).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "err", "dx", "dy")


@query("SELECT vec_id, comp, x, y, width, height, n FROM (WITH " + _COMP + " SELECT * FROM comp)")
def components_8(spark, sf_dir):
    return _comps(spark, sf_dir)


@query("WITH " + _COMP + " SELECT vec_id, count(*) AS components, CAST(sum(n) AS BIGINT) AS black, max(n) AS largest FROM comp GROUP BY vec_id")
def component_stats(spark, sf_dir):
    return _comps(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("components"), F.sum("n").alias("black"), F.max("n").alias("largest"))


@query("WITH " + _COMP + " SELECT vec_id, median_n, median_height FROM mid")
def upper_median_stats(spark, sf_dir):
    return segment.upper_median(_comps(spark, sf_dir), "vec_id", "n", "height")


@query("WITH " + _COMP + " SELECT vec_id, comp, x, y, width, height, n FROM dot")
def dot_candidates(spark, sf_dir):
    return segment.dots(_comps(spark, sf_dir))


@query("WITH " + _COMP + """, near AS (SELECT d.vec_id, d.comp AS dot, b.comp AS base, b.y - d.y - d.height AS gap, row_number() OVER (PARTITION BY d.vec_id, d.comp ORDER BY b.y - d.y - d.height, b.comp) AS i
  FROM dot d JOIN comp b ON d.vec_id = b.vec_id AND d.comp <> b.comp AND b.y >= d.y + d.height AND b.y - d.y - d.height <= 5 AND d.x + d.width // 2 BETWEEN b.x - 1 AND b.x + b.width)
SELECT vec_id, dot, base, gap FROM near WHERE i = 1""")
def dot_merge_nearest(spark, sf_dir):
    c = _comps(spark, sf_dir)
    return segment.nearest_base(segment.dots(c), c)


@query("WITH " + _COMP + """, top AS (SELECT vec_id, height, row_number() OVER (PARTITION BY vec_id ORDER BY y, x, comp) AS i FROM comp),
d AS (SELECT vec_id, round(avg(height), 6) AS mean, round(stddev_pop(height), 6) AS sd, CAST(least(greatest(floor(round(0.6 * avg(height) + 0.5 * stddev_pop(height), 9)), 5), 30) AS BIGINT) AS distance FROM top WHERE i <= 10 GROUP BY vec_id)
SELECT vec_id, mean, sd, coalesce(distance, 10) AS distance FROM embeddings LEFT JOIN d USING (vec_id)""")
def merge_distance_stats(spark, sf_dir):
    return segment.merge_distance(_comps(spark, sf_dir), pages=_t(spark, sf_dir, "embeddings"))


@query(f"WITH {_PX}, c AS (SELECT DISTINCT vec_id, x FROM px), n AS (SELECT vec_id, x, lead(x) OVER (PARTITION BY vec_id ORDER BY x) - x - 1 AS w FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, x) AS i FROM n WHERE w > 0) SELECT vec_id, x + 1 AS gap_x, w AS gap_width, x + 1 + w // 2 AS cut FROM b WHERE i = 1")
def column_gap_split(spark, sf_dir):
    return segment.column_gaps(_black(spark, sf_dir))


@query(f"WITH {_BOX} SELECT vec_id, height, width, width - lag(width, 1, 0) OVER (PARTITION BY height ORDER BY width, vec_id) AS delta_width FROM box")
def delta_width_height(spark, sf_dir):
    return sequence.symbol_deltas(raster.boxes(_black(spark, sf_dir)))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) - lag(CAST(l_quantity AS BIGINT), 1, 0) OVER w AS delta_s, l_suppkey - first_value(l_suppkey) OVER w AS delta_t FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)")
def instance_delta_s_t(spark, sf_dir):
    return sequence.instance_deltas(_instances(spark, sf_dir), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "x"], "x", "l_suppkey").drop("l_partkey", "l_suppkey", "x")


@query("""WITH d AS (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) - lag(CAST(floor(value * 100) AS BIGINT), 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events),
c AS (SELECT CASE WHEN abs(delta) <= 3 THEN 0 WHEN abs(delta) <= 19 THEN 1 WHEN abs(delta) <= 83 THEN 2 WHEN abs(delta) <= 339 THEN 3 WHEN abs(delta) <= 4435 THEN 4 ELSE 5 END AS class, CASE WHEN abs(delta) <= 3 THEN 4 WHEN abs(delta) <= 19 THEN 7 WHEN abs(delta) <= 83 THEN 10 WHEN abs(delta) <= 339 THEN 13 WHEN abs(delta) <= 4435 THEN 18 ELSE 38 END AS bits FROM d)
SELECT CAST(class AS BIGINT) AS class, count(*) AS n, CAST(sum(bits) AS BIGINT) AS bits FROM c GROUP BY class""")
def int_range_cost(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    delta = F.col("v") - F.lag("v", 1, 0).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind, bits = sequence.range_class(F.col("delta"))
    return e.withColumn("delta", delta).select(kind.alias("class"), bits.alias("bits")).groupBy("class").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


@query("SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS x, min(l_suppkey) AS y, max(CAST(l_quantity AS BIGINT) + p_size) - min(CAST(l_quantity AS BIGINT)) AS width, max(l_suppkey + p_size) - min(l_suppkey) AS height, count(*) AS instances FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def region_bounds(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("size"))
    return sequence.region_bounds(_instances(spark, sf_dir).join(parts, "l_partkey"), "l_orderkey", "x", "l_suppkey", "size", "size")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_reference_check(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return sequence.dangling(_instances(spark, sf_dir), known, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


def _contexts(spark, sf_dir):
    g = _glyphs(spark, sf_dir)
    rows = dictionary.byte_rows("hi", "lo")
    bits = F.array(*(F.shiftright(r, 7 - x).bitwiseAND(F.lit(1)).cast("long") for r in rows for x in range(8)))
    return g.select("vec_id", sequence.contexts(rows).alias("ctx"), bits.alias("bits"))


@query(f"""WITH {_PX}, near AS (SELECT dy, dx, k FROM (SELECT unnest([-2, -2, -2, -2, -2, -1, -1, -1, -1, -1, -1, -1, 0, 0, 0, 0]) AS dy, unnest([-2, -1, 0, 1, 2, -3, -2, -1, 0, 1, 2, 3, -4, -3, -2, -1]) AS dx, unnest(range(15, -1, -1)) AS k)),
own AS (SELECT vec_id, p // 8 AS y, p % 8 AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS p FROM embeddings)),
c AS (SELECT own.vec_id, own.y, own.x, CAST(coalesce(sum(CASE WHEN px.p IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(k AS INT) END), 0) AS BIGINT) AS ctx FROM own CROSS JOIN near LEFT JOIN px ON px.vec_id = own.vec_id AND px.y = own.y + dy AND px.x = own.x + dx GROUP BY 1, 2, 3)
SELECT ctx, count(*) AS n, count(px.p) AS black FROM c LEFT JOIN px USING (vec_id, y, x) GROUP BY ctx""")
def context_histogram(spark, sf_dir):
    e = _contexts(spark, sf_dir).select(F.explode(F.arrays_zip("ctx", "bits")).alias("z")).select("z.ctx", "z.bits")
    return e.groupBy("ctx").agg(F.count("*").alias("n"), F.sum("bits").alias("black"))


@query(f"WITH {_CELL}, m AS (SELECT dy, dx FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) SELECT vec_id, y + dy AS y, x + dx AS x, CAST(sum(value * (2 - abs(dy)) * (2 - abs(dx))) AS BIGINT) AS sum16 FROM cell, m WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def prefilter_3x3(spark, sf_dir):
    return halftone.prefilter(halftone.gray_cells(_t(spark, sf_dir, "embeddings")))


def _blocks(spark, sf_dir):
    return halftone.decimate(halftone.gray_cells(_t(spark, sf_dir, "embeddings")))


@query(f"WITH {_BLOCK} SELECT vec_id, gy, gx, total FROM block")
def decimate_block_sum(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"WITH {_BLOCK} SELECT vec_id, gy, gx, total, gray FROM q")
def gray_scale_quantize(spark, sf_dir):
    return halftone.quantize(_blocks(spark, sf_dir))


@query("""WITH xy AS (SELECT x, y FROM (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y)),
b AS (SELECT x, y, 16 * (2 * ((x + y) % 2) + y % 2) + 4 * (2 * ((x // 2 + y // 2) % 2) + y // 2) AS t FROM xy)
SELECT i, y, x, CAST(CASE WHEN i * 255 // 15 > t * 255 // 63 THEN 1 ELSE 0 END AS BIGINT) AS black FROM b, (SELECT unnest(range(0, 16)) AS i)""")
def bayer_patterns(spark, sf_dir):
    return halftone.patterns(spark)


@query(f"WITH {_BLOCK} SELECT vec_id, gy, gx, plane, (gray >> CAST(plane AS INT)) & 1 AS bit, (xor(gray, gray >> 1) >> CAST(plane AS INT)) & 1 AS gray_bit FROM q, (SELECT unnest(range(0, 4)) AS plane)")
def bitplanes_gray_code(spark, sf_dir):
    return halftone.planes(halftone.quantize(_blocks(spark, sf_dir)).drop("total"))


@query("SELECT vec_id // 1024 AS shard, vec_id AS page, CAST(kind AS BIGINT) AS kind, (row_number() OVER (PARTITION BY vec_id // 1024, kind ORDER BY vec_id) - 1) * 3 + k AS number FROM embeddings, (SELECT unnest([48, 38, 49]) AS kind, unnest(range(0, 3)) AS k)")
def segment_numbers(spark, sf_dir):
    return container.segments(_t(spark, sf_dir, "embeddings"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS DOUBLE), 72.0) AS other FROM events")
def json_number_default(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", placement.number_at(F.col("props"), "$.k").alias("k"), placement.number_at(F.col("props"), "$.none", 72.0).alias("other"))


@query("SELECT p_partkey, round(612.0 * 72 / (p_retailprice * CASE WHEN p_size % 7 = 0 THEN 300 ELSE greatest(p_size, 72) END), 9) AS scale, 792 - p_retailprice - p_size AS y, greatest(792 - p_retailprice - p_size, 0) AS clamped FROM part")
def placement_scale(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    res = F.when(F.col("p_size") % 7 == 0, F.lit(0)).otherwise(F.col("p_size"))
    y = placement.flipped(F.lit(792), F.col("p_retailprice"), F.col("p_size"))
    return p.select("p_partkey", F.round(placement.scale(F.lit(612.0), F.col("p_retailprice"), placement.dpi(res, 300, 72)), 9).alias("scale"), y.alias("y"), placement.clamped(y).alias("clamped"))


@query("SELECT CAST(p_partkey AS BIGINT) AS v, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE ceil(log2(p_partkey)) END AS BIGINT) AS bits FROM part")
def log2_up(spark, sf_dir):
    v = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(v.alias("v"), F.when(v <= 1, F.lit(0)).otherwise(F.length(F.bin(v - 1))).cast("long").alias("bits"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def platform_tumbling_events(spark, sf_dir):
    return streams.tumbling(_t(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, k""")
def platform_session_events(spark, sf_dir):
    return streams.sessions(_t(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
