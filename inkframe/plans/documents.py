"""Queries of the raster engine on bitmaps and pages of any size, with their SQL twins.

Texts are pages (see ``operators.pages``), trimmed embeddings are symbols of many sizes with their label as the page. Coders
are compared after a round trip: what the decoder gives back is what SQL finds in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators import bitmap, coding, dictionary, halftone, kernels, matching, pages, raster
from inkframe.plans.catalog import _BLOCK, _CELL, _G, _PX, _RUN, _black, _blocks, _contexts, _glyphs, _instances, _t, query
from inkframe.sources import container, headers, pbm

#: Level above which embeddings are black where symbols should be small and alike.
SPARSE = 0.2
PIXELS = 3
_SPX = _PX.replace("WHERE v > 0", f"WHERE v > {SPARSE}")
_TRIM = """tb AS (SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM px GROUP BY vec_id),
tr AS (SELECT b.vec_id, b.x0, b.y0, width, height, r, CAST(coalesce(sum(CASE WHEN px.p IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(31 - px.x + b.x0 AS INT) END), 0) AS BIGINT) AS word
  FROM (SELECT *, unnest(range(0, height)) AS r FROM tb) b LEFT JOIN px ON px.vec_id = b.vec_id AND px.y = b.y0 + r GROUP BY ALL),
t AS (SELECT vec_id, x0, y0, width, height, list(word ORDER BY r) AS words FROM tr GROUP BY vec_id, x0, y0, width, height)"""
_INK = """line AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
ink AS (SELECT doc_id, y, x FROM (SELECT doc_id, y, unnest(s) AS c, unnest(range(0, len(s))) AS x FROM (SELECT doc_id, y, string_split(line, '') AS s FROM line)) WHERE c IN ('a', 'e', 'o')),
run AS (SELECT doc_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS k FROM ink) GROUP BY doc_id, y, k)"""
_PAGE = "RECURSIVE " + _INK + """,
r AS (SELECT doc_id, y * 16777216 + x0 AS id, y, x0, x1 FROM run),
down AS (SELECT a.doc_id, a.id AS a, b.id AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1),
near AS (SELECT doc_id, a, b FROM down UNION ALL SELECT doc_id, b, a FROM down),
reach(doc_id, id, root) AS (SELECT doc_id, id, id FROM r UNION SELECT near.doc_id, near.b, reach.root FROM reach JOIN near ON near.doc_id = reach.doc_id AND near.a = reach.id WHERE reach.root < near.b),
member AS (SELECT doc_id, id, min(root) AS comp FROM reach GROUP BY doc_id, id),
page AS (SELECT m.doc_id, comp, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS width, max(y) - min(y) + 1 AS height, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n FROM member m JOIN r USING (doc_id, id) GROUP BY m.doc_id, comp)"""
_DOTS = _PAGE + f""",
c AS (SELECT * FROM page WHERE n >= {PIXELS}),
mid AS (SELECT a.doc_id, a.n AS mn, b.height AS mh FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) AS k FROM c) a
  JOIN (SELECT doc_id, height, row_number() OVER (PARTITION BY doc_id ORDER BY height) AS i FROM c) b ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.i = a.k // 2 + 1),
dot AS (SELECT c.* FROM c JOIN mid USING (doc_id) WHERE n <= mn AND c.height <= mh AND CAST(width AS DOUBLE) / c.height BETWEEN 0.5 AND 2),
reachable AS (SELECT doc_id, CAST(least(greatest(floor(round(0.6 * avg(height) + 0.5 * stddev_pop(height), 9)), 5), 30) AS BIGINT) AS most FROM (SELECT doc_id, height, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, comp) AS i FROM c) WHERE i <= 10 GROUP BY doc_id),
base AS (SELECT c.* FROM c ANTI JOIN dot ON c.doc_id = dot.doc_id AND c.comp = dot.comp),
pair AS (SELECT d.doc_id, d.comp, b.comp AS base, row_number() OVER (PARTITION BY d.doc_id, d.comp ORDER BY b.y - d.y - d.height, b.comp) AS i FROM dot d JOIN reachable q USING (doc_id) JOIN base b USING (doc_id)
  WHERE b.y > d.y + d.height AND b.y - d.y - d.height <= most AND d.x + d.width // 2 BETWEEN b.x - 1 AND b.x + b.width + 1),
merged AS (SELECT c.doc_id, coalesce(p.base, c.comp) AS comp, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, CAST(sum(n) AS BIGINT) AS n, count(*) AS parts
  FROM c LEFT JOIN (SELECT * FROM pair WHERE i = 1) p USING (doc_id, comp) GROUP BY 1, 2)"""
_WIDE = _DOTS + """,
rolled AS (SELECT *, round(coalesce(avg(width) OVER (PARTITION BY doc_id ORDER BY y, x, comp ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 1.0), 6) AS mean_before FROM merged),
wide AS (SELECT * FROM rolled WHERE width > 1.5 * mean_before),
col AS (SELECT w.doc_id, w.comp, w.width, ink.x - w.x AS c FROM wide w JOIN ink ON ink.doc_id = w.doc_id AND ink.y BETWEEN w.y AND w.y + w.height - 1 AND ink.x BETWEEN w.x AND w.x + w.width - 1 GROUP BY w.doc_id, w.comp, w.width, w.height, ink.x - w.x HAVING count(*) > 0.25 * w.height),
gap AS (SELECT doc_id, comp, width, c, lead(c) OVER (PARTITION BY doc_id, comp ORDER BY c) - c - 1 AS g FROM col),
cut AS (SELECT doc_id, comp, c + 1 + g // 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, comp ORDER BY g DESC, c) AS i FROM gap WHERE g > 0) WHERE i = 1 AND c + 1 + g // 2 >= 2 AND width - c - 1 - g // 2 >= 2),
part AS (SELECT m.doc_id, m.comp, 0 AS part, x, y, coalesce(cut, width) AS width, height FROM merged m LEFT JOIN cut USING (doc_id, comp) UNION ALL SELECT m.doc_id, m.comp, 1, x + cut, y, width - cut, height FROM merged m JOIN cut USING (doc_id, comp))"""
_SYMBOL = _WIDE + """,
seen AS (SELECT p.doc_id, p.comp, p.part, ink.x, ink.y FROM part p JOIN ink ON ink.doc_id = p.doc_id AND ink.y BETWEEN p.y AND p.y + p.height - 1 AND ink.x BETWEEN p.x AND p.x + p.width - 1),
sbox AS (SELECT doc_id, comp, part, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM seen GROUP BY doc_id, comp, part),
sword AS (SELECT b.doc_id, b.comp, b.part, b.x, b.y, b.width, b.height, i, CAST(coalesce(sum(CASE WHEN s.x IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(31 - (s.x - b.x) % 32 AS INT) END), 0) AS BIGINT) AS word
  FROM (SELECT *, unnest(range(0, height * ((width + 31) // 32))) AS i FROM sbox) b LEFT JOIN seen s ON s.doc_id = b.doc_id AND s.comp = b.comp AND s.part = b.part AND (s.y - b.y) * ((b.width + 31) // 32) + (s.x - b.x) // 32 = i GROUP BY ALL),
allsym AS (SELECT doc_id, comp, part, x, y, width, height, list(word ORDER BY i) AS words FROM sword GROUP BY doc_id, comp, part, x, y, width, height),
psize AS (SELECT doc_id, max(length(line)) AS pw, count(*) AS ph FROM line GROUP BY doc_id),
symbol AS (SELECT s.* FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM allsym) s JOIN psize USING (doc_id) WHERE NOT (k = 1 AND x = 0 AND y = 0 AND width >= pw - 2 AND height >= ph - 2))"""
_TEMPLATE = _SYMBOL + """,
tmpl AS (SELECT width, height, words, count(*) AS usage, list_sort(list(DISTINCT doc_id)) AS pages, min((doc_id, y, x)) AS f, CASE WHEN count(*) > 1 OR (SELECT count(DISTINCT doc_id) FROM symbol) = 1 THEN 'global' ELSE 'local' END AS scope, min(doc_id) AS home FROM symbol GROUP BY width, height, words),
ident AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN scope = 'local' THEN home END ORDER BY height, width, words) - 1 AS position FROM tmpl),
named AS (SELECT *, CASE WHEN scope = 'global' THEN position ELSE (SELECT count(*) FROM tmpl WHERE scope = 'global') + position END AS id FROM ident)"""


def _text(words):
    return F.array_join(F.transform(words, lambda w: w.cast("string")), ",")


def _docs(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _trimmed(spark, sf_dir, threshold: float = SPARSE) -> DataFrame:
    return bitmap.trim(raster.pixels(_t(spark, sf_dir, "embeddings"), threshold))


def _symbols(spark, sf_dir) -> DataFrame:
    """(label, id, width, height, words): sparse glyphs cut to their pixels, with the label as the page."""
    labels = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return _trimmed(spark, sf_dir).join(labels, "vec_id").select("label", F.col("vec_id").alias("id"), "width", "height", "words")


@query(f"WITH {_SPX}, {_TRIM} SELECT vec_id, x0, y0, width, height, array_to_string(words, ',') AS words FROM t")
def glyph_trimmed(spark, sf_dir):
    return _trimmed(spark, sf_dir).select("vec_id", "x0", "y0", "width", "height", _text("words").alias("words"))


@query(f"WITH {_SPX}, {_TRIM}, b AS (SELECT vec_id, string_agg(format('{{:02X}}', word >> 24), '' ORDER BY r) AS data FROM tr GROUP BY vec_id) SELECT vec_id, data FROM b")
def glyph_row_bytes(spark, sf_dir):
    return _trimmed(spark, sf_dir).select("vec_id", bitmap.row_bytes(F.col("words"), F.col("width"), F.col("height")).alias("data"))


@query(f"WITH {_SPX}, {_TRIM}, spot AS (SELECT unnest([0, 1, 3, 7, -1, 40]) AS x, unnest([0, 1, 2, 7, 2, 1]) AS y) SELECT t.vec_id, CAST(spot.x AS BIGINT) AS x, CAST(spot.y AS BIGINT) AS y, count(px.p) AS black FROM t CROSS JOIN spot LEFT JOIN px ON px.vec_id = t.vec_id AND px.x = t.x0 + spot.x AND px.y = t.y0 + spot.y AND spot.x >= 0 AND spot.y >= 0 GROUP BY ALL")
def glyph_probe(spark, sf_dir):
    at = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (1, 1), (3, 2), (7, 7), (-1, 2), (40, 1)))))
    t = _trimmed(spark, sf_dir).withColumn("at", at)
    return t.select("vec_id", "at.x", "at.y", bitmap.get(F.col("words"), F.col("width"), F.col("height"), F.col("at.x"), F.col("at.y")).alias("black"))


@query(f"WITH {_G} SELECT vec_id, (hi & ~(CAST(255 AS BIGINT) << 24)) | (hi & (CAST(255 AS BIGINT) << 24)) & ~(CAST(1 AS BIGINT) << 28) AS top, CAST(bit_count(hi) + bit_count(lo) - ((hi >> 28) & 1) + 1 - ((lo >> 20) & 1) AS BIGINT) AS ones FROM g")
def glyph_set_pixel(spark, sf_dir):
    """White at (3, 0) and black at (3, 5), which is bit 20 of the lower word; rows of 8 pixels, so a word holds four."""
    g = _glyphs(spark, sf_dir).withColumn("rows", F.array(*(F.shiftleft(r.cast("long"), 24) for r in dictionary.byte_rows("hi", "lo"))))
    eight = F.lit(8)
    put = lambda words, x, y, black: bitmap.put(words, eight, F.lit(x), F.lit(y), F.lit(black))
    done = put(put(put(F.col("rows"), 3, 0, False), 3, 5, True), 9, 9, True)
    first = F.aggregate(F.slice("done", 1, 4), F.lit(0).cast("long"), lambda s, w: s * 256 + F.shiftright(w, 24))
    return g.withColumn("done", done).select("vec_id", first.alias("top"), bitmap.count_ones(F.col("done")).alias("ones"))


@query(f"WITH {_SPX}, {_TRIM}, f AS (SELECT px.vec_id, min((px.y - y0) * 8 + px.x - x0) AS p FROM px JOIN t USING (vec_id) GROUP BY px.vec_id) SELECT vec_id, p // 8 AS y, p % 8 AS x FROM f")
def glyph_first_black_words(spark, sf_dir):
    return _trimmed(spark, sf_dir).withColumn("f", bitmap.first_black(F.col("words"), F.col("width"))).select("vec_id", "f.y", "f.x")


@query(f"""WITH {_PX}, rect AS (SELECT vec_id, vec_id % 7 - 2 AS x0, vec_id % 5 - 1 AS y0, vec_id % 4 + 3 AS width, vec_id % 3 + 4 AS height FROM embeddings),
w AS (SELECT b.*, CAST(coalesce(sum(CASE WHEN px.p IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(31 - px.x + b.x0 AS INT) END), 0) AS BIGINT) AS word FROM (SELECT *, unnest(range(0, height)) AS r FROM rect) b LEFT JOIN px ON px.vec_id = b.vec_id AND px.y = y0 + r AND px.x BETWEEN x0 AND x0 + width - 1 GROUP BY ALL)
SELECT vec_id, x0, y0, width, height, array_to_string(list(word ORDER BY r), ',') AS words FROM w GROUP BY vec_id, x0, y0, width, height""")
def glyph_sub_image(spark, sf_dir):
    v = F.col("vec_id")
    rects = _t(spark, sf_dir, "embeddings").select(v, (v % 7 - 2).alias("x0"), (v % 5 - 1).alias("y0"), (v % 4 + 3).alias("width"), (v % 3 + 4).alias("height"))
    return bitmap.sub_images(_black(spark, sf_dir), rects).withColumn("words", _text("words"))


@query(f"""WITH {_PX}, rect AS (SELECT vec_id, vec_id % 3 AS x0, vec_id % 4 AS y0, vec_id % 4 + 2 AS width, vec_id % 3 + 1 AS height FROM embeddings)
SELECT rect.vec_id, width, height, count(px.p) AS ones FROM rect LEFT JOIN px ON px.vec_id = rect.vec_id AND x BETWEEN x0 AND x0 + width - 1 AND y BETWEEN y0 AND y0 + height - 1 GROUP BY ALL""")
def glyph_crop_checked(spark, sf_dir):
    v = F.col("vec_id")
    e = _t(spark, sf_dir, "embeddings")
    rects = e.select(v, (v % 3).alias("x0"), (v % 4).alias("y0"), (v % 4 + 2).alias("width"), (v % 3 + 1).alias("height"))
    sizes = e.select("vec_id", F.lit(8).alias("page_width"), F.lit(8).alias("page_height"))
    return bitmap.crop(_black(spark, sf_dir), rects, sizes).select("vec_id", "width", "height", bitmap.count_ones(F.col("words")).alias("ones"))


@query(f"WITH {_G}, b AS (SELECT vec_id, lpad(bin(hi), 32, '0') || lpad(bin(lo), 32, '0') AS s FROM g), r AS (SELECT vec_id, i, substr(s, i * 5 + 1, 5) AS v FROM b, (SELECT unnest(range(0, 12)) AS i)) SELECT vec_id, CAST(sum(length(replace(v, '0', ''))) AS BIGINT) AS ones, count(*) FILTER (v = '00000') AS blank_rows FROM r GROUP BY vec_id")
def bytes_to_bitmap(spark, sf_dir):
    """The 64 bits of a glyph read as 12 rows of 5 pixels; the last 4 bits are padding."""
    data = F.unhex(F.concat(*(F.lpad(F.hex(F.col(w)), 8, "0") for w in ("hi", "lo"))))
    g = _glyphs(spark, sf_dir).withColumn("words", bitmap.from_bytes(F.lit(5), F.lit(12), data))
    return g.select("vec_id", bitmap.count_ones(F.col("words")).alias("ones"), F.size(F.filter("words", lambda w: w == 0)).cast("long").alias("blank_rows"))


@query("SELECT p_partkey, CASE WHEN n = w * h THEN 'ok' WHEN n = (w * h + 7) // 8 THEN 'packed' WHEN n < w * h THEN 'short' ELSE 'long' END AS kind FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS w, p_size % 7 + 1 AS h, CASE WHEN p_partkey % 3 = 0 THEN p_size * (p_size % 7 + 1) WHEN p_partkey % 3 = 1 THEN (p_size * (p_size % 7 + 1) + 7) // 8 ELSE p_partkey % 200 END AS n FROM part)")
def raster_input_kind(spark, sf_dir):
    w, h, k = F.col("p_size").cast("long"), F.col("p_size") % 7 + 1, F.col("p_partkey")
    n = F.when(k % 3 == 0, w * h).when(k % 3 == 1, F.floor((w * h + 7) / 8)).otherwise(k % 200)
    return _t(spark, sf_dir, "part").select("p_partkey", bitmap.input_kind(w, h, n).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size - 3 BETWEEN 1 AND 16777216 AND p_partkey % 50 BETWEEN 1 AND 16777216 THEN (p_size - 3 + 31) // 32 * (p_partkey % 50) END AS words FROM part")
def blank_bitmaps(spark, sf_dir):
    blank = bitmap.blank(F.col("p_size").cast("long") - 3, F.col("p_partkey") % 50)
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(blank.isNotNull(), F.size(blank)).cast("long").alias("words"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS x, CAST(greatest(p_size - 10, 0) AS BIGINT) AS y, least(p_size + p_partkey, 4294967295) - p_size AS width FROM part")
def rect_infinite(spark, sf_dir):
    """Boxes clipped to the rectangle without bounds: only what is left of or above it goes."""
    r = _t(spark, sf_dir, "part").withColumn("i", bitmap.infinite()).withColumn("s", F.col("p_size").cast("long"))
    x = F.greatest(F.col("s"), F.col("i.x"))
    return r.select("p_partkey", x.alias("x"), F.greatest(F.col("s") - 10, F.col("i.y")).alias("y"), (F.least(F.col("s") + F.col("p_partkey"), F.col("i.x") + F.col("i.width")) - x).alias("width"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 1000000 - 5000000 BETWEEN 0 AND 4294967295 THEN o_orderkey * 1000000 - 5000000 END AS cast_value FROM orders")
def checked_casts(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", bitmap.u32(F.col("o_orderkey") * 1_000_000 - 5_000_000).alias("cast_value"))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in container.TYPES.items())


@query(f"SELECT p_partkey, p_partkey % 64 AS code, name FROM part LEFT JOIN (VALUES {_NAMES}) v(code, name) ON code = p_partkey % 64")
def segment_type_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("code"))
    return headers.decode_types(p, "code").select("p_partkey", "code", "name")


@query("""WITH v AS (SELECT p_partkey, p_partkey * p_partkey % 4294967296 AS v FROM part),
g AS (SELECT p_partkey, v, i, (v >> CAST(7 * i AS INT)) AS rest FROM v, (SELECT unnest(range(0, 5)) AS i))
SELECT p_partkey, string_agg(format('{:02X}', (rest & 127) + CASE WHEN rest > 127 THEN 128 ELSE 0 END), '' ORDER BY i) AS bytes FROM g WHERE i = 0 OR rest > 0 GROUP BY p_partkey""")
def varint_bytes(spark, sf_dir):
    v = F.col("p_partkey") * F.col("p_partkey") % (1 << 32)
    return _t(spark, sf_dir, "part").select("p_partkey", headers.varint(v).alias("bytes"))


_AT = "03FFFDFF02FEFEFE"


@query(f"""SELECT p_partkey, format('{{:08X}}{{:08X}}{{:08X}}{{:08X}}010000', p_partkey, CAST(p_size AS BIGINT), CAST(round(p_size * 10000 / 254.0) AS BIGINT), CAST(round(p_size * 10000 / 254.0) AS BIGINT)) AS page,
 format('{{:08X}}{{:08X}}{{:08X}}{{:08X}}{{:02X}}00{_AT}', p_partkey, CAST(p_size AS BIGINT), p_partkey % 9, p_partkey % 11, p_partkey % 5) AS generic,
 format('{{:04X}}', p_partkey % 4 * 1024) || CASE WHEN p_partkey % 4 = 0 THEN '{_AT}' ELSE '03FF' END || format('{{:08X}}{{:08X}}', p_partkey, CAST(p_size AS BIGINT)) AS symbols,
 format('{{:08X}}{{:08X}}{{:08X}}{{:08X}}00{{:04X}}{{:08X}}', p_partkey, CAST(p_size AS BIGINT), p_partkey % 9, p_partkey % 11, p_partkey % 4 * 4 + p_partkey % 3 * 16 + ((p_partkey % 7 - 3 + 32) % 32) * 1024, p_partkey * 3) AS text,
 format('{{:08X}}{{:08X}}{{:08X}}{{:08X}}0000{{:08X}}{{:08X}}{{:08X}}{{:08X}}{{:04X}}0000', p_partkey, CAST(p_size AS BIGINT), p_partkey % 9, p_partkey % 11, p_partkey // 4, CAST(p_size // 4 AS BIGINT), p_partkey % 9 % 4, p_partkey % 11 % 4, 1024) AS halftone FROM part""")
def region_headers(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    x, y = k % 9, k % 11
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        headers.page_information(k, s, s).alias("page"),
        headers.generic_region(k, s, x, y, k % 5).alias("generic"),
        headers.symbol_dictionary(k % 4, k, s).alias("symbols"),
        headers.text_region(k, s, x, y, k % 4, k % 3, k % 7 - 3, k * 3).alias("text"),
        headers.halftone_region(k, s, x, y, F.floor(k / 4), F.floor(s / 4), F.lit(4)).alias("halftone"),
    )


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey * 40 AS number, p_partkey % 64 AS kind, p_partkey % 600 AS page, range(0, p_partkey % 9) AS refs, CAST(p_size AS BIGINT) AS n FROM part)
SELECT k AS p_partkey, format('{:08X}{:02X}', number, kind + CASE WHEN page > 255 THEN 64 ELSE 0 END)
 || CASE WHEN len(refs) <= 4 THEN format('{:02X}', len(refs) * 32) ELSE format('{:08X}', 3758096384 + len(refs)) || repeat('00', (len(refs) + 8) // 8) END
 || array_to_string(list_transform(refs, lambda r: CASE WHEN number <= 256 THEN format('{:02X}', r) WHEN number <= 65536 THEN format('{:04X}', r) ELSE format('{:08X}', r) END), '')
 || CASE WHEN page > 255 THEN format('{:08X}', page) ELSE format('{:02X}', page) END || format('{:08X}', n) AS head FROM s""")
def segment_headers(spark, sf_dir):
    k = F.col("p_partkey")
    refs = F.when(k % 9 > 0, F.sequence(F.lit(0).cast("long"), k % 9 - 1)).otherwise(F.array().cast("array<bigint>"))
    return _t(spark, sf_dir, "part").select(k, headers.segment_head(k * 40, k % 64, k % 600, refs, F.col("p_size")).alias("head"))


@query("SELECT p_partkey, CASE WHEN p_size % 6 > 3 THEN 'template' WHEN p_size % 7 > 4 THEN 'adaptive pixels' WHEN p_size % 8 > 4 THEN 'operator' END AS problem FROM part")
def config_problems(spark, sf_dir):
    s = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", headers.problem_of(s % 6, s % 7, s % 8).alias("problem"))


def _regions(spark, sf_dir) -> DataFrame:
    """Streams that begin like a coded file, and their detections as JSON of each page: orders are pages, lines are detections."""
    line = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    w = Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = line.withColumn("detection", (F.row_number().over(w) - 1).cast("long"))
    box = F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_tax")).alias("width"))
    metadata = line.groupBy("page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("detection", box.alias("b")))), lambda d: F.struct(d["b"].alias("bbox_pdf"))).alias("detections"))).alias("json"))
    head = F.concat(F.lit("00" * 11), headers.be(F.col("l_partkey"), 4), headers.be(F.col("l_suppkey"), 4), headers.be(F.col("l_linenumber") * 30, 4), headers.be(F.lit(300), 4), F.lit("00"))
    return headers.regions_of_interest(line.select("page", "detection", F.unhex(head).alias("stream")), metadata)


_REGIONS = "WITH l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS detection, * FROM lineitem)"


@query(_REGIONS + " SELECT page, detection, l_partkey AS width, l_suppkey AS height, CAST(greatest(l_linenumber * 30, 72) AS BIGINT) AS xres, CAST(300 AS BIGINT) AS yres, l_quantity AS pdf_x, l_discount AS pdf_y, CASE WHEN l_partkey % 2 = 0 THEN l_tax ELSE CAST(l_partkey AS DOUBLE) END AS pdf_width, CAST(l_suppkey AS DOUBLE) AS pdf_height FROM l")
def roi_json_join(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(_REGIONS + " SELECT page, count(*) AS regions, string_agg('/Im' || detection || ' Do', ' ' ORDER BY detection) AS names FROM l GROUP BY page")
def roi_by_page(spark, sf_dir):
    return headers.by_page(_regions(spark, sf_dir))


@query("SELECT o_orderkey AS page, coalesce(w, 612.0) AS width, coalesce(h, 792.0) AS height FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS w, max(l_extendedprice) AS h FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def page_size_default(spark, sf_dir):
    sizes = _t(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("page")).agg(F.max("l_quantity").alias("width"), F.max("l_extendedprice").alias("height"))
    return headers.page_sizes(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")), sizes)


_C = "doc_id, comp, x, y, width, height, n"


@query(f"WITH {_PAGE} SELECT {_C} FROM page")
def page_components(spark, sf_dir):
    return pages.steps(_docs(spark, sf_dir), "boxes")


@query(f"WITH {_PAGE} SELECT m.doc_id, m.comp, string_agg(y || ':' || x0 || '-' || x1, ' ' ORDER BY y, x0) AS runs FROM member m JOIN r USING (doc_id, id) GROUP BY m.doc_id, m.comp")
def page_component_runs(spark, sf_dir):
    one = F.transform(F.array_sort("runs"), lambda r: F.concat(r["y"].cast("string"), F.lit(":"), r["x0"].cast("string"), F.lit("-"), r["x1"].cast("string")))
    return pages.components(_docs(spark, sf_dir)).select("doc_id", "comp", F.array_join(one, " ").alias("runs"))


def _steps(spark, sf_dir, stage: str) -> DataFrame:
    return pages.steps(_docs(spark, sf_dir), stage, PIXELS, 1.0, 1.0, 0.25, 2)


@query(f"WITH {_PAGE} SELECT {_C} FROM page WHERE n >= {PIXELS}")
def page_least_size(spark, sf_dir):
    return _steps(spark, sf_dir, "least")


@query(f"WITH {_DOTS} SELECT {_C} FROM dot")
def page_dots(spark, sf_dir):
    return _steps(spark, sf_dir, "dots")


@query(f"WITH {_DOTS} SELECT {_C}, parts FROM merged")
def page_dot_merges(spark, sf_dir):
    return _steps(spark, sf_dir, "merged")


@query(f"WITH {_WIDE} SELECT {_C}, mean_before FROM wide")
def wide_glyph_rolling(spark, sf_dir):
    return _steps(spark, sf_dir, "wide")


@query(f"WITH {_WIDE} SELECT doc_id, comp, CAST(part AS BIGINT) AS part, x, y, width, height FROM part")
def page_wide_splits(spark, sf_dir):
    return _steps(spark, sf_dir, "parts")


@query(f"WITH {_SYMBOL} SELECT doc_id, comp, CAST(part AS BIGINT) AS part, x, y, width, height, array_to_string(words, ',') AS words FROM allsym")
def page_segment_symbols(spark, sf_dir):
    return _steps(spark, sf_dir, "symbols").withColumn("words", _text("words"))


@query("SELECT p_partkey, CAST(p_size - 3 AS BIGINT) AS width, p_partkey * 7 AS height FROM part WHERE p_size - 3 BETWEEN 1 AND 10000 AND p_partkey * 7 BETWEEN 1 AND 10000")
def symbol_size_limits(spark, sf_dir):
    return pages.usable(_t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") - 3).alias("width"), (F.col("p_partkey") * 7).alias("height")))


@query("""WITH s AS (SELECT l_orderkey AS page, l_linenumber % 2 AS x, l_partkey % 2 AS y, l_partkey % 60 AS width, CAST(l_quantity AS BIGINT) AS height, l_partkey FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY page) AS k FROM s)
SELECT page, CAST(x AS BIGINT) AS x, y, width, height, l_partkey FROM n WHERE NOT (k = 1 AND x = 0 AND y = 0 AND width >= 20 AND height >= 10)""")
def whole_page_rejection(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    s = line.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 2).cast("long").alias("x"), (F.col("l_partkey") % 2).alias("y"), (F.col("l_partkey") % 60).alias("width"), F.col("l_quantity").cast("long").alias("height"), "l_partkey")
    sizes = s.select("page").distinct().select("page", F.lit(22).alias("page_width"), F.lit(12).alias("page_height"))
    return pages.accept(s, sizes, "page")


def _extracted(spark, sf_dir) -> DataFrame:
    return pages.extract(_docs(spark, sf_dir), PIXELS, 1.0, 1.0, 0.25, 2)


@query(f"WITH {_SYMBOL} SELECT doc_id, count(*) AS symbols, CAST(sum(width * height) AS BIGINT) AS area, count(DISTINCT (width, height, words)) AS distinct_bitmaps FROM symbol GROUP BY doc_id")
def page_extract_symbols(spark, sf_dir):
    return _extracted(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("symbols"), F.sum(F.col("width") * F.col("height")).alias("area"), F.countDistinct("width", "height", "words").alias("distinct_bitmaps"))


@query(f"WITH {_TEMPLATE} SELECT width, height, array_to_string(words, ',') AS words, usage, array_to_string(pages, ',') AS pages, scope, position, id FROM named")
def page_dictionary_ids(spark, sf_dir):
    t = pages.dictionary_ids(pages.templates(_extracted(spark, sf_dir)))
    return t.select("width", "height", _text("words").alias("words"), "usage", _text("pages").alias("pages"), "scope", "position", "id")


@query(f"WITH {_TEMPLATE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, comp, part) - 1 AS seq, x, y, s.width, s.height, scope, id FROM symbol s JOIN named USING (width, height, words)")
def page_instances(spark, sf_dir):
    found = _extracted(spark, sf_dir)
    return pages.resolve(found, pages.dictionary_ids(pages.templates(found)))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_partkey * 300000 + p_size < 4294967296 AND p_partkey IS NOT NULL AS valid FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5")
def reference_validity(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("size"))
    j = _instances(spark, sf_dir).join(known, "l_partkey", "left")
    fits = pages.region_fits(F.col("l_partkey") * 300_000, F.col("l_partkey"), F.col("size"), F.col("size"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(fits, F.lit(False)).alias("valid"))


_SYM = f"{_SPX}, {_TRIM}, s AS (SELECT CAST(label AS BIGINT) AS label, t.vec_id AS id, width, height, words, x0, y0 FROM t JOIN embeddings USING (vec_id))"
_DIST = """shift AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
dot AS (SELECT s.id, px.x - x0 AS x, px.y - y0 AS y FROM s JOIN px ON px.vec_id = s.id),
mv AS (SELECT a, b, dx, dy, d.x + dx AS x, d.y + dy AS y FROM pair JOIN dot d ON d.id = a CROSS JOIN shift WHERE d.x + dx BETWEEN 0 AND greatest(wa, wb) - 1 AND d.y + dy BETWEEN 0 AND hb - 1),
fx AS (SELECT a, b, dx, dy, d.x, d.y FROM pair JOIN dot d ON d.id = b CROSS JOIN shift WHERE d.y - dy BETWEEN 0 AND ha - 1),
one AS (SELECT a, b, dx, dy, count(*) AS n FROM (SELECT * FROM mv UNION ALL SELECT * FROM fx) GROUP BY 1, 2, 3, 4),
two AS (SELECT a, b, dx, dy, count(*) AS n FROM mv JOIN fx USING (a, b, dx, dy, x, y) GROUP BY 1, 2, 3, 4),
err AS (SELECT pair.a, pair.b, wa, ha, shift.dx, shift.dy, coalesce(one.n, 0) - 2 * coalesce(two.n, 0) AS err FROM pair CROSS JOIN shift LEFT JOIN one ON one.a = pair.a AND one.b = pair.b AND one.dx = shift.dx AND one.dy = shift.dy
  LEFT JOIN two ON two.a = pair.a AND two.b = pair.b AND two.dx = shift.dx AND two.dy = shift.dy WHERE greatest(0, shift.dy) < least(hb, ha + shift.dy)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY err, abs(dx) + abs(dy), dy, dx) AS i FROM err) WHERE i = 1)"""
_GATED = "pair AS (SELECT x.id AS a, y.id AS b, x.width AS wa, x.height AS ha, y.width AS wb, y.height AS hb FROM s x JOIN s y ON x.label = y.label AND x.id < y.id AND abs(x.width - y.width) <= 4 AND abs(x.height - y.height) <= 4)"


@query(f"WITH {_SYM}, {_GATED}, {_DIST} SELECT x.label, a AS id_a, b AS id_b, err, dx, dy FROM best JOIN s x ON x.id = a WHERE err <= wa * ha // 20")
def symbol_distance_pairs(spark, sf_dir):
    return matching.compare(_symbols(spark, sf_dir), ["label"], 20)


def _templates(spark, sf_dir) -> DataFrame:
    """(id, width, height, words, usage, pages) of distinct sparse glyphs, with labels as pages."""
    return _symbols(spark, sf_dir).groupBy("width", "height", "words").agg(F.min("id").alias("id"), F.count("*").alias("usage"), F.array_sort(F.collect_set("label")).alias("pages"))


def _union_sql(gate: str) -> str:
    return f"""WITH RECURSIVE {_SPX}, {_TRIM}, s AS (SELECT min(t.vec_id) AS id, width, height, words, count(*) AS usage, list_sort(list(DISTINCT CAST(label AS BIGINT))) AS pages, arg_min(x0, t.vec_id) AS x0, arg_min(y0, t.vec_id) AS y0 FROM t JOIN embeddings USING (vec_id) GROUP BY width, height, words),
pair AS (SELECT x.id AS a, y.id AS b, x.width AS wa, x.height AS ha, y.width AS wb, y.height AS hb FROM s x JOIN s y ON x.id < y.id AND {gate}), {_DIST},
link AS (SELECT a, b FROM best WHERE err = 0 UNION SELECT b, a FROM best WHERE err = 0),
reach(id, root) AS (SELECT id, id FROM s UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id WHERE reach.root < link.b),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
page AS (SELECT DISTINCT root, unnest(pages) AS p FROM s JOIN root USING (id))
SELECT u.root AS id, usage, pages FROM (SELECT root, CAST(sum(usage) AS BIGINT) AS usage FROM s JOIN root USING (id) GROUP BY root) u JOIN (SELECT root, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM page GROUP BY root) USING (root)"""


def _united(spark, sf_dir, blocked: bool) -> DataFrame:
    t = _templates(spark, sf_dir)
    return matching.unite(t.select("id", "usage", "pages"), matching.roots(matching.equal_edges(t, blocked))).withColumn("pages", _text("pages"))


@query(_union_sql("abs(x.width - y.width) <= 4 AND abs(x.height - y.height) <= 4"))
def zero_distance_union(spark, sf_dir):
    return _united(spark, sf_dir, False)


@query(_union_sql("x.width = y.width AND x.height = y.height"))
def zero_distance_union_blocked(spark, sf_dir):
    return _united(spark, sf_dir, True)


@query()
def consolidate_symbols(spark, sf_dir):
    """Symbols of every label's page within 3 % of a leader; pages of 50 or fewer stay as they are. A test has brute force."""
    return matching.leaders(_symbols(spark, sf_dir), "label", ["id"], 33, 1, 50)


@query()
def greedy_cluster_first_match(spark, sf_dir):
    """Symbols of every label's page within 5 % of the first such leader. A test has brute force."""
    return matching.leaders(_symbols(spark, sf_dir), "label", ["id"], 20)


@query(f"WITH {_SYM}, old AS (SELECT DISTINCT width, height, words FROM s WHERE label < 5) SELECT min(id) AS id, width, height, array_to_string(words, ',') AS words FROM s WHERE label >= 5 AND (width, height, words) NOT IN (SELECT (width, height, words) FROM old) GROUP BY width, height, words")
def collect_symbols(spark, sf_dir):
    """Whole glyphs of labels from 5 on that a dictionary of the labels before doesn't have."""
    s, by = _symbols(spark, sf_dir), ["width", "height", "words"]
    new = s.where("label >= 5").join(s.where("label < 5").select(*by).distinct(), by, "left_anti").groupBy(*by).agg(F.min("id").alias("id"))
    return new.select("id", "width", "height", _text("words").alias("words"))


@query(f"WITH {_SPX}, {_TRIM}, s AS (SELECT px.vec_id, y - y0 AS y, x - x0 AS x, x - x0 - row_number() OVER (PARTITION BY px.vec_id, y ORDER BY x) AS k FROM px JOIN t USING (vec_id)) SELECT vec_id, y, min(x) AS x0, max(x) AS x1 FROM s GROUP BY vec_id, y, k")
def pbm_round_trip(spark, sf_dir):
    """Trimmed glyphs as binary PBM files, with a comment, and their runs read from these."""
    t = _trimmed(spark, sf_dir)
    head = F.concat(F.lit("P4\n# glyph\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n"))
    rows = F.unhex(bitmap.row_bytes(F.col("words"), F.col("width"), F.col("height")))
    return pbm.runs(pbm.parsed(t.select("vec_id", F.concat(head.cast("binary"), rows).alias("content")), "vec_id"), "vec_id")


@query("SELECT user_id, row_number() OVER w - 1 AS seq, CAST(floor(value * 100) AS BIGINT) - lag(CAST(floor(value * 100) AS BIGINT), 1, 0) OVER w AS value, event_id % 4096 AS id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def integer_round_trip(spark, sf_dir):
    """Each user's differences and 12-bit numbers, coded in turn by the integer and the identity coder, and decoded again."""
    import pyarrow as pa

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.floor(F.col("value") * 100).cast("long")
    e = _t(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("seq"), (v - F.lag(v, 1, 0).over(w)).alias("value"), (F.col("event_id") % 4096).alias("id"))
    every = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "id"))).alias("all"))

    def encoded(batches):
        for batch in batches:
            out = []
            for rows in batch.column("all").to_pylist():
                coder = coding.Encoder()
                for r in rows:
                    coder.integer("IADS", r["value"])
                    coder.identity(r["id"], 12)
                out.append(coder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), pa.array([len(x) for x in batch.column("all")], pa.int64()), pa.array(out, pa.binary())], names=["user_id", "n", "data"])

    def decoded(batches):
        for batch in batches:
            for user, n, data in zip(*(batch.column(c).to_pylist() for c in ("user_id", "n", "data"))):
                d = coding.Decoder(data)
                both = [(d.integer("IADS"), d.identity(12)) for _ in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([user] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array([b[i] for b in both], pa.int64()) for i in (0, 1))], names=["user_id", "seq", "value", "id"])

    return every.mapInArrow(encoded, "user_id long, n long, data binary").mapInArrow(decoded, "user_id long, seq long, value long, id long")


@query(f"WITH {_RUN}, solid AS (SELECT doc_id, y, x0, x1, x0 - coalesce(max(x1) OVER (PARTITION BY doc_id, y ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) AS gap FROM run) SELECT doc_id, y, x0, x1 FROM solid")
def generic_region_round_trip(spark, sf_dir):
    """Every text as a page, coded as a generic region and decoded again."""
    return kernels.decode_pages(kernels.encode_pages(_docs(spark, sf_dir)))


@query(f"WITH {_PX}, s AS (SELECT vec_id, x, y, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS k FROM px) SELECT vec_id, y, min(x) AS x0, max(x) AS x1 FROM s GROUP BY vec_id, y, k")
def generic_document_round_trip(spark, sf_dir):
    """Glyphs as pages of files of generic regions, and the files read again."""
    coded = kernels.encode_glyphs(_contexts(spark, sf_dir)).withColumns({"width": F.lit(8).cast("long"), "height": F.lit(8).cast("long")})
    return container.read_documents(container.generic_documents(coded), "vec_id")


@query(f"WITH {_SYM}, d AS (SELECT DISTINCT label, width, height, words FROM s) SELECT label, row_number() OVER (PARTITION BY label ORDER BY height, width, words) - 1 AS position, width, height, array_to_string(words, ',') AS words FROM d")
def dictionary_round_trip(spark, sf_dir):
    """A dictionary of each label's bitmaps, coded by height classes and decoded again."""
    return container.read_dictionaries(container.dictionaries(_symbols(spark, sf_dir), "label"), "label").withColumn("words", _text("words"))


@query(f"WITH {_INK} SELECT doc_id, y, x0, x1 FROM run")
def symbol_document_round_trip(spark, sf_dir):
    """Texts as pages of files in symbol mode, global and local dictionaries and text regions, and the files read again: every component is a symbol."""
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    # parts of other components inside a box are drawn twice
    return container.read_documents(container.symbol_documents(pages.steps(docs, "shapes"), pages.sizes(docs)))


@query(f"""WITH {_PX}, near AS (SELECT dy, dx, k FROM (SELECT unnest([-2, -2, -2, -2, -2, -1, -1, -1, -1, -1, -1, -1, 0, 0, 0, 0]) AS dy, unnest([-2, -1, 0, 1, 2, -3, -2, -1, 0, 1, 2, 3, -4, -3, -2, -1]) AS dx, unnest(range(15, -1, -1)) AS k)),
own AS (SELECT vec_id, p // 8 AS y, p % 8 AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS p FROM embeddings)),
c AS (SELECT own.vec_id, own.y, own.x, CAST(coalesce(sum(CASE WHEN px.p IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(k AS INT) END), 0) AS BIGINT) AS ctx FROM own CROSS JOIN near LEFT JOIN px ON px.vec_id = own.vec_id AND px.y = own.y + dy AND px.x = own.x + dx GROUP BY 1, 2, 3)
SELECT vec_id, y * 10 // 8 AS tenth, count(DISTINCT ctx) AS contexts, count(*) // count(DISTINCT ctx) AS mean_uses FROM c GROUP BY vec_id, y * 10 // 8""")
def page_context_histogram(spark, sf_dir):
    """Distinct contexts of each tenth of a page's rows, and their whole mean number of uses."""
    e = _contexts(spark, sf_dir).select("vec_id", F.posexplode("ctx").alias("p", "ctx"))
    e = e.withColumn("tenth", F.floor(F.floor(F.col("p") / 8) * 10 / 8).cast("long"))
    n = e.groupBy("vec_id", "tenth").agg(F.countDistinct("ctx").alias("contexts"), F.count("*").alias("n"))
    return n.select("vec_id", "tenth", "contexts", F.floor(F.col("n") / F.col("contexts")).alias("mean_uses"))


@query(f"WITH {_SYM} SELECT height, count(*) AS symbols, string_agg(width || ':' || id, ' ' ORDER BY width, id) AS members FROM s GROUP BY height")
def height_class_members(spark, sf_dir):
    member = F.transform(F.array_sort(F.collect_list(F.struct("width", "id"))), lambda m: F.concat(m["width"].cast("string"), F.lit(":"), m["id"].cast("string")))
    return _symbols(spark, sf_dir).groupBy("height").agg(F.count("*").alias("symbols"), F.array_join(member, " ").alias("members"))


def _diffused(block: str) -> str:
    """The four cells of a grid one after the other, in the order in which their errors are handed on."""
    q = lambda v: f"least(greatest(floor({v} + 0.5), 0), 15)"
    return f"""u AS (SELECT vec_id, max(total) FILTER (gy = 0 AND gx = 0) * 15 / CAST(4080 AS DOUBLE) AS a, max(total) FILTER (gy = 0 AND gx = 1) * 15 / CAST(4080 AS DOUBLE) AS b, max(total) FILTER (gy = 1 AND gx = 0) * 15 / CAST(4080 AS DOUBLE) AS c, max(total) FILTER (gy = 1 AND gx = 1) * 15 / CAST(4080 AS DOUBLE) AS d FROM {block} GROUP BY vec_id),
u1 AS (SELECT *, a - 0.5 * 0 AS pa, {q("a")} AS qa FROM u), u2 AS (SELECT *, pa - qa AS ea FROM u1), u3 AS (SELECT *, b + ea * 8 / 42 - 0.5 * ea AS pb FROM u2), u4 AS (SELECT *, {q("pb")} AS qb FROM u3), u5 AS (SELECT *, pb - qb AS eb FROM u4),
u6 AS (SELECT *, c + ea * 8 / 42 + eb * 4 / 42 - 0.5 * eb AS pc FROM u5), u7 AS (SELECT *, {q("pc")} AS qc FROM u6), u8 AS (SELECT *, pc - qc AS ec FROM u7), u9 AS (SELECT *, d + ea * 4 / 42 + eb * 8 / 42 + ec * 8 / 42 - 0.5 * ec AS pd FROM u8),
gray AS (SELECT vec_id, CAST(unnest([0, 0, 1, 1]) AS BIGINT) AS gy, CAST(unnest([0, 1, 0, 1]) AS BIGINT) AS gx, CAST(unnest([qa, qb, qc, {q("pd")}]) AS BIGINT) AS gray FROM u9)"""


@query(f"WITH {_BLOCK}, {_diffused('block')} SELECT vec_id, gy, gx, gray FROM gray")
def error_diffusion(spark, sf_dir):
    return halftone.error_diffusion(_blocks(spark, sf_dir))


@query(f"""WITH {_CELL}, move AS (SELECT dy, dx FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)),
soft AS (SELECT vec_id, y + dy AS y, x + dx AS x, CAST(sum(value * (2 - abs(dy)) * (2 - abs(dx))) AS BIGINT) // 16 AS value FROM cell, move WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3),
block AS (SELECT vec_id, y // 4 AS gy, x // 4 AS gx, CAST(sum(value) AS BIGINT) AS total FROM soft GROUP BY 1, 2, 3), {_diffused('block')} SELECT vec_id, gy, gx, gray FROM gray""")
def halftone_round_trip(spark, sf_dir):
    """Gray cells smoothed, summed, quantised and coded as Gray-coded bit planes, and decoded again."""
    return halftone.decode(halftone.encode(halftone.gray_cells(_t(spark, sf_dir, "embeddings"))))


@query(f"WITH {_BLOCK} SELECT vec_id, max(gray) AS top, CAST(length(bin(greatest(max(gray), 1))) AS BIGINT) AS bits FROM q GROUP BY vec_id")
def halftone_bit_depth(spark, sf_dir):
    return halftone.depth(halftone.quantize(_blocks(spark, sf_dir)))


@query("SELECT p_partkey, p_partkey % (p_size % 7 + 1) AS grid_x, CAST(p_size % (p_size % 7 + 1) AS BIGINT) AS grid_y, CAST((p_size % 7 + 1) * 256 AS BIGINT) AS vector_x FROM part")
def halftone_grid(spark, sf_dir):
    s = F.col("p_size").cast("long")
    side = s % 7 + 1
    return _t(spark, sf_dir, "part").select("p_partkey", headers.grid_offset(F.col("p_partkey"), side).alias("grid_x"), headers.grid_offset(s, side).alias("grid_y"), headers.grid_vector(side).alias("vector_x"))


@query("""WITH xy AS (SELECT x, y FROM (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y)),
b AS (SELECT x, y, 16 * (2 * ((x + y) % 2) + y % 2) + 4 * (2 * ((x // 2 + y // 2) % 2) + y // 2) AS t FROM xy)
SELECT y, i * 4 + x AS x, CAST(CASE WHEN i * 255 // 15 > t * 255 // 63 THEN 1 ELSE 0 END AS BIGINT) AS black FROM b, (SELECT unnest(range(0, 16)) AS i)""")
def pattern_strip(spark, sf_dir):
    return halftone.strip(halftone.patterns(spark))

