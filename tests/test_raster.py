"""The raster engine: each query against its SQL twin, golden vectors, and small cases by hand."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkframe.operators import bitmap, blocks, coding, dictionary, halftone, kernels, lockstep, matching, pages, raster, segment, sequence
from inkframe.plans import catalog, documents
from inkframe.sources import container, headers, pbm
from inkframe.streaming import templates as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    key = lambda r: tuple(map(str, r))
    assert sorted(key(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(key, want.project(", ".join(names)).fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_twin(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_annex_h2():
    data = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    bits = [(0, b >> (7 - i) & 1) for b in data for i in range(8)]
    want = "84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADF"
    assert kernels.mq_encode(bits, marker=False).hex().upper() == want
    assert kernels.mq_encode(bits).hex().upper() == want + "FFAC"


def test_packing_layout(spark):
    e = [[0.0] * 64]
    e[0][0:8] = [1.0, 0.0] * 4
    e[0][8:16] = [0.0, 1.0] * 4
    g = raster.glyphs(spark.createDataFrame([(1, e[0], 0)], "vec_id long, embedding array<float>, label int")).first()
    assert (g.hi, g.lo) == (0xAA550000, 0)


def _distance(a, b):
    best = []
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            err = 0
            for y in range(8):
                if 0 <= y - dy < 8:
                    for x in range(8):
                        err += (a[y - dy][x - dx] if 0 <= x - dx < 8 else 0) != b[y][x]
            best.append((err, abs(dx) + abs(dy), dy, dx))
    return min(best)


def test_shifted_distance_against_brute_force(spark):
    rnd = random.Random(1)
    pairs = []
    for i in range(60):
        a = [[int(rnd.random() < 0.4) for _ in range(8)] for _ in range(8)]
        b = [[int(rnd.random() < 0.4) for _ in range(8)] for _ in range(8)] if i % 2 else [[a[y - 1][x - 1] if y and x else 0 for x in range(8)] for y in range(8)]
        pairs.append((a, b))
    word = lambda g, s: int("".join(str(v) for r in g[s : s + 4] for v in r), 2)
    df = spark.createDataFrame([(i, word(a, 0), word(a, 4), word(b, 0), word(b, 4)) for i, (a, b) in enumerate(pairs)], "i long, ah long, al long, bh long, bl long")
    got = df.select("i", dictionary.shifted_distance(dictionary.byte_rows("ah", "al"), dictionary.byte_rows("bh", "bl")).alias("m")).orderBy("i").collect()
    assert [tuple(r.m) for r in got] == [_distance(a, b) for a, b in pairs]


def test_component_pixels_sum_to_black(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert segment.components_kernel(e).agg({"n": "sum"}).first()[0] == raster.pixels(e).count()
    assert segment.components_kernel(e, diagonal=False).count() > segment.components_kernel(e).count()


def test_range_class_covers_every_integer(spark):
    kind, bits = sequence.range_class(__import__("pyspark.sql.functions", fromlist=["col"]).col("v"))
    rows = spark.createDataFrame([(v,) for v in (0, -3, 4, -19, 20, 84, 340, -4435, 4436, 2_000_000_001)], "v long").select(kind.alias("k"), bits.alias("b")).collect()
    assert [r.k for r in rows] == [0, 0, 1, 1, 2, 3, 4, 4, 5, None]


def test_error_diffusion_keeps_the_mean(spark):
    cells = spark.createDataFrame([(1, y, x, 1000) for y in range(8) for x in range(8)], "vec_id long, gy long, gx long, total long")
    got = [r.gray for r in halftone.error_diffusion(cells, sharpen=0.0).collect()]
    assert abs(sum(got) / 64 - 1000 * 15 / 4080) < 0.3


def test_pbm_round_trip(spark, tmp_path):
    rows = bytes([0b10110000, 0b01000000, 0b11110000])
    (tmp_path / "a.pbm").write_bytes(b"P4\n# a comment\n5 3\n" + rows)
    assert pbm.parse(pbm.render(5, 3, rows)) == (5, 3, rows)
    page = pbm.read(spark, str(tmp_path / "*.pbm"))
    assert [tuple(r)[1:] for r in pbm.runs(page).orderBy("y", "x0").collect()] == [(0, 0, 0), (0, 2, 3), (1, 1, 1), (2, 0, 3)]
    with pytest.raises(ValueError):
        pbm.parse(b"P4\n5 3\n\x00")
    with pytest.raises(ValueError):
        pbm.parse(b"P1\n5 3\n0")


def test_document_layout():
    data = container.document([(8, 8, b"\x01\x02\xff\xac")])
    assert data[:13] == container.MAGIC + b"\x01\x00\x00\x00\x01"
    assert data[-11:] == container.segment(3, container.END_FILE, 0, b"")
    assert data[13:18] == b"\x00\x00\x00\x00\x30"


def test_dictionary_stream_equals_batch(spark, tmp_path):
    g = raster.glyphs(spark.read.parquet(f"{SF}/embeddings.parquet")).select("vec_id", "hi", "lo")
    g = g.union(g.limit(50))
    g.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.dictionary_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.read_dictionary(spark, str(tmp_path / "out"))
    key = lambda df: sorted(tuple(r) for r in df.select("hi", "lo", "template_id", "usage").collect())
    assert key(got) == key(dictionary.templates(spark.read.parquet(str(tmp_path / "in"))))


def _apart(a, b):
    """(err, cost, dy, dx) by the definition, pixel by pixel."""
    wide, best = max(a.shape[1], b.shape[1]), []
    at = lambda p, y, x: bool(0 <= y < p.shape[0] and 0 <= x < p.shape[1] and p[y, x])
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            err = sum(at(a, y - dy, x - dx) != at(b, y, x) for y in range(b.shape[0]) if 0 <= y - dy < a.shape[0] for x in range(wide))
            if any(0 <= y - dy < a.shape[0] for y in range(b.shape[0])):
                best.append((err, abs(dy) + abs(dx), dy, dx))
    return min(best)


def test_distances_of_any_size():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        (h, w), (k, v) = rnd.integers(1, 9, 2), rnd.integers(1, 40, 2)
        a, b = rnd.random((h, w)) < 0.4, rnd.random((k, v)) < 0.4
        err, dy, dx = matching.distances(a[None], b[None])[0].tolist()
        assert (err, abs(dy) + abs(dx), dy, dx) == _apart(a, b)
    a = rnd.random((9, 33)) < 0.5
    assert matching.distances(a[None], a[None])[0].tolist() == [0, 0, 0] and matching.distances(a[None], ~a[None])[0][0] > 30
    # a golden pair: the second is the first moved by one column, and more rows differ than not
    one = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 1]], bool)
    assert matching.distances(one[None], np.roll(one, 1, 1)[None])[0].tolist()[0] < 4


def _bitmaps(spark, rows):
    """(page, id, width, height, words) of (page, id, boolean rows)."""
    words = lambda b: np.packbits(np.pad(b, ((0, 0), (0, -b.shape[1] % 32))), axis=1).view(">u4").astype(np.int64).ravel().tolist()
    return spark.createDataFrame([(p, i, b.shape[1], b.shape[0], words(b)) for p, i, b in rows], "page long, id long, width long, height long, words array<long>")


@pytest.mark.parametrize(("share", "least", "more_than"), [(20, 0, 0), (33, 1, 50)])
def test_leaders_against_brute_force(spark, share, least, more_than):
    rnd = np.random.default_rng(share)
    rows = []
    for page, n in ((1, 70), (2, 30), (3, 1)):
        base = [rnd.random((rnd.integers(5, 9), rnd.integers(5, 40))) < 0.4 for _ in range(6)]
        for i in range(n):
            b = base[rnd.integers(6)].copy()
            for _ in range(rnd.integers(0, 5)):
                b[rnd.integers(b.shape[0]), rnd.integers(b.shape[1])] ^= True
            rows.append((page, 1000 * page + 7 * i, b))
    want = {}
    for page in (1, 2, 3):
        own, leaders = [r for r in rows if r[0] == page], []
        for _, i, b in own:
            hit = [k for k, x in leaders if abs(x.shape[0] - b.shape[0]) <= 4 and abs(x.shape[1] - b.shape[1]) <= 4 and _apart(x, b)[0] <= max(least, x.size // share)] if len(own) > more_than else []
            want[i] = hit[0] if hit else i
            if not hit:
                leaders.append((i, b))
    got = {r.id: r.leader for r in matching.leaders(_bitmaps(spark, rows), "page", ["id"], share, least, more_than).collect()}
    assert got == want and len(set(want.values())) < len(want) - 40


def test_leaders_over_the_glyphs(spark):
    """The queries keep every glyph, and leaders lead themselves."""
    for name in ("consolidate_symbols", "greedy_cluster_first_match"):
        got = {r.id: r.leader for r in catalog.QUERIES[name](spark, SF).collect()}
        assert set(got) == {r.id for r in documents._symbols(spark, SF).collect()}
        assert all(got[v] == v for v in got.values())


def test_union_and_repoint(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 100), (2, 100), (5, 6)], "id_a long, id_b long")
    root = matching.roots(edges)
    want = {**{i: 10 for i in range(10, 41)}, 3: 2, 2: 2, 100: 2, 5: 5, 6: 5}
    assert {r.id: r.root for r in root.collect()} == want
    t = spark.createDataFrame([(2, 1, [1]), (3, 2, [2, 1]), (100, 4, [9]), (7, 1, [3])], "id long, usage long, pages array<long>")
    assert sorted(map(tuple, matching.unite(t, root).collect())) == [(2, 7, [1, 2, 9]), (7, 1, [3])]
    moved = matching.repoint(spark.createDataFrame([(1, 100), (2, 7)], "page long, template long"), root)
    assert sorted((r.page, r.template) for r in moved.collect()) == [(1, 2), (2, 7)]


def test_coders_round_trip():
    rnd, rng = random.Random(1), np.random.default_rng(0)
    for n in (0, 1, 50, 2000):
        v = [rnd.choice([None, rnd.randrange(-5, 6), rnd.randrange(-400, 400), rnd.randrange(-(10**9), 10**9)]) for _ in range(n)]
        e = coding.Encoder()
        for x in v:
            e.integer("IADW", x)
        d = coding.Decoder(e.finish())
        assert [d.integer("IADW") for _ in v] == v
    with pytest.raises(ValueError):
        coding.Encoder().integer("IADW", 1 << 40)
    for h, w, p in ((1, 1, 0.5), (3, 70, 0.1), (40, 33, 0.5), (5, 5, 0), (2, 2, 1)):
        b = rng.random((h, w)) < p
        assert (coding.Decoder(coding.encode_bitmap(b)).bitmap(w, h) == b).all()
    symbols = sorted([rng.random((rnd.randrange(1, 9), rnd.randrange(1, 40))) < 0.4 for _ in range(60)], key=lambda s: s.shape)
    back = coding.decode_dictionary(coding.encode_dictionary(symbols), 60)
    assert all((a == b).all() for a, b in zip(symbols, back))
    one, two = (len(coding.encode_dictionary(s)) for s in (symbols[:1], symbols[:1] * 2))
    assert two <= 2 * one
    with pytest.raises(ValueError):
        coding.encode_dictionary([])
    placed = sorted((rnd.randrange(100), rnd.randrange(500), rnd.randrange(60)) for _ in range(300))
    assert coding.decode_text(coding.encode_text(placed, symbols), 300, symbols) == placed


def test_symbol_documents_round_trip():
    """Pages with shared and own symbols, without symbols, and without pixels; more than 255 pages; many references."""
    rng = np.random.default_rng(2)
    shared, pages_ = [rng.random((4, 5)) < 0.5 for _ in range(3)], []
    cross = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    for i in range(300):
        found = [(int(rng.integers(0, 20)), int(rng.integers(0, 60)), shared[rng.integers(3)]) for _ in range(rng.integers(0, 4))]
        if i % 3 == 0:
            found.append((2, 3, rng.random((6, 7)) < 0.5))
        pages_.append((70 if i else 0, 30 if i else 1, found if i else []))
    pages_[5] = (70, 30, [(1, 1, cross)] * 2)
    got = container.read_pages(container.symbol_document(pages_))
    for (w, h, found), page in zip(pages_, got, strict=True):
        want = np.zeros((h, w), bool)
        for y, x, b in found:
            part = want[y : y + b.shape[0], x : x + b.shape[1]]
            part |= b[: part.shape[0], : part.shape[1]]
        assert (page == want).all()
    refs = tuple(range(9))
    data = container.MAGIC + b"\x01\0\0\0\x01" + container.segment(300, container.TEXT, 700, b"abc", refs) + container.segment(301, container.END_FILE, 0, b"")
    assert list(container.read_segments(data)) == [(300, container.TEXT, list(refs), 700, b"abc"), (301, container.END_FILE, [], 0, b"")]
    with pytest.raises(ValueError):
        list(container.read_segments(container.MAGIC + b"\x01\0\0\0\x01" + container.segment(1, 9, 1, b"")))
    with pytest.raises(ValueError):
        container.read_pages(b"nothing of the kind")


def test_checks_of_parameters(spark):
    assert headers.RegionParameters().at == headers.AT
    for bad in ({"template": 4}, {"at": [(0, 0)] * 5}, {"operator": 5}):
        with pytest.raises(ValueError):
            headers.RegionParameters(**bad)
    one = spark.createDataFrame([(5, 3, "1" * 15)], "w int, h int, s string")
    assert one.select(bitmap.from_bits(F.col("w"), F.col("h"), F.col("s")).alias("b")).first().b == [0xF8000000] * 3
    with pytest.raises(Exception, match="fill"):
        one.select(bitmap.from_bits(F.col("w"), F.col("h") + 1, F.col("s"))).collect()
    with pytest.raises(Exception, match="fill"):
        one.select(bitmap.from_bytes(F.col("w"), F.col("h"), F.lit(b"abc"))).collect()
    black = spark.createDataFrame([(1, 0, 0)], "vec_id long, x long, y long")
    rect = spark.createDataFrame([(1, 6, 0, 3, 3)], "vec_id long, x0 long, y0 long, width long, height long")
    with pytest.raises(Exception, match="leaves"):
        bitmap.crop(black, rect, spark.createDataFrame([(1, 8, 8)], "vec_id long, page_width long, page_height long")).collect()
    found = spark.createDataFrame([(1, 0, 0, 0, 1, 1, 1, [5])], "doc_id long, comp long, part long, x long, y long, width long, height long, words array<long>")
    with pytest.raises(Exception, match="without a template"):
        pages.resolve(found, pages.dictionary_ids(pages.templates(found)).where("false")).collect()


def test_components_of_pages_from_files(spark, tmp_path):
    """A page from a PBM file, wider than a word, against flood fill."""
    rng = np.random.default_rng(4)
    b = rng.random((25, 45)) < 0.35
    text = "\n".join("".join("e" if v else "." for v in r) for r in b)
    got = pages.components(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "doc_id long, text string")).drop("runs").collect()
    left, want = {tuple(p) for p in np.argwhere(b)}, []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            y, x = p = todo.pop()
            if p in left:
                left.discard(p)
                seen.add(p)
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        y, x = zip(*seen)
        first = min(seen)
        want.append((1, first[0] << 24 | first[1], min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1, len(seen)))
    assert sorted(map(tuple, got)) == sorted(want)
    (tmp_path / "a.pbm").write_bytes(pbm.render(45, 25, np.packbits(b, axis=1).tobytes()))
    runs = pbm.runs(pbm.read(spark, str(tmp_path / "*.pbm")))
    same = pages.runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted(tuple(r)[1:] for r in runs.collect()) == sorted(tuple(r)[1:] for r in same.collect())


def test_error_diffusion_cell_by_cell():
    """Larger grids than the query's, against the recurrence written out."""
    value = np.random.default_rng(3).random((3, 5, 6)) * 15
    for got, grid in zip(halftone.diffuse(value, 16, 0.5), value):
        held, last = grid.copy(), 0.0
        for y in range(5):
            for x in range(6):
                own = held[y, x] - 0.5 * last
                q = min(15, max(0, int(np.floor(own + 0.5))))
                assert got[y, x] == q
                last = own - q
                for dy, dx, w in halftone.SPREAD:
                    if y + dy < 5 and 0 <= x + dx < 6:
                        held[y + dy, x + dx] += last * w / 42


def test_lockstep_coder_equals_the_scalar_one(monkeypatch):
    """Bytes and pixels of many pages at once, with streams that take the place of finished ones, wide pages, stripes, and runs of white."""
    rng, sizes = np.random.default_rng(8), [(1, 1), (1, 300), (40, 1), (30, 70), (3, 900)]
    some = [rng.random(sizes[i % 5]) < (0, 0.03, 0.5, 0.97, 1)[i % 7 % 5] for i in range(90)]
    for b in some[::3]:
        b[:, b.shape[1] // 3 :] = False
    want = [coding.encode_bitmap(b) for b in some]
    monkeypatch.setattr(lockstep, "STRIPE", 500)
    monkeypatch.setattr(lockstep, "WIDE", 400)
    for few, slots in ((0, 5), (3, 30), (24, None)):
        monkeypatch.setattr(lockstep, "FEW", few)
        assert lockstep.encode([lockstep.bitmap_decisions(b) for b in some], 1 << 16, slots) == want
        got = {}
        lockstep.decode_bitmaps([(*b.shape[::-1], d) for b, d in zip(some, want)], got.__setitem__, slots)
        assert sorted(got) == list(range(90)) and all((got[i] == b).all() for i, b in enumerate(some))


def test_pages_are_coded_together(spark, monkeypatch):
    """One batch holds many pages, not a batch for each page."""
    seen = []
    monkeypatch.setattr(lockstep, "encode", lambda streams, contexts, f=lockstep.encode: seen.append(len(streams)) or f(streams, contexts))
    docs = [(i, "ab c\n" * i) for i in range(50)]
    run = []
    frame = type("F", (), {"mapInArrow": lambda self, f, kind: run.append(f)})()
    monkeypatch.setattr(kernels, "spread", lambda df: frame)
    kernels.encode_pages(spark.createDataFrame(docs, "doc_id long, text string"))
    out = list(run[0]([pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["doc_id", "text"])]))
    assert seen == [49] and len(out) == 1 and out[0].num_rows == 50


def _alike(rng, n):
    """(page, id, rows) of many sizes, some of them the same but for a shift or a pixel, some wider than a word."""
    base = [rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.3 for _ in range(8)] + [rng.random((9, 40)) < 0.2 for _ in range(2)]
    out = []
    for i in range(n):
        b = np.roll(base[rng.integers(10)], rng.integers(-1, 2), int(rng.integers(2))).copy()
        b[rng.integers(b.shape[0]), rng.integers(b.shape[1])] |= rng.random() < 0.5
        out.append((int(rng.integers(3)), 13 * i % 997, b))
    return out


def _near_sizes(x, b):
    return abs(x.shape[0] - b.shape[0]) <= 4 and abs(x.shape[1] - b.shape[1]) <= 4


@pytest.mark.parametrize("rows", [7, 4096])
def test_pairs_of_blocks_against_brute_force(spark, rows):
    """Only what is found leaves a task, whatever the blocks are; ties of shifts as by the definition."""
    some = _alike(np.random.default_rng(1), 60)
    want = {}
    for p, i, a in some:
        for q, j, b in some:
            if p == q and i < j and _near_sizes(a, b):
                want[i, j] = _apart(a, b)
    t = _bitmaps(spark, some)
    got = {(r.id_a, r.id_b): (r.err, abs(r.dy) + abs(r.dx), r.dy, r.dx) for r in matching.compare(t, ["page"], rows=rows).collect()}
    assert got == want
    size = {i: b.size for _, i, b in some}
    assert {(r.id_a, r.id_b) for r in matching.compare(t, ["page"], 20, rows=rows).collect()} == {k for k, v in want.items() if v[0] <= size[k[0]] // 20}


@pytest.mark.parametrize("rows", [16, 1 << 15])
@pytest.mark.parametrize("blocked", [False, True])
def test_edges_of_equal_bitmaps_connect_what_the_pairs_do(spark, rows, blocked):
    some = _alike(np.random.default_rng(2), 70)
    own = {i: i for _, i, _ in some}
    for _, i, a in some:
        for _, j, b in some:
            if i < j and (a.shape == b.shape if blocked else _near_sizes(a, b)) and _apart(a, b)[0] == 0:
                x, y = sorted((own[i], own[j]))
                own = {k: x if v == y else v for k, v in own.items()}
    edges = matching.equal_edges(_bitmaps(spark, some), blocked, rows)
    got = {r.id: r.root for r in matching.roots(edges).collect()}
    assert {i: got.get(i, i) for i in own} == own and len(set(own.values())) > 1
    # copies of one bitmap: a forest over each two blocks, not all pairs
    n = 40
    assert matching.equal_edges(_bitmaps(spark, [(1, i, some[0][2]) for i in range(n)]), blocked, rows).count() <= n * -(-n // rows) * 2


@pytest.mark.parametrize("rows", [5, 1 << 14])
def test_hamming_pairs_against_brute_force(spark, rows):
    rnd, words = random.Random(4), []
    for _ in range(12):
        w = rnd.getrandbits(64)
        words += [w, *(w ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 8, 15, 16))]
    g = spark.createDataFrame([(7 * i % 101, w >> 32, w & 0xFFFFFFFF) for i, w in enumerate(words)], "vec_id long, hi long, lo long")
    ids = {7 * i % 101: w for i, w in enumerate(words)}
    want = {(a, b, (x ^ y).bit_count()) for a, x in ids.items() for b, y in ids.items() if a < b and (x ^ y).bit_count() <= 15}
    found = dictionary.hamming_pairs(g, rows=rows)
    assert set(map(tuple, found.collect())) == want and len(want) > 36
    # no row for each template and value near its own
    assert "Generate explode([0" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("stage", sorted(pages.STAGES))
def test_steps_of_pages(spark, monkeypatch, stage):
    """One pass without an exchange, and the same whatever pages are worked on together; blank, empty and missing pages have nothing."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    docs[5:5] = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "xyz \n "), (-5, "a\n" * 40), (-6, "o" * 3000), (-7, "ooo\n\n\n\nooooooooo  \n ao ea\n" * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pages.steps(df, stage, 1, 1.0, 1.0, 0.25, 2)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    names = ["doc_id", *pages.STAGES[stage].split()]
    assert found.columns == names
    key = lambda r: tuple(map(str, r))
    want = sorted(key(r.asDict(True)[n] for n in names) for r in found.collect())
    assert want and not {str(i) for i in (-1, -2, -3, -4)} & {r[0] for r in want}
    # in this process, page by page and all together
    run, sizes = [], []
    frame = type("F", (), {"schema": df.schema, "select": lambda self, *a: self, "mapInArrow": lambda self, f, kind: run.append(f)})()
    pages.steps(frame, stage, 1, 1.0, 1.0, 0.25, 2)
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["doc_id", "text"])
    for chars in (1, 1 << 30):
        monkeypatch.setattr(pages, "CHARS", chars)
        out = list(run[0]([batch]))
        sizes.append(len(out))
        assert sorted(key(r[n] for n in names) for b in out for r in b.to_pylist()) == want
    assert sizes[0] > sizes[1] == 1


def test_leaders_of_many_at_once(monkeypatch):
    """Whatever goes together, leaders are those of one bitmap after the other; the steps for n bitmaps aren't n."""
    rng = np.random.default_rng(6)
    base = [rng.random((rng.integers(3, 9), rng.integers(3, 9))) < 0.3 for _ in range(12)]
    some = [base[i] ^ (rng.random(base[i].shape) < 0.04) for i in rng.integers(12, size=150)]
    shape = np.array([b.shape for b in some])
    sizes = {s: (at, np.stack([some[i] for i in at])) for s, at in blocks.sized(shape[:, 1], shape[:, 0]).items()}
    want, leading = [], []
    for i, b in enumerate(some):
        hit = [k for k in leading if _near_sizes(some[k], b) and _apart(some[k], b)[0] <= some[k].size // 20]
        want.append(hit[0] if hit else i)
        leading += [] if hit else [i]
    calls = []
    monkeypatch.setattr(blocks, "least", lambda a, b, reach, f=blocks.least: calls.append(1) or f(a, b, reach))
    for first, most in ((1, 1), (16, 32), (150, 150)):
        calls.clear()
        assert matching._led(150, sizes, 20, 0, first, most).tolist() == want
    assert 12 < len(leading) < 140 and len(calls) <= len(sizes) ** 2


def test_text_regions_in_lockstep(monkeypatch):
    """Bytes and instances of many text regions at once: those of the scalar coder, with regions of one symbol or no instance among them."""
    rnd, some = random.Random(3), []
    for k in range(80):
        symbols = [np.zeros((1, rnd.randrange(1, 60)), bool) for _ in range((1, 2, 3, 40, 300)[k % 5])]
        some.append((sorted((rnd.randrange(90), rnd.randrange((50, 9000)[k % 2]), rnd.randrange(len(symbols))) for _ in range((0, 1, 5, 60)[k % 4])), symbols))
    want = [coding.encode_text(*s) for s in some]
    asked = [(d, len(i), np.array([b.shape[1] for b in s])) for d, (i, s) in zip(want, some)]
    for few, slots in ((0, 5), (24, 30), (24, None)):
        monkeypatch.setattr(lockstep, "FEW", few)
        assert lockstep.encode([coding.text_decisions(*s) for s in some], coding.IDS + 512, slots) == want
        back = lockstep.decode_texts(asked, slots)
        assert [list(zip(*(v.tolist() for v in b))) for b in back] == [i for i, _ in some]


def test_files_are_coded_together(monkeypatch):
    """The text regions of several files are one call, and the files those of each alone."""
    rng = np.random.default_rng(9)
    files = [[(40, 20, [(int(rng.integers(15)), int(rng.integers(30)), rng.random((3, 2 + i % 3)) < 0.6) for i in range(6)]) for _ in range(3)] for _ in range(4)]
    seen = []
    monkeypatch.setattr(lockstep, "encode", lambda streams, contexts, f=lockstep.encode: seen.append(len(streams)) or f(streams, contexts))
    monkeypatch.setattr(lockstep, "decode_texts", lambda streams, f=lockstep.decode_texts: seen.append(len(streams)) or f(streams))
    data = container.symbol_files(files)
    back = list(container.read_files(data))
    assert seen == [12, 12] and data == [container.symbol_document(f) for f in files]
    for pages_, got in zip(files, back):
        for (w, h, found), page in zip(pages_, got, strict=True):
            assert (page == coding.draw(w, h, [(y, x, i) for i, (y, x, _) in enumerate(found)], [b for *_, b in found])).all()
