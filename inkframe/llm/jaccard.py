"""N-gram Jaccard join (operator 7): a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (equal sets are one class), columns are 64-bit shingle hashes. Each row's
columns are put in one order for all, hot columns last. Two sets with Jaccard similarity t or more share a column
among the first n - ceil(t n) + 1 of each, so only that block of columns is looked at to find candidates; sizes and
positions bound the overlap a pair can still reach and discard it early.

First the components. A column shared by many rows isn't multiplied out. Its leader, the row with the fewest colder columns
of its own, meets every other: an edit of a copy makes columns that only it has, so this row is the copy edited least, and
linked with the most. Overlaps of these pairs are accumulated exactly, block by block of the hash range, until they are
reached or out of reach. Columns whose rows lie in several components get further leaders while the rest would be more
than ``PAIRS`` pairs per row, ``ROUNDS`` times at most; then all pairs of rows across components are looked at, a column of
many rows in blocks of ``BLOCK`` by ``BLOCK`` rows. :func:`groups` ends here.

All links lie within components, so :func:`join` then multiplies each component by itself: its rows are dealt to blocks of
about ``BLOCK``, each pair of blocks is a task's work, and the product of their rows is accumulated over blocks of
``COLUMNS`` shared columns. Every two classes of a component are compared, but a task returns the number of links of each
row, not the pairs; :func:`links` lists them.

Which columns are hot comes from the counts of all columns in a table of 2**20 slots. It only orders the columns: any
order gives the same result.

A text without words, or null, has an empty set and is linked with nothing, itself its component. Equal rows are one
class. Keys may be null or repeat; the component id is the smallest key in the component (null only if all are). An empty
table gives no rows. Other columns aren't read, so none can clash. Long texts are a step of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K
from inkframe.llm.common import Scratch, components

SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 80
SLOT_BITS = 20
#: Pairs across components, per row of the matrix, up to which all are looked at.
PAIRS = 4
#: Rounds of leaders, after which all pairs across components are looked at in any case.
ROUNDS = 3
_BLOCKS = 8
#: Rows of a column, and sets of a block of a component, that one task takes on either side.
BLOCK = 512
#: Columns of one step of a product.
COLUMNS = 4096


def sets_of(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingles, ascending."""
    low = K.LOWER[buf]
    starts, ends, counts = K.word_spans(low, off, K.SPACED)
    h, counts = K.shingles(K.span_hash(low, starts, ends), counts, k)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(counts) < 65536 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(counts))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _hot(batches):
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    held, n = [], 0
    for _, buf, off in K.steps(batches):
        held.append(_slot(sets_of(buf, off)[0]).astype(np.int32))
        n += len(held[-1])
        if n > 1 << 21:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])


def hot_columns(docs: DataFrame) -> np.ndarray:
    """Rank of each slot, by the number of texts with one of its columns; a table of fixed size."""
    table = np.zeros(1 << SLOT_BITS)
    rows = docs.mapInArrow(_hot, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(np.rint(np.log2(table + 1) * 8), 65535).astype(np.uint16)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _rows(shared, percent: int):
    """(key, n, one, two, prefix): size, signature and first columns of each text's set."""

    def run(batches):
        for batch, buf, off in K.steps(batches):
            h, n = sets_of(buf, off)
            ends = np.cumsum(n)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h * np.uint64(c)), dtype=np.uint64)]) for c in (3, 0x9E3779B97F4A7C15)]
            one, two = (K.signed(t[ends] - t[ends - n]) for t in total)
            rank = shared.value[_slot(h)]
            doc = np.repeat(np.arange(len(n)), n)
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(doc[order], kind="stable")]
            take = prefix_size(n, percent)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(K.signed(h[order][K.ragged(ends - n, take)])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(one), pa.array(two), prefix], names=["key", "n", "one", "two", "prefix"])

    return run


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the similarity; overlaps are added up by blocks of the hash range."""
    # 100 i >= percent (|a| + |b| - i)
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    cuts = (np.arange(1, _BLOCKS, dtype=np.uint64) << np.uint64(61)).astype(np.uint64)
    ca, cb = ([0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in (a, b))
    have = 0
    for i in range(_BLOCKS):
        if have + min(len(a) - ca[i], len(b) - cb[i]) < need:
            return False
        x, y = a[ca[i] : ca[i + 1]], b[cb[i] : cb[i + 1]]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            have += int((y[at] == x).sum())
    return have >= need


def _packed(batches):
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch, _, _ in K.steps(batches, "text", 4 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([z.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["key", "z"])


def _unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of the sets of packed texts."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(x) for x in packed]
    return sets_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def _parts(packed: list[bytes]) -> list[np.ndarray]:
    h, n = _unpack(packed)
    return np.split(h, np.cumsum(n)[:-1])


#: Packed bytes that are opened together.
_OPENED = 256 << 10


def _slices(sizes: list[int]):
    """Ranges of consecutive rows of about ``_OPENED`` bytes."""
    total, at = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= _OPENED or i + 1 == len(sizes):
            yield at, i + 1
            total, at = 0, i + 1


def _verify(percent: int):
    """Pairs with whether they are linked; rows come sorted by a."""

    def run(batches):
        for batch in batches:
            a, b, za, zb = (batch.column(n).to_pylist() for n in ("a", "b", "za", "zb"))
            linked = []
            for i, j in _slices([len(x) for x in zb]):
                names = list(dict.fromkeys(a[i:j]))
                first = [a.index(x, i) for x in names]
                sets = _parts([za[f] for f in first] + zb[i:j])
                mine = dict(zip(names, sets))
                linked += [overlap_reaches(mine[x], y, percent) for x, y in zip(a[i:j], sets[len(names) :])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _same_set(batches):
    """Rows of texts whose set has the wanted signature."""
    for batch in batches:
        z, wanted = batch.column("z").to_pylist(), list(zip(*(batch.column(c).to_pylist() for c in ("n", "one", "two"))))
        keep = []
        for i, j in _slices([len(x) for x in z]):
            for h, want in zip(_parts(z[i:j]), wanted[i:j]):
                mine = [int(K.mix(h * np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (3, 0x9E3779B97F4A7C15)]
                keep.append((len(h), *mine) == want)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("z")], names=["row", "z"]).filter(pa.array(keep, pa.bool_()))


def _matrix(docs: DataFrame, key: str, text: str, percent: int) -> tuple[Scratch, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scratch, docs, table, cells, classes): the texts' rows, the first columns that several classes share, the classes."""
    spark = docs.sparkSession
    s = Scratch(spark, "jaccard")
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranks = spark.sparkContext.broadcast(hot_columns(docs.select("text")))
    table = docs.mapInArrow(_rows(ranks, percent), f"key {kind}, n long, one long, two long, prefix array<long>")
    table = s.store(table.withColumn("row", F.monotonically_increasing_id()), "rows")

    by = ["n", "one", "two"]
    # one row per class: its first text stands for it
    first = F.min_by(F.struct("key", "prefix"), "row")
    reps = table.where("n > 0").groupBy(*by).agg(F.min("row").alias("row"), first.alias("f"))
    cells = reps.select("row", "n", F.posexplode("f.prefix").alias("pos", "gram"))
    shared = cells.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    cells = s.store(cells.join(shared, "gram"), "cells")
    classes = table.where("n > 0").groupBy(*by).agg(F.min("row").alias("row"), F.min_by("key", "row").alias("rep"), F.min("key").alias("least"), F.count("*").alias("size"))
    return s, docs, table, cells, s.store(classes, "classes")


def _members(key: str, table: DataFrame, classes: DataFrame, comp: DataFrame | None, *more: str) -> DataFrame:
    """(key, n_shingles, class_id, component_id, columns of the classes, 0 for empty sets) of every text."""
    by = ["n", "one", "two"]
    base = classes.select(*by, "row", "least", *more)
    if comp is not None:
        base = base.join(comp.withColumnRenamed("v", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        base = base.drop("least").join(base.groupBy("comp").agg(F.min("least").alias("least")), "comp")
    ids = base.select(*by, F.col("row").alias("class_id"), F.col("least").alias("component_id"), *more)
    full = table.select("key", "row", *by)
    out = full.where("n > 0").join(ids, by).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "class_id", "component_id", *more)
    return out.union(full.where("n = 0").select("key", "n", F.col("row"), "key", *(F.lit(0).cast("long") for _ in more)))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, class_id, component_id, n_links) of every text; class_id numbers equal sets, n_links counts the other texts it is linked with."""
    s, docs, table, cells, classes = _matrix(docs, key, text, percent)
    comp = _components(docs, cells, classes, percent, s)
    if comp is None:
        return _members(key, table, classes.withColumn("n_links", F.col("size") - 1), comp, "n_links")
    pair, blocks = _dealt(comp, docs, classes, s)
    met = blocks.mapInArrow(_product(percent, False), "row long, met long")
    met = met.union(pair.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("nb").alias("met")), F.struct(F.col("b").alias("row"), F.col("na").alias("met")))).alias("m")).select("m.*"))
    counted = classes.join(s.store(met.groupBy("row").agg(F.sum("met").alias("met")), "met"), "row", "left")
    return _members(key, table, counted.withColumn("n_links", F.col("size") - 1 + F.coalesce("met", F.lit(0))), comp, "n_links")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((key, n_shingles, class_id, component_id) of every text, all linked pairs (a, b) of class_ids with a < b)."""
    s, docs, table, cells, classes = _matrix(docs, key, text, percent)
    comp = _components(docs, cells, classes, percent, s)
    if comp is None:
        return _members(key, table, classes, comp), docs.sparkSession.createDataFrame([], "a long, b long")
    pair, blocks = _dealt(comp, docs, classes, s)
    return _members(key, table, classes, comp), blocks.mapInArrow(_product(percent, True), "a long, b long").union(pair.select("a", "b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, class_id, component_id) of every text: the components of :func:`join`, not the links."""
    s, docs, table, cells, classes = _matrix(docs, key, text, percent)
    return _members(key, table, classes, _components(docs, cells, classes, percent, s))


def _dealt(comp: DataFrame, docs: DataFrame, classes: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, na, nb) of components of two classes, with how many texts each has; rows of the larger ones, dealt and sorted by pairs of blocks)."""
    rows = s.store(comp.withColumnRenamed("v", "row").join(classes.select("row", "size"), "row"), "sized")
    per = rows.groupBy("comp").agg(F.count("*").alias("count"), F.min(F.struct("row", "size")).alias("x"), F.max(F.struct("row", "size")).alias("y"))
    pair = per.where("count = 2").select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb"))
    many = rows.join(per.where("count > 2").select("comp", F.ceil(F.col("count") / BLOCK).alias("k")), "comp")
    texts = _texts(many.select("row"), classes, docs, s, "texts")
    own, other = F.pmod(F.xxhash64("row"), "k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    cells = many.join(texts, "row").select("comp", own.alias("own"), other.alias("other"), "row", "size", "z")
    cells = cells.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "size", "z")
    return pair, cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")


def products(sets: np.ndarray, own: np.ndarray, others: np.ndarray, theirs: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Overlaps of rows: ``sets`` are the columns of the rows ``own`` of one block, ``others`` those of ``theirs`` of another; no row has a column twice."""
    out = np.zeros(shape, np.float32)
    shared = np.intersect1d(sets, others)
    for at in range(0, len(shared), COLUMNS):
        block = shared[at : at + COLUMNS]
        sides = []
        for columns, row, n in ((sets, own, shape[0]), (others, theirs, shape[1])):
            place = np.minimum(np.searchsorted(block, columns), len(block) - 1)
            hit = block[place] == columns
            side = np.zeros((n, len(block)), np.float32)
            side[row[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def _product(percent: int, pairs: bool):
    """Links of the rows of each pair of blocks: (a, b), or how many texts each row is linked with."""

    def multiplied(key, held):
        _, i, j = key
        own, row, size = (np.array(x, np.int64) for x in zip(*((h[0], h[1], h[2]) for h in held)))
        h, n = _unpack([x[3] for x in held])
        of = np.repeat(np.arange(len(n)), n)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        place = np.full(len(n), -1)
        place[right] = np.arange(len(right))
        mine, other = own[of] == i, own[of] == j
        index = np.full(len(n), -1)
        index[left] = np.arange(len(left))
        have = products(h[mine], index[of[mine]], h[other], place[of[other]], (len(left), len(right)))
        near = 100 * have >= percent * (n[left][:, None] + n[right][None, :] - have)
        if i == j:
            np.fill_diagonal(near, False)
        if pairs:
            x, y = np.nonzero(near)
            a, b = row[left[x]], row[right[y]]
            keep = a < b if i == j else np.ones(len(a), bool)
            return [np.minimum(a, b)[keep], np.maximum(a, b)[keep]]
        met = [(row[left], near @ size[right])] + ([] if i == j else [(row[right], near.T @ size[left])])
        return [np.concatenate(x) for x in zip(*met)]

    def run(batches):
        last, held, names = None, [], ["a", "b"] if pairs else ["row", "met"]
        for batch in batches:
            for comp, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "own", "row", "size", "z"))):
                if (comp, i, j) != last:
                    if held:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, multiplied(last, held))], names=names)
                    last, held = (comp, i, j), []
                held.append(rest)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, multiplied(last, held))], names=names)

    return run


def _possible(percent: int) -> Column:
    """Whether sizes na, nb and places pa, pb of a shared column leave the similarity within reach."""
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    bound = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (bound >= need)


def _components(docs: DataFrame, cells: DataFrame, classes: DataFrame, percent: int, s: Scratch) -> DataFrame | None:
    """(v, comp) of the classes that are linked with others; None where there are no links."""
    cells = cells.drop("m")
    done = None
    comp = None
    rest = cells
    size, i = cells.select("row").distinct().count(), 0
    while True:
        if comp is None:
            now = rest.withColumn("comp", F.col("row"))
        else:
            now = rest.join(comp.withColumnRenamed("v", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        # columns whose rows aren't all in one component, and what multiplying them out would take
        per = now.groupBy("gram", "comp").agg(F.count("*").alias("k"), F.min(F.struct("pos", "row")).alias("lead")).groupBy("gram").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.min("lead")["row"].alias("lead"), F.count("*").alias("comps")).where("comps > 1")
        now = s.store(now.join(per.select("gram", "lead", "m", "kk"), "gram"), f"open{i}")
        s.drop("cells" if not i else f"open{i - 1}")
        total = now.select("gram", "m", "kk").distinct().agg(F.sum((F.col("m") * F.col("m") - F.col("kk")) / 2), F.sum("m")).first()
        if not total[1]:
            break
        last = i >= ROUNDS or total[0] <= max(PAIRS * size, 1000)
        x = now.select("gram", "m", F.col("row").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
        y = now.select("gram", "m", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), "lead")
        if last:
            # every pair of a column's blocks is a key of its own
            k = F.ceil(F.col("m") / BLOCK)
            every = F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
            x = x.withColumn("i", F.pmod(F.xxhash64("a"), k)).withColumn("j", every)
            y = y.withColumn("j", F.pmod(F.xxhash64("b"), k)).withColumn("i", every)
            pairs = x.join(y, ["gram", "i", "j"]).where("ca != cb AND a < b")
        else:
            x = x.join(now.select("gram", F.col("lead").alias("a")).distinct(), ["gram", "a"])
            pairs = x.join(y.where("b != lead"), "gram").where("ca != cb")
        pairs = pairs.where(_possible(percent))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = s.store(pairs, f"pairs{i}")
        checked = s.store(_checked(pairs, classes, docs, percent, s, i), f"checked{i}")
        s.drop(f"pairs{i}", f"texts{i}")
        done = checked if done is None else done.union(checked)
        # without new links the components stay as they are
        found = checked.where("linked").select("a", "b")
        if not found.isEmpty():
            stars = found if comp is None else found.union(comp.select(F.col("v").alias("a"), F.col("comp").alias("b")))
            old = [n for n in s.paths if n.startswith("comp")]
            comp = s.store(components(stars, s, f"cc{i}_"), f"comp{i}")
            s.drop(*old, *(n for n in list(s.paths) if n.startswith("cc")))
        if last:
            break
        rest = now.where("row != lead").select("gram", "row", "n", "pos")
        i += 1

    s.drop(*(f"{n}{k}" for n in ("open", "checked") for k in range(i + 1)))
    return comp


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, s: Scratch, i: int) -> DataFrame:
    """(a, b, linked): the pairs' exact overlaps, from the texts of the classes' first rows."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    texts = _texts(ends, classes, docs, s, f"texts{i}")
    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("row").alias("a"), F.col("z").alias("za")), "a")
    return both.select("a", "b", "za", "zb").sortWithinPartitions("a").mapInArrow(_verify(percent), "a long, b long, linked boolean")


def _texts(ends: DataFrame, classes: DataFrame, docs: DataFrame, s: Scratch, name: str) -> DataFrame:
    """(row, z): the packed texts of the wanted classes' first rows."""
    wanted = ends.join(classes, "row").select("row", F.col("rep").alias("key"), "n", "one", "two")
    kind = docs.schema["key"].dataType.simpleString()
    packed = docs.where("text IS NOT NULL").mapInArrow(_packed, f"key {kind}, z binary")
    texts = packed.withColumnRenamed("key", "k").join(wanted, F.col("k").eqNullSafe(F.col("key"))).select("row", "z", "n", "one", "two")
    # keys may repeat: the set itself says which text is meant
    return s.store(texts.mapInArrow(_same_set, "row long, z binary").dropDuplicates(["row"]), name)
