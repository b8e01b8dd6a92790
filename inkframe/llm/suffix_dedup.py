"""Suffix dedup (operator 1): removes bytes covered by a 400-byte string that starts elsewhere too.

Bucket-pointer refinement, dealt out and cut off at depth ``length``. Suffixes begin in the buckets of their first 8
bytes. A round refines every bucket by the identifier, of the round before, of the bucket that the suffix lies in so many
bytes later, so that identifiers of 16, 32, 64, ... bytes each reuse those found just before (:func:`names`); two of
them, overlapping, name a string of any size. An identifier is a 64-bit hash of the two it comes from, in place of a rank:
any task finds the same one alone, and no round has to sort all suffixes of the corpus.

Only anchors enter the sorts that span the cluster: the least 64-byte identifier of each ``length``-byte window. A window's
anchor depends on its bytes alone, so equal windows meet in the bucket of one anchor, at one offset. These buckets are
refined by later (and earlier) offsets until only strings that agree for ``length`` bytes share one: first by the whole
run of windows that an anchor stands for (equal runs settle all their windows); where a bucket still has several, by
groups of ``GROUP`` window starts, dropped if their common bytes occur once and settled if all their bytes occur
twice; last by single windows. Each is an aggregation that combines before the shuffle, so a bucket of any size is never
in one task.

With ``words``, passages of so many words `[^\x20\x09-\x0D]+` that stand in two rows go as well, however few bytes they have and
whatever space is between the words (:func:`passage_spans`). They are found in the same way: identifiers of 1, 2, 4, ... words,
an anchor (of ``WORD_QGRAM`` words) for each window, whole runs of windows, then single windows.

Texts are UTF-8 bytes; null counts as empty (its text stays null), and texts shorter than ``length`` lose nothing, an
empty table gives no rows. Long texts are worked on in segments. Equal rows are copies of one another, so both lose what
they share; keys aren't read. Columns named like a result give way to it; others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K
from inkframe.llm.common import Scratch

LENGTH, QGRAM = 400, 64
GROUP = 16
WORD_QGRAM = 16
#: Windows of one step of the sliding minimum; positions in it take 24 bits.
_SEGMENT = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
RESULTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, k = v, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    n = len(v) - width + 1
    return np.minimum(out[:n], out[width - k : width - k + n])


def names(buf: np.ndarray, least: int, most: int) -> dict[int, np.ndarray]:
    """Bucket identifiers of the strings of ``least`` * 1, 2, 4, ... bytes from each place on, while shorter than ``most``.

    The first buckets are the 8 bytes at a place; a round refines each by the identifier, of the round before, of what follows.
    """
    return doubled(K.mix(K.eights(buf)[: max(len(buf) - 7, 0)]), 8, least, most)


def doubled(now: np.ndarray, size: int, least: int, most: int) -> dict[int, np.ndarray]:
    """The rounds of :func:`names` from identifiers of ``size`` items at each place on."""
    out = {}
    while size < most:
        if size >= least:
            out[size] = now
        now = K.pair_name(now[: max(len(now) - size, 0)], now[size:])
        size *= 2
    return out


def span_names(ids: dict[int, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifier of each span: of the longest strings with one that begin and end it, which overlap or meet, and its size."""
    out = np.zeros(len(start), np.uint64)
    for size, name in ids.items():
        some = np.flatnonzero((end - start >= size) & (end - start < 2 * size))
        if len(some):
            out[some] = K.pair_name(name[start[some]], name[end[some] - size] ^ K.mix((end - start)[some].astype(np.uint64)))
    return out


def _anchored(ids: dict[int, np.ndarray], first: np.ndarray, last: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(bucket, run, lo, hi, left): the windows lo..hi of each anchor; ``first`` and ``last`` are the texts in which windows begin and end."""
    part, m = ids[q], len(first)
    at = (_sliding_min((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), length - q + 1) & _LOW).astype(np.int64)
    new = np.ones(m, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], m) - 1
    ok = first[lo] == last[lo]
    lo, hi = lo[ok], hi[ok]
    left = at[lo] - lo
    run = span_names(ids, lo, hi + length) ^ K.mix(left.astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64))
    return part[at[lo]], run, lo, hi, left


def runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = QGRAM) -> tuple[np.ndarray, ...]:
    """(bucket, run, text, lo, span, left): for each anchor the windows lo..lo + span of one text that it stands for; it is at lo + left."""
    empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    n = len(buf) - length + 1
    if n < 1:
        return empty
    width = length - q + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = []
    for s in range(0, n, _SEGMENT):
        m = min(_SEGMENT, n - s)
        ids = names(buf[s : s + m + length - 1], q, length + width)
        bucket, run, lo, hi, left = _anchored(ids, doc[s : s + m], doc[s + length - 1 : s + length - 1 + m], length, q)
        text = doc[lo + s]
        out.append((bucket, run, text, lo + s - off[text], hi - lo, left))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else empty


def word_runs(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(bucket, run, text, begin, end): for each anchor the bytes of the windows of ``words`` words of one text that it stands for."""
    starts, ends, counts = K.word_spans(buf, off, K.SPACED)
    q = 1 << (min(WORD_QGRAM, words).bit_length() - 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3]
    n = len(starts) - words + 1
    for s in range(0, n, _SEGMENT):
        m = min(_SEGMENT, n - s)
        a, z = starts[s : s + m + words - 1], ends[s : s + m + words - 1]
        ids = doubled(K.span_hash(buf[a[0] : z[-1]], a - a[0], z - a[0]), 1, q, 2 * words)
        bucket, run, lo, hi, _ = _anchored(ids, doc[s : s + m], doc[s + words - 1 : s + words - 1 + m], words, q)
        text = doc[lo + s]
        out.append((bucket, run, text, a[lo] - off[text], z[hi + words - 1] - off[text]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(text: str):
    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch, _, _ in K.steps(batches, text, 4 << 20):
            at = batch.schema.get_field_index(text)
            packed = pa.array([None if t is None else z.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), packed], names=[*(c for c in batch.schema.names if c != text), "_z"])

    return run


def _unpacked(batches, columns: list[str], most: int = K.STEP_BYTES):
    """Steps of (rows, bytes, offsets) over compressed texts."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for batch in batches:
        rest = batch.select(columns)
        held, begin, size = [], 0, 0
        for i, data in enumerate(batch.column("_z")):
            data = data.as_py()
            held.append(b"" if data is None else z.decompress(data))
            size += len(held[-1])
            if size >= most or i + 1 == batch.num_rows:
                off = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                yield rest.slice(begin, len(held)), np.frombuffer(b"".join(held), np.uint8), off
                held, begin, size = [], i + 1, 0
    K.release()


def _find_runs(batches):
    for rows, buf, off in _unpacked(batches, ["_row"]):
        a, r, doc, lo, span, left = runs(buf, off)
        row = rows.column("_row").to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (K.signed(a), K.signed(r), row, lo.astype(np.int32), span.astype(np.int32), left.astype(np.int32)))], names=["a", "r", "row", "lo", "span", "left"])


def _contexts(batches):
    """(id, a, one, row, lo, span, left, bytes): each open class with the bytes of its windows."""
    for rows, buf, off in _unpacked(batches, ["_row", "all"]):
        out = []
        for i, (row, every) in enumerate(zip(rows.column("_row").to_pylist(), rows.column("all").to_pylist())):
            out += [(c["id"], c["a"], c["one"], row, c["lo"], c["span"], c["left"], buf[off[i] + c["lo"] : off[i] + c["lo"] + c["span"] + LENGTH].tobytes()) for c in every]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "a", "one", "row", "lo", "span", "left", "bytes"])


def _keyed(a: np.ndarray, tag: np.ndarray, h: np.ndarray) -> np.ndarray:
    return K.signed(K.mix(h ^ K.mix(a.view(np.uint64) + tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def _groups(batches):
    """(core, whole, id, j, one, row, begin, end): groups of window starts; whole is null where the class has only part of a group."""
    for batch, buf, off in K.steps(batches, "bytes"):
        a, row, lo, span, left = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "row", "lo", "span", "left"))
        low, high = (left - span) // GROUP, left // GROUP
        count = high - low + 1
        i, j = np.repeat(np.arange(len(a)), count), K.ragged(low, count)
        # distances from the anchor back to the window starts
        near, far = np.maximum(j * GROUP, (left - span)[i]), np.minimum(j * GROUP + GROUP - 1, left[i])
        base = off[i] + left[i]
        ids = names(buf, 256, 512)
        core = _keyed(a[i], j, span_names(ids, base - j * GROUP, base - j * GROUP - GROUP + 1 + LENGTH))
        full = far - near == GROUP - 1
        whole = _keyed(a[i], j + 1000, span_names(ids, base - far, base - near + LENGTH))
        at = lo[i] + left[i]
        yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole, mask=~full), batch.column("id").take(pa.array(i)), pa.array(j), batch.column("one").take(pa.array(i)), pa.array(row[i]), pa.array(at - far), pa.array(at - near + LENGTH)], names=["core", "whole", "id", "j", "one", "row", "begin", "end"])


def _windows(batches):
    """(key, row, begin, open): the single windows of some groups; ``todo`` lists (j, open)."""
    for batch, buf, off in K.steps(batches, "bytes"):
        a, row, lo, span, left = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "row", "lo", "span", "left"))
        todo = batch.column("todo").to_pylist()
        i = np.repeat(np.arange(len(a)), [len(t) for t in todo])
        j = np.array([x["j"] for t in todo for x in t], np.int64)
        is_open = np.array([x["open"] for t in todo for x in t], bool)
        near, far = np.maximum(j * GROUP, (left - span)[i]), np.minimum(j * GROUP + GROUP - 1, left[i])
        count = far - near + 1
        g, d = np.repeat(np.arange(len(i)), count), K.ragged(near, count)
        at = off[i[g]] + left[i[g]] - d
        key = _keyed(a[i[g]], d + 100_000, span_names(names(buf, 256, 512), at, at + LENGTH))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (key, row[i[g]], (lo + left)[i[g]] - d, is_open[g]))], names=["key", "row", "begin", "open"])


def _find_word_runs(words: int):
    def run(batches):
        for rows, buf, off in _unpacked(batches, ["_row"]):
            a, r, doc, begin, end = word_runs(buf, off, words)
            row = rows.column("_row").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (K.signed(a), K.signed(r), row, begin, end))], names=["a", "r", "row", "begin", "end"])

    return run


def _word_windows(words: int):
    """(key, row, begin, end, many): the single windows of some runs; ``all`` lists (a, many, begin, end)."""

    def run(batches):
        for rows, buf, off in _unpacked(batches, ["_row", "all"]):
            size, every = rows.column("all").value_lengths().to_numpy().astype(np.int64), rows.column("all").flatten()
            a, begin, end = (every.field(c).to_numpy() for c in ("a", "begin", "end"))
            many, text = every.field("many").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
            starts, ends, _ = K.word_spans(buf, off, K.SPACED)
            first = np.searchsorted(starts, off[text] + begin)
            count = np.searchsorted(ends, off[text] + end) - first + 2 - words
            i, at = np.repeat(np.arange(len(a)), count), K.ragged(first, count)
            ids = doubled(K.span_hash(buf, starts, ends), 1, 1 << (words.bit_length() - 1), words + 1)
            key, doc = _keyed(a[i], np.zeros(len(i), np.int64), span_names(ids, at, at + words)), text[i]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (key, rows.column("_row").to_numpy()[doc], starts[at] - off[doc], ends[at + words - 1] - off[doc], many[i]))], names=["key", "row", "begin", "end", "many"])

    return run


def _cut(names: list[str], with_text: bool):
    def run(batches):
        for rows, buf, off in _unpacked(batches, [*names, "_spans", "_z"]):
            out, texts = [], []
            for i, (spans, z) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_z"))):
                own = buf[off[i] : off[i + 1]]
                mark = np.zeros(len(own) + 1, np.int32)
                if spans:
                    np.add.at(mark, [s["begin"] for s in spans], 1)
                    np.add.at(mark, [s["end"] for s in spans], -1)
                gone = np.cumsum(mark[:-1]) > 0
                kept = own[~gone].tobytes()
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(own), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
                texts.append(kept.decode("utf-8", "ignore") if z.is_valid else None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *columns, *([pa.array(texts, pa.string())] if with_text else [])], names=[*names, *RESULTS, *(["_kept"] if with_text else [])])

    return run


def repeated_spans(packed: DataFrame, s: Scratch) -> DataFrame:
    """(row, begin, end): byte spans of ``packed`` (_row, _z) whose every window occurs twice; they overlap."""
    found = s.store(packed.select("_row", "_z").mapInArrow(_find_runs, "a long, r long, row long, lo int, span int, left int"), "runs")
    classes = s.store(found.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "span", "left")).alias("f")), "classes")
    several = classes.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1").select("a")
    open_ = classes.join(several, "a").select("a", (F.col("c") == 1).alias("one"), "f.*", F.xxhash64("a", "r").alias("id"))
    settled = found.join(classes.where("c > 1").select("a", "r"), ["a", "r"]).select("row", F.col("lo").cast("long").alias("begin"), (F.col("lo") + F.col("span") + LENGTH).cast("long").alias("end"))
    by_row = open_.groupBy("row").agg(F.collect_list(F.struct("id", "a", "one", "lo", "span", "left")).alias("all"))
    near = packed.select("_row", "_z").join(by_row.withColumnRenamed("row", "_row"), "_row")
    context = s.store(near.mapInArrow(_contexts, "id long, a long, one boolean, row long, lo int, span int, left int, bytes binary"), "contexts")

    groups = s.store(context.mapInArrow(_groups, "core long, whole long, id long, j long, one boolean, row long, begin long, end long"), "groups")
    twice = groups.where("whole IS NOT NULL").groupBy("whole").agg(F.count("*").alias("m")).where("m > 1").select("whole", F.lit(True).alias("hit"))
    # partial groups have a key of their own, so that they don't meet in one task
    groups = groups.withColumn("whole", F.coalesce("whole", F.xxhash64("id", "j")))
    groups = s.store(groups.join(twice, "whole", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "groups2")
    s.drop("groups")
    whole = groups.where("one AND hit").select("row", "begin", "end")
    cores = groups.groupBy("core").agg(F.count("*").alias("m"), F.max(F.col("one") & ~F.col("hit")).alias("open")).where("m > 1 AND open").select("core")
    todo = groups.join(cores, "core").groupBy("id").agg(F.collect_list(F.struct("j", (F.col("one") & ~F.col("hit")).alias("open"))).alias("todo"))
    windows = s.store(context.join(todo, "id").select("a", "row", "lo", "span", "left", "bytes", "todo").mapInArrow(_windows, "key long, row long, begin long, open boolean"), "windows")
    twice = windows.groupBy("key").agg(F.count("*").alias("m"), F.max("open").alias("open")).where("m > 1 AND open").select("key")
    single = windows.where("open").join(twice, "key").select("row", "begin", (F.col("begin") + LENGTH).alias("end"))
    return settled.union(whole).union(single)


def passage_spans(packed: DataFrame, s: Scratch, words: int) -> DataFrame:
    """(row, begin, end): byte spans of ``packed`` (_row, _z) whose every window of ``words`` words stands in another row as well; they overlap."""
    if words < 1:
        raise ValueError("a passage has one word at least")
    found = s.store(packed.select("_row", "_z").mapInArrow(_find_word_runs(words), "a long, r long, row long, begin long, end long"), "word runs")
    apart = (F.min("row") < F.max("row")).alias("many")
    classes = s.store(found.groupBy("a", "r").agg(apart, F.min("row").alias("low"), F.max("row").alias("high"), F.min(F.struct("row", "begin")).alias("f")), "word classes")
    # of a run in several rows one stands for all, of others each is looked at
    several = classes.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("many").alias("many")).where("low < high AND NOT many").select("a")
    open_ = classes.join(several, "a").select("a", "r", "many", "f")
    todo = found.join(open_, ["a", "r"]).where("NOT many OR (row = f.row AND begin = f.begin)")
    by_row = todo.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("a", "many", "begin", "end")).alias("all"))
    near = packed.select("_row", "_z").join(by_row, "_row")
    windows = s.store(near.mapInArrow(_word_windows(words), "key long, row long, begin long, end long, many boolean"), "word windows")
    shared = windows.groupBy("key").agg((F.max("many") | (F.min("row") < F.max("row"))).alias("hit"), F.min("many").alias("done")).where("hit AND NOT done").select("key")
    settled = found.join(classes.where("many").select("a", "r"), ["a", "r"]).select("row", "begin", "end")
    return settled.union(windows.where("NOT many").join(shared, "key").select("row", "begin", "end"))


def dedup(docs: DataFrame, text: str = "text", with_text: bool = True, words: int | None = None) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept_sha256; with_text also replaces the text by what is kept (a code point cut in two is dropped).

    ``words`` also removes passages of so many words that another row has too.
    """
    s = Scratch(docs.sparkSession, "suffix")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in RESULTS))
    # the rows' own columns go by numbers meanwhile, so none can clash
    plain, names = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns
    own = f"c{names.index(text)}"
    rest = [c for c in plain.columns if c != own]
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema.fields if f.name != own)
    packed = s.store(plain.mapInArrow(_pack(own), f"{fields}_z binary").withColumn("_row", F.monotonically_increasing_id()), "packed")
    passages = s.store(passage_spans(packed, s, words), "passages") if words is not None else None
    s.drop("word runs", "word classes", "word windows")
    found = repeated_spans(packed, s)
    spans = s.store((found.union(passages) if passages else found).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("_spans")), "spans")
    s.drop("runs", "classes", "contexts", "groups2", "windows", "passages")
    both = packed.join(spans.withColumnRenamed("row", "_row"), "_row", "left").drop("_row")
    kinds = fields + ", ".join(f"{k} {v}" for k, v in RESULTS.items())
    out = both.mapInArrow(_cut(rest, with_text), kinds + (", _kept string" if with_text else ""))
    of = {c: F.col("_kept" if c == own else c).alias(n) for c, n in zip(plain.columns, names)}
    return out.select(*(v for c, v in of.items() if with_text or c != own), *RESULTS)
