"""Benchmark decontamination (operator 4) over a distributed positional inverted index.

The index is dealt by documents: a segment holds some megabytes of text as sorted term hashes, each with its
ascending word positions. Texts of a segment are numbered on with gaps between them, so no phrase crosses two.
A phrase is looked up from its rarest term in the segment: that term's positions, less its offset in the phrase, are
intersected with the lists of the other terms, rarest first, each less its own offset. :func:`near` finds places where
terms stand within some distance instead.

Every term of every text is stored, whatever the items are, so one index serves any of them. Items are looked up in
blocks of ``BLOCK_ITEMS``, a proven bound of what is sent to the executors at once.

Null and empty texts have no words and are never contaminated; items without words have no window. Equal rows are
judged each for itself, also where keys are equal or null. An item id that is null counts as the empty string; several
items may share a window, and each is found. A very long text is a segment of its own. An empty table of texts gives no
rows, an empty table of items no hits. Only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K
from inkframe.llm.common import Scratch

WINDOW = 8
#: Word positions left free between two texts of a segment.
GAP = 64
SEGMENT_BYTES = 1 << 20
#: Items and bytes of their texts that are looked up together.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


class Segment:
    """Inverted index of some texts: ``terms`` ascending, ``first[i]:first[i + 1]`` the places of term i in ``places``."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, places: np.ndarray) -> None:
        self.terms, self.first, self.places = terms, first, places
        # (number of the term, place) as one ascending list
        self.pairs = np.repeat(np.arange(len(terms), dtype=np.int64) << 40, np.diff(first)) | places

    @classmethod
    def build(cls, hashes: np.ndarray, places: np.ndarray) -> Segment:
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        return cls(hashes[start], np.append(start, len(hashes)), places)

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms in this segment, -1 where it lacks them."""
        if not len(self.terms):
            return np.full(np.shape(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def phrases(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every exact occurrence; row i of ``terms`` is a phrase of sizes[i] words."""
        there = np.arange(terms.shape[1]) < sizes[:, None]
        number = np.where(there, self.number(terms), -2)
        alive = np.flatnonzero((number != -1).all(1) & (sizes > 0))
        number, there = number[alive], there[alive]
        counts = np.where(there, np.diff(self.first)[np.maximum(number, 0)] if len(self.terms) else 0, np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = order[:, 0] if len(order) else np.zeros(0, np.int64)
        own = number[np.arange(len(alive)), rarest]
        found = self.first[own + 1] - self.first[own]
        row = np.repeat(np.arange(len(alive)), found)
        place = self.places[K.ragged(self.first[own], found)] - rarest[row]
        for k in range(1, terms.shape[1]):
            offset = order[row, k]
            want = number[row, offset] << 40 | np.maximum(place + offset, 0)
            at = np.minimum(np.searchsorted(self.pairs, want), max(len(self.pairs) - 1, 0))
            keep = (number[row, offset] < 0) | (self.pairs[at] == want) if len(row) else np.zeros(0, bool)
            row, place = row[keep], place[keep]
        keep = place >= 0
        return alive[row[keep]], place[keep]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest term with every other term at most ``slop`` words away (slop < GAP)."""
        number = self.number(terms)
        if not len(terms) or (number < 0).any():
            return np.zeros(0, np.int64)
        order = np.argsort(np.diff(self.first)[number], kind="stable")
        place = self.places[self.first[number[order[0]]] : self.first[number[order[0]] + 1]]
        for i in order[1:]:
            low = np.searchsorted(self.pairs, number[i] << 40 | np.maximum(place - slop, 0))
            high = np.searchsorted(self.pairs, number[i] << 40 | place + slop, side="right")
            place = place[high > low]
        return place


def _bases(counts: np.ndarray) -> np.ndarray:
    """Place of each text's first word in its segment."""
    return np.cumsum(counts) - counts + np.arange(len(counts)) * GAP


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and their number by text."""
    low = K.LOWER[buf]
    starts, ends, counts = K.word_spans(low, off, K.ALNUM)
    return K.span_hash(low, starts, ends), counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, sizes, text) of all windows of ``size`` consecutive words; a shorter text, but not an empty one, is one window."""
    at, total = K.within(counts), np.repeat(counts, counts)
    first = np.flatnonzero((at + size <= total) | ((at == 0) & (total < size)))
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    return padded[first[:, None] + np.arange(size)], np.minimum(total[first], size), np.repeat(np.arange(len(counts)), counts)[first]


def build_index(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(segment, terms, first, places, keys, counts): one stored row per segment, with a number of its own; counts are the texts' words."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch, buf, off in K.steps(batches, "text", SEGMENT_BYTES):
            hashes, counts = words(buf, off)
            places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * GAP, counts)
            s = Segment.build(hashes, places)
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (s.terms, s.first.astype("<u4"), s.places.astype("<u4"))]
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
            yield pa.RecordBatch.from_arrays([*binary, keys, pa.array([counts], pa.list_(pa.int64()))], names=["terms", "first", "places", "keys", "counts"])

    segments = docs.mapInArrow(run, f"terms binary, first binary, places binary, keys array<{docs.schema['key'].dataType.simpleString()}>, counts array<long>")
    return scratch.store(segments.withColumn("segment", F.monotonically_increasing_id()), "index")


def _read(row) -> Segment:
    first = np.frombuffer(row["first"], "<u4").astype(np.int64)
    return Segment(np.frombuffer(row["terms"], "<u8"), first, np.frombuffer(row["places"], "<u4").astype(np.int64))


def _lookup(shared, kind, several: bool):
    """Rows (segment, at, key, n_words, begins, ends, items) by text."""

    def run(batches):
        terms, sizes, item, names = shared.value
        # windows of equal words are looked up once
        padded = K.mix((terms * np.arange(3, 2 * terms.shape[1] + 3, 2, dtype=np.uint64)).sum(1, dtype=np.uint64) + sizes.astype(np.uint64)) if len(terms) else np.zeros(0, np.uint64)
        _, one, same = np.unique(padded, return_index=True, return_inverse=True)
        order = np.argsort(same, kind="stable")
        start = np.searchsorted(same[order], np.arange(len(one) + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("terms", "first", "places", "counts")}
                keys = batch.column("keys").slice(i, 1).flatten()
                counts = np.array(row["counts"], np.int64)
                base = _bases(counts)
                phrase, place = _read(row).phrases(terms[one], sizes[one])
                doc = np.searchsorted(base, place, side="right") - 1
                begins, ends, items = ([[] for _ in counts] for _ in range(3))
                for p, d, a in zip(phrase.tolist(), doc.tolist(), (place - base[doc]).tolist()):
                    begins[d].append(a)
                    ends[d].append(a + int(sizes[one[p]]))
                    items[d] += [names[item[w]] for w in order[start[p] : start[p + 1]]]
                n_hit = []
                for d, (b, e) in enumerate(zip(begins, ends)):
                    hit = np.zeros(counts[d] + 1 if b else 1, np.int64)
                    np.add.at(hit, b, 1)
                    np.add.at(hit, e, -1)
                    n_hit.append(int((np.cumsum(hit) > 0).sum()))
                items = [sorted(set(x)) for x in items]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                out = [keys, pa.array(counts), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(items, pa.list_(pa.string()))]
                out += [pa.array(x, pa.list_(pa.int64())) for x in (begins, ends)]
                if several:
                    out = [pa.array([batch.column("segment")[i].as_py()] * len(keys), pa.int64()), pa.array(np.arange(len(keys))), *out]
                yield pa.RecordBatch.from_arrays(out, names=["segment", "at"] * several + ["key", "n_words", "n_hit", "n_items", "items_sha256", "items", "begins", "ends"])

    return run


def near(index: DataFrame, text: str, slop: int, key: str = "doc_id") -> DataFrame:
    """(key, n_near, at) of every text of a stored index: the word positions of the text's rarest term in the segment that have all other words of ``text`` at most ``slop`` words away."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop {slop}; texts stand {GAP} places apart")
    terms = np.unique(words(*K.flat(pa.array([text], pa.string())))[0])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("terms", "first", "places", "counts")}
                counts = np.array(row["counts"], np.int64)
                base = _bases(counts)
                place = _read(row).near(terms, slop)
                doc = np.searchsorted(base, place, side="right") - 1
                at = [[] for _ in counts]
                for d, p in zip(doc.tolist(), (place - base[doc]).tolist()):
                    at[d].append(p)
                yield pa.RecordBatch.from_arrays([batch.column("keys").slice(i, 1).flatten(), pa.array(list(map(len, at)), pa.int64()), pa.array(at, pa.list_(pa.int64()))], names=["key", "n_near", "at"])

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"key {kind}, n_near long, at array<long>").withColumnRenamed("key", key)


def _merged(batches):
    """Texts looked up in several blocks of items: hit words and items united."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            hit = {w for b, e in zip(r["begins"], r["ends"]) for w in range(b, e)}
            items = sorted(set(r["items"]))
            out.append((r["n_words"], len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), items, r["begins"], r["ends"]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_words", "n_hit", "n_items", "items_sha256", "items", "begins", "ends"])


def _blocks(items: DataFrame, key: str, text: str, most: int):
    """The items, some at a time: (terms, sizes, item of each window, ids)."""
    held, size = [], 0
    for r in items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t")).toLocalIterator():
        held.append((r.k, r.t))
        size += len(r.t or "")
        if len(held) >= most or size >= BLOCK_BYTES:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list):
    terms, sizes, item = windows(*words(*K.flat(pa.array([t for _, t in held], pa.string()))))
    return terms, sizes, item, [k for k, _ in held]


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = 2, block_items: int = BLOCK_ITEMS, scratch: Scratch | None = None) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, items, begins, ends) of every text; begins and ends are the hit windows' word spans."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(items, item_key, text, block_items)]
    index = build_index(docs, scratch or Scratch(spark, "index"), key, text)
    kind = docs.schema[key].dataType.simpleString()
    several = len(blocks) > 1
    fields = f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, begins array<long>, ends array<long>"
    none = (np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    parts = [index.mapInArrow(_lookup(b, kind, several), ("segment long, at long, " if several else "") + fields) for b in blocks or [spark.sparkContext.broadcast(none)]]
    out = parts[0]
    if several:
        for p in parts[1:]:
            out = out.union(p)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "begins", "ends")]
        out = out.groupBy("segment", "at").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), *lists).mapInArrow(_merged, fields)
    return out.withColumn("contaminated", F.col("n_items") >= least).withColumnRenamed("key", key)
