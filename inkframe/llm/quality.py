"""Quality rules (operator 3): rule statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over hash buckets of token unigrams and bigrams are counted: one over every text (the raw corpus), one
over the texts whose key is labelled good (the trusted target). The number of buckets grows with the bytes of text, from
2**``LEAST_BITS`` to 2**``MOST_BITS``. A text's score is the mean over its n-grams of log p_target - log p_raw; it is kept
when that is at least ``THRESHOLD``. Ratios are held as integers, so that a score doesn't depend on the order of additions.

A bucket's ratio is backed off by its evidence to that of the bucket twice as wide, and so on up to 2**``TOP_BITS``
buckets and then to 0: with much evidence it is its own, with little its neighbourhood's. The rule is the same at every size.

Tokens are maximal runs of word bytes or of other non-space
bytes.

Null texts have no words and fail the base rule, as empty ones do. Without a single trusted text every ratio is 0.
Equal rows are judged alike; a null key is never trusted, and a key that repeats is trusted in each of its rows. Very long
texts are a step of their own, an empty table gives no rows, and a score equal to the threshold is kept. The rows' own
columns stay unless a result has their name, which then wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K

#: Bits of the widest buckets, and of the narrowest in small and in large corpora.
TOP_BITS, LEAST_BITS, MOST_BITS = 6, 16, 22
#: Bytes of text for each bucket.
BUCKET_BYTES = 1024
#: Buckets whose counts are sent together.
_TOGETHER = 1 << 12
#: Target n-grams expected in a bucket at which its own ratio weighs as much as the wider bucket's.
EVIDENCE = 100
#: Nats per n-gram below which a text is rejected.
THRESHOLD = -0.15
#: Integer units of one nat.
UNIT = 1 << 20
#: Labelled keys up to which the label table is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 2_000_000

#: Characters counted as symbols.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: 0: blank, 1: letter, digit or part of a longer code point, 2: the rest.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[K.ALNUM] = 1
_CLASS[65:91] = 1
_CLASS[~K.SPACED] = 0


def bits_of(n_bytes: int) -> int:
    """Bits of the narrowest buckets for a corpus of so many bytes."""
    return min(max(LEAST_BITS, (n_bytes // BUCKET_BYTES).bit_length()), MOST_BITS)


def grams(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, 2**bits in all, of all unigrams and bigrams, and the number of the text that each stands in."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    change = np.ones(len(buf), dtype=bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(buf))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    one = K.span_hash(buf, starts, ends)
    doc = np.searchsorted(off, starts, side="right") - 1
    pair = doc[1:] == doc[:-1]
    two = K.mix(one[:-1] * np.uint64(3) + one[1:])[pair]
    return (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([doc, doc[1:][pair]])


def _pack(counts: np.ndarray) -> bytes:
    """Counts by the planes of their bytes, most of which are 0, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


_PACKED = "block int, raw binary, target binary"


def _packed(blocks: list[int], *counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(pa.array(map(_pack, c), pa.binary()) for c in counts)], names=["block", "raw", "target"])


def _count(bits: int):
    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch, buf, off in K.steps(batches):
            bucket, doc = grams(buf, off, bits)
            good = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            # adding bucket by bucket: a step has far fewer n-grams than there may be buckets
            for counts, b in ((raw, bucket), (target, bucket[good[doc]])):
                some, n = np.unique(b, return_counts=True)
                counts[some] += n
        raw, target = raw.reshape(-1, _TOGETHER), target.reshape(-1, _TOGETHER)
        some = np.flatnonzero(raw.any(1))
        yield _packed(some.tolist(), list(raw[some]), list(target[some]))

    return run


def _added(batches):
    """Sums by block of rows that are sorted by it."""
    last, raw, target = None, 0, 0
    for batch in batches:
        for block, r, t in zip(*(c.to_pylist() for c in batch.columns)):
            if block != last:
                if last is not None:
                    yield _packed([last], [raw], [target])
                last, raw, target = block, 0, 0
            raw, target = raw + _unpack(r), target + _unpack(t)
    if last is not None:
        yield _packed([last], [raw], [target])


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Ratio by bucket in units of 1 / UNIT nats. ``trusted`` holds the keys of good texts."""
    keys = trusted.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(keys, "key", "left").select("text", F.coalesce("hit", F.lit(False)).alias("trusted"))
    bits = bits_of(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
    rows = marked.mapInArrow(_count(bits), _PACKED).repartition("block").sortWithinPartitions("block").mapInArrow(_added, _PACKED)
    # at most 2**bits counts come back
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in rows.collect():
        at = slice(r.block * _TOGETHER, (r.block + 1) * _TOGETHER)
        raw[at], target[at] = _unpack(r.raw), _unpack(r.target)
    return ratios(raw, target)


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Ratio by bucket, backed off from the widest buckets to the narrowest; 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw), np.int32)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.ones(1)
    for bits in range(TOP_BITS, len(raw).bit_length()):
        t, e = (x.reshape(1 << bits, -1).sum(1) for x in (target, expected))
        ratio = np.repeat(ratio, len(t) // len(ratio))
        ratio = (t + EVIDENCE * ratio) / (e + EVIDENCE)
    return np.rint(np.log(ratio) * UNIT).astype(np.int32)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, words = K.word_spans(buf, off, K.SPACED)
    own = np.repeat(np.arange(n), words)
    # words in windows of three that occur twice or more
    repeated = np.zeros(len(starts) + 1, np.int64)
    at, size = K.within(words), np.repeat(words, words)
    first = np.flatnonzero(at + 3 <= size)
    if len(first):
        h = K.span_hash(buf, starts, ends)
        window = K.mix(h[first] + h[first + 1] * np.uint64(0x9E3779B97F4A7C15) + h[first + 2] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ K.mix(own[first].astype(np.uint64) + np.uint64(1))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(first), dtype=bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        np.add.at(repeated, first[twice], 1)
        np.add.at(repeated, first[twice] + 3, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    # lines with a word, equal to an earlier one of the text
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate([off[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(off, breaks, side="right") - 1])
    # a break that ends its text begins an empty line at the next text's start: it stays with its own text
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    stop = np.where(last, off[doc + 1], np.append(begin[1:], 0) - 1)
    stop = np.maximum(stop, begin)
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[full], stop[full], doc[full]
    line = K.span_hash(buf, begin, stop) ^ K.mix(doc.astype(np.uint64) + np.uint64(7))
    distinct = np.unique(line, return_index=True)[1]
    bounds = np.searchsorted(starts, off)
    return {
        "n_words": words.astype(np.int64),
        "word_chars": _sums(K.SPACED[buf] & (buf & 0xC0 != 0x80), off),
        "n_symbols": _sums(SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(doc, minlength=n) - np.bincount(doc[distinct], minlength=n),
        "n_repeat_words": _sums(covered, bounds),
    }


def score(docs: DataFrame, ratio: np.ndarray, text: str = "text", threshold: float = THRESHOLD, min_words: int = 50, repeat_percent: int = 50, with_text: bool = True) -> DataFrame:
    """The rows, without the text if so asked, with their statistics, ``llr`` (nats per n-gram), ``base_failed`` and ``kept``."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio).bit_length() - 1
    new = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "llr": "double", "base_failed": "boolean", "kept": "boolean"}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    own = [c for c in docs.columns if with_text or c != text]

    def run(batches):
        for batch, buf, off in K.steps(batches, text):
            n = batch.num_rows
            out = base_counts(buf, off)
            bucket, doc = grams(buf, off, bits)
            order = np.argsort(doc, kind="stable")
            total = _sums(shared.value[bucket[order]], np.searchsorted(doc[order], np.arange(n + 1)))
            llr = total / np.maximum(np.bincount(doc, minlength=n), 1) / UNIT
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
            columns = [*out.values(), llr, failed, ~failed & (llr >= threshold)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *map(pa.array, columns)], names=[*own, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    return docs.mapInArrow(run, ", ".join([fields, *(f"{k} {v}" for k, v in new.items())]))
