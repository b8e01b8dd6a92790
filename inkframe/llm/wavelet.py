"""Token files as wavelet matrices (operator 2).

Texts are dealt out by ranges of their key, so that file after file holds them in ascending order. Each task encodes
its texts and writes shards: one compressed file each, holding the ids of its texts as a wavelet matrix. Bit plane
``l`` holds bit ``levels - 1 - l`` of every id, each plane stably sorted by the bits before it (zeros first). Planes are
compressed in blocks of ``BLOCK`` bits, and the ones before each block are stored beside them. Rank and select over the
planes give the id at a place, the number of times an id occurs before a place, and the place of its k-th occurrence,
each from one or two inflated blocks of every plane.

A shard is one row of a Parquet table in the shared folder, since only Spark's writers reach every kind of store;
``WaveletShard.to_bytes`` gives the same bytes for a plain file. A text is never split between shards.

Null and empty texts hold the end id alone. Equal keys stay neighbours, ordered by text. Null keys come first. An empty
table gives no shards and no rows. Only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.llm import kernels as K
from inkframe.llm.bpe import Memo, read_ranks
from inkframe.llm.common import Scratch

MAGIC = b"WVMX"
#: Tokens after which a shard is closed.
SHARD = 1 << 19
#: Bits of a plane that are compressed together, with a stored count of the ones before them.
BLOCK = 1 << 16
#: Bytes of pieces that a task remembers in one generation.
MEMO_BYTES = 32 << 20
#: Bytes of text whose distinct pieces are looked up together.
STEP = 4 << 20
#: Blocks that a shard keeps inflated.
_KEPT = 64


class WaveletShard:
    """Ids of consecutive texts. ``blocks[l][b]`` is a compressed block of plane l, ``ones[l][b]`` the ones before it, ``zeros[l]`` the plane's zeros.

    Lookups inflate the blocks that they touch, one or two of each plane.
    """

    def __init__(self, blocks: list[list[bytes]], ones: np.ndarray, zeros: list[int], n: int, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.blocks, self.ones, self.zeros, self.n, self.keys, self.sizes = blocks, ones, zeros, n, keys, sizes
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, keys: np.ndarray, sizes: np.ndarray, levels: int) -> WaveletShard:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        blocks, zeros, n = [], [], len(ids)
        count = max(1, -(-n // BLOCK))
        ones = np.zeros((levels, count + 1), np.int64)
        for plane, level in enumerate(range(levels - 1, -1, -1)):
            bits = (ids & ids.dtype.type(1 << level)).astype(bool)
            packed = np.zeros(count * BLOCK // 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
            low = np.compress(~bits, ids)
            ids = np.concatenate([low, np.compress(bits, ids)])
            each = packed.reshape(count, -1)
            ones[plane, 1:] = np.cumsum(np.bitwise_count(each).sum(1, dtype=np.int64))
            blocks.append([z.compress(x) for x in each])
            zeros.append(len(low))
        return cls(blocks, ones, zeros, n, keys, sizes)

    def to_bytes(self) -> bytes:
        """Magic, version, number of ids, texts and planes; keys, sizes, zeros by plane, ones before and bytes of each block; the blocks."""
        levels = len(self.blocks)
        lengths = np.array([[len(b) for b in plane] for plane in self.blocks], "<i8")
        numbers = [self.keys, self.sizes, np.array(self.zeros), self.ones.ravel(), lengths.ravel()]
        head = struct.pack("<IQQQQ", 2, self.n, len(self.keys), levels, self.ones.shape[1] - 1)
        return MAGIC + head + b"".join(x.astype("<i8").tobytes() for x in numbers) + b"".join(b for plane in self.blocks for b in plane)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:4] != MAGIC or struct.unpack_from("<I", data, 4)[0] != 2:
            raise ValueError("not a wavelet shard")
        n, docs, levels, count = struct.unpack_from("<QQQQ", data, 8)
        parts = np.cumsum([0, docs, docs, levels, levels * (count + 1), levels * count])
        numbers = np.frombuffer(data, "<i8", int(parts[-1]), 40)
        keys, sizes, zeros, ones, lengths = (numbers[a:b] for a, b in zip(parts, parts[1:]))
        ends = 40 + 8 * len(numbers) + np.cumsum(lengths)
        every = [data[e - size : e] for e, size in zip(ends.tolist(), lengths.tolist())]
        return cls([every[i * count : (i + 1) * count] for i in range(levels)], ones.reshape(levels, count + 1), zeros.tolist(), n, keys, sizes)

    def _block(self, level: int, b: int) -> np.ndarray:
        """A block as 64-bit words."""
        have = self._open.get((level, b))
        if have is None:
            import zstandard

            if len(self._open) >= _KEPT:
                self._open.clear()
            have = self._open[level, b] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[level][b]), "<u8")
        return have

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b, rest = divmod(i, BLOCK)
        n = int(self.ones[level, b])
        if rest:
            words = self._block(level, b)
            n += int(np.bitwise_count(words[: rest // 64]).sum())
            if rest % 64:
                n += (int(words[rest // 64]) & ((1 << rest % 64) - 1)).bit_count()
        return n

    def _bit(self, level: int, i: int) -> int:
        b, rest = divmod(i, BLOCK)
        return int(self._block(level, b)[rest // 64]) >> rest % 64 & 1

    def _select(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        counts = self.ones[level] if bit else np.arange(self.ones.shape[1]) * BLOCK - self.ones[level]
        b = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, b).view(np.uint8), bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, zeros in enumerate(self.zeros):
            ones, bit = self._rank(level, i), self._bit(level, i)
            out, i = out << 1 | bit, zeros + ones if bit else i - ones
        return out

    def _span(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level, zeros in enumerate(self.zeros):
            ra, rb = self._rank(level, a), self._rank(level, b)
            a, b = (zeros + ra, zeros + rb) if token >> (len(self.zeros) - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of an id among the first i."""
        a, b = self._span(token, self.n if i is None else i)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        a, b = self._span(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane to the first."""
        import zstandard

        inflate = zstandard.ZstdDecompressor().decompress
        out = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for shift, (plane, zeros) in enumerate(zip(self.blocks[::-1], self.zeros[::-1])):
            packed = np.frombuffer(b"".join(map(inflate, plane)), np.uint8)
            bits = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~bits)] = out[:zeros]
            back[np.flatnonzero(bits)] = out[zeros:] | (1 << shift)
            out = back
        return out


#: Fixed value: the split of the vocabulary whose pieces :func:`pieces_of` finds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _NUMBER, _REST = range(4)


def _classes() -> np.ndarray:
    """Class of each lower-cased code point below U+0180, by lead byte and next byte (for ASCII, any)."""
    import unicodedata

    out = np.full((256, 256), _REST, np.uint8)
    for c in range(0x180):
        kind = unicodedata.category(chr(c))[0]
        lead, *more = chr(c).encode()
        out[lead, more or slice(None)] = _BLANK if chr(c).isspace() else {"L": _LETTER, "N": _NUMBER}.get(kind, _REST)
    return out


def pieces_of(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, pieces by text) of lower-cased texts with code points below U+0180 only: the matches of ``PATTERN``."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    after = np.append(buf[1:], np.uint8(0))
    kind = classes[buf, after]
    lead = buf & 0xC0 != 0x80
    kind = np.where(lead, kind, np.append(np.uint8(0), kind[:-1]))
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    first = edge[:-1].copy()
    first[0] = True
    first[1:] |= (kind[1:] != kind[:-1]) | (lead & (kind == _NUMBER))[1:]
    # an apostrophe that begins a match takes the letters of a contraction with it
    for at in np.flatnonzero(first & (buf == 39)).tolist():
        word = bytes(buf[at + 1 : at + 3])
        size = 2 if word[:1] in (b"s", b"t", b"m", b"d") else 3 if word in (b"re", b"ve", b"ll") else 0
        if size and not edge[at + 1 : at + size].any():
            first[at + 1 : at + size] = False
            if at + size < len(buf) and kind[at + size] == _LETTER:
                first[at + size] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(buf))
    real = kind[starts] != _BLANK
    starts, ends = starts[real], ends[real]
    return starts, ends, np.diff(np.searchsorted(starts, off))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A tokenizer that lower-cases and splits by ``PATTERN`` encodes each piece on its own; of texts of code points below U+0180
    every distinct piece of a step is encoded once and remembered within the bound of ``Memo``, and ids are gathered by index.
    Other texts, and all of them with any other tokenizer, are encoded whole.
    """

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(vocabulary.decode())
        self.lib.encode_special_tokens = True
        self.levels = max(1, (self.lib.get_vocab_size() - 1).bit_length())
        self.kind = np.uint16 if self.levels <= 16 else np.uint32
        about = json.loads(vocabulary)
        self.split = "Lowercase" in json.dumps(about.get("normalizer")) and json.dumps(PATTERN)[1:-1] in json.dumps(about.get("pre_tokenizer"))
        self.classes, letters, tokenize = _classes(), _byte_letters(), self.lib.model.tokenize

        def piece(p: bytes) -> bytes:
            # printable ASCII stands for itself
            t = p.decode() if p.isalpha() else "".join(map(letters.__getitem__, p))
            return array("I", [x.id for x in tokenize(t)]).tobytes()

        self.memo = Memo(piece, MEMO_BYTES)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        buf, off = K.flat(column)
        # lower-casing stays below U+0180 but for the dotted capital I; some controls are blanks to Python alone
        odd = (buf >= 0xC6) | ((buf >= 0x1C) & (buf <= 0x1F))
        odd[:-1] |= (buf[:-1] == 0xC4) & (buf[1:] == 0xB0)
        odd = (np.diff(np.searchsorted(np.flatnonzero(odd), off)) > 0) if self.split else np.ones(len(column), bool)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", column.fill_null("").cast(pa.large_string())))
        low, cut = K.flat(plain)
        starts, ends, counts = pieces_of(low, cut, self.classes)
        one, same = K.distinct(K.span_hash(low, starts, ends))
        data, get = low.tobytes(), self.memo.__getitem__
        each = [get(data[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        ids = np.frombuffer(b"".join(each), "<u4").astype(self.kind)
        ids = ids[K.ragged((np.cumsum(sizes) - sizes)[same], sizes[same])]
        bounds = np.concatenate([[0], np.cumsum(sizes[same])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [self.whole(column[i].as_py()) if o and column[i].is_valid else ids[a:b] for i, (o, a, b) in enumerate(zip(odd.tolist(), bounds, bounds[1:]))]


def _build(shared, end: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(shared.value)
        part, seq, stop = TaskContext.get().partitionId(), 0, np.array([end], encode.kind)
        keys, ids, total = [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            all_ids = np.concatenate([x for one in ids for x in (one, stop)])
            data = WaveletShard.build(all_ids, np.array(keys, np.int64), sizes, encode.levels).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_tokens", "file"])

        for batch, _, _ in K.steps(batches, "text", STEP):
            for key, one in zip(batch.column("key").to_pylist(), encode(batch.column("text"))):
                keys.append(-(1 << 63) if key is None else key)
                ids.append(one)
                total += len(one) + 1
                if total >= shard:
                    yield closed()
                    keys, ids, total, seq = [], [], 0, seq + 1
        if keys:
            yield closed()

    return run


def write_shards(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 2, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """(part, seq, n_tokens, file): the written shards; (part, seq) ascends with the key."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    return (scratch or Scratch(spark, "wavelet")).store(dealt.mapInArrow(_build(shared, end, shard), "part long, seq long, n_tokens long, file binary"), "shards")


def _read(batches, end: int):
    for batch in batches:
        for part, seq, data in zip(*(batch.column(n).to_pylist() for n in ("part", "seq", "file"))):
            shard = WaveletShard.from_bytes(data)
            ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.sizes)
            if shard.count(end) < len(ends) or len(ends) and shard.access(shard.n - 1) != end:
                raise ValueError(f"shard {part}, {seq}: texts don't end with {end}")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - shard.sizes).tolist(), ends.tolist())]
            n = len(crc)
            keys = pa.array(shard.keys, mask=shard.keys == -(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), keys, pa.array(ends - shard.sizes), pa.array(shard.sizes), pa.array(crc, pa.int64())], names=["part", "seq", "key", "at", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame, key: str = "doc_id", end: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every text, from the files; end ids are counted in the bit planes."""
    # one number per shard; totals run within a part, and then over the parts
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "seq", "n_tokens")
    within = sizes.withColumn("base", before(Window.partitionBy("part").orderBy("seq"))).drop("n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("first", before(Window.orderBy("part"))).drop("n_tokens")
    base = within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("first")).alias("base"))
    rows = shards.mapInArrow(partial(_read, end=end), "part long, seq long, key long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
