"""Byte-level BPE encoding and decoding (operator 8) by overlapping chunk encoding.

A text longer than ``chunk`` characters is cut into chunks that overlap by ``overlap`` characters. Chunks are
pre-tokenised in parallel, each from its own start. Where the boundary lists of two neighbours first agree inside
their overlap, they agree from there on (a match depends only on what follows its start), so the text is stitched at
that place and every piece between two such places is encoded on its own. A text whose neighbours never agree (one
run of letters longer than the overlap, say) is put together again and encoded as a whole. Decoding concatenates
the raw bytes of the ids.

Inside a piece, a run of non-space characters with the space before it always starts and ends at a pre-token
boundary; the ids of such runs are remembered, so the merges are run once for each distinct run and worker.

Null and empty texts give no ids; equal rows give equal rows, also where keys are equal or null; an empty table gives no
rows; columns other than the key and the text are dropped, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K
from inkframe.llm.common import Scratch

#: Bytes that a task remembers in one generation, of which it holds two, and what an entry takes besides key and value.
MEMO_BYTES, _ENTRY = 12 << 20, 192
#: Fixed value: the pattern whose matches end wherever those of ``RUN`` do.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes these for blanks, the pre-tokeniser doesn't.
ODD = "\x1c\x1d\x1e\x1f"


def read_ranks(path: str) -> bytes:
    """The rank file as it is; a vocabulary's size doesn't depend on the data, and 64 MB is the most taken."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is larger than a vocabulary should be")
    return data


class Memo(dict):
    """What ``fill`` gives for a key, bounded: what wasn't asked for since the last time it was full is forgotten."""

    def __init__(self, fill: Callable[[str], bytes], most: int = MEMO_BYTES) -> None:
        self.fill, self.most, self.room, self.old = fill, most, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.fill(key)
        size = len(key) + len(out)
        if size < 1024:  # longer runs hardly come again
            self.room -= size + _ENTRY
            if self.room < 0:
                self.old, self.room = dict(self), self.most
                self.clear()
            self[key] = out
        return out


def _library(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), table


def encoder(ranks: bytes, pattern: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian 32-bit integers. What it remembers goes with it, at the end of a task.

    Runs are encoded on their own where the pattern is the one whose boundaries ``RUN`` shares; with another, texts are whole.
    """
    lib, _ = _library(ranks, pattern)
    whole = lambda text: array("I", lib.encode_ordinary(text)).tobytes()
    if pattern != PATTERN:
        return whole
    get, runs = Memo(whole).__getitem__, RUN.findall
    return lambda text: whole(text) if any(c in text for c in ODD) else b"".join(map(get, runs(text)))


def bytes_by_id(ranks: bytes) -> list[bytes]:
    table = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines())]
    out = [b""] * (max(i for i, _ in table) + 1)
    for i, token in table:
        out[i] = token
    return out


def _map_text(fn: Callable[[str], bytes]) -> Callable:
    """Replace the column text by fn's binary, named ids; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in K.steps(batches, "text", 4 << 20):
            at = batch.schema.get_field_index("text")
            ids = pa.array([fn(t) if t else b"" for t in batch.column(at).to_pylist()], pa.binary())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, "ids"])

    return run


def _with_ids(df: DataFrame, ranks, pattern: str) -> DataFrame:
    def run(batches):
        yield from _map_text(encoder(ranks.value, pattern))(batches)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    return df.mapInArrow(run, f"{fields}, ids binary")


def _chunks(chunk: int, overlap: int):
    """One row per chunk: the row's number, key, part and text, with the boundaries in the overlaps at both ends."""

    def run(batches):
        for batch, _, _ in K.steps(batches, "text", 1 << 20):
            out = []
            for row, key, text in zip(*(batch.column(n).to_pylist() for n in ("row", "key", "text"))):
                out += [(row, key, p, at + chunk >= len(text), text[at : at + chunk + overlap]) for p, at in enumerate(range(0, len(text), chunk))]
            for i in range(0, len(out), 64):
                r, k, p, z, t = zip(*out[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(k, batch.column("key").type), pa.array(p, pa.int64()), pa.array(z, pa.bool_()), pa.array(t, pa.string())], names=["row", "key", "part", "final", "text"])

    return run


def _edges(chunk: int, overlap: int):
    def run(batches):
        for batch, _, _ in K.steps(batches, "text", 4 << 20):
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                ends = np.zeros(0, np.int64) if any(c in text for c in ODD) else np.cumsum([len(x) for x in RUN.findall(text)], dtype=np.int64)
                ends = np.concatenate([[0], ends[:-1]])[: len(ends)]  # the last run may go on in the next chunk
                heads.append(ends[ends < overlap])
                tails.append(ends[ends >= chunk] - chunk)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("final"), pa.array(heads, kind), pa.array(tails, kind)], names=["row", "part", "final", "head", "tail"])

    return run


def _split(docs: DataFrame, shared, pattern: str, key: str, text: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the texts to be encoded as a whole, and (key, ids) of those that were cut, encoded and stitched."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False)) if pattern == PATTERN else F.lit(False)
    kind = docs.schema["key"].dataType.simpleString()
    cut = docs.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_chunks(chunk, overlap), f"row long, key {kind}, part long, final boolean, text string")
    parts = Scratch(spark, "bpe").store(cut.repartition("row", "part"), "chunks")
    edges = parts.select("row", "part", "final", "text").mapInArrow(_edges(chunk, overlap), "row long, part long, final boolean, head array<long>, tail array<long>")
    before = edges.select("row", (F.col("part") + 1).alias("part"), F.col("tail").alias("left"))
    # the chunk's own text starts where it and its left neighbour first agree
    sync = edges.join(before, ["row", "part"], "left").select("row", "part", "final", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "left"))).alias("start"))
    sync = sync.join(sync.select("row", (F.col("part") - 1).alias("part"), (F.col("start") + chunk).alias("end")), ["row", "part"], "left")
    whole = sync.groupBy("row").agg(F.max(F.col("start").isNull()).alias("torn"))
    parts = parts.join(sync.drop("final"), ["row", "part"]).join(whole, "row")
    own = F.when(F.col("torn"), F.when(F.col("final"), F.col("text")).otherwise(F.col("text").substr(F.lit(1), F.lit(chunk))))
    own = own.otherwise(F.col("text").substr(F.col("start") + 1, F.coalesce(F.col("end"), F.length("text") + F.lit(0)) - F.col("start")))
    parts = parts.select("row", "key", "part", "torn", own.alias("text"))
    torn = parts.where("torn").groupBy("row").agg(F.first("key").alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    pieces = _with_ids(parts.where("not torn").drop("torn"), shared, pattern)
    joined = pieces.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("all"))
    return docs.where(~long).unionByName(torn.select("key", "text")), joined.mapInArrow(_joined, f"key {kind}, ids binary")


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """(key, ids): the ids of every whole text as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    texts, joined = _split(docs, shared, pattern, key, text, chunk, overlap)
    return _with_ids(texts, shared, pattern).unionByName(joined).withColumnRenamed("key", key)


def _joined(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = b"".join(x["ids"] for x in row.column("all")[0].as_py())
            yield pa.RecordBatch.from_arrays([row.column("key"), pa.array([ids], pa.binary())], names=["key", "ids"])


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the concatenated bytes of the column ``ids``; other columns stay."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        get = bytes_by_id(shared.value).__getitem__
        for batch, buf, off in K.steps(batches, "ids", 4 << 20):
            all_ids = np.ascontiguousarray(buf).view("<u4")
            out = [b"".join(map(get, all_ids[a:b].tolist())) for a, b in zip(off[:-1] // 4, off[1:] // 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text: its ids, and the bytes that they are decoded to, told in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    texts, joined = _split(docs, shared, pattern, key, text, chunk, overlap)
    result = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def told(column: str):
        def run(batches):
            encode_one = encoder(shared.value, pattern) if column == "text" else lambda ids: ids
            get = bytes_by_id(shared.value).__getitem__
            for batch, _, _ in K.steps(batches, column, 1 << 20):
                ids = [encode_one(x) if x else b"" for x in batch.column(column).to_pylist()]
                decoded = (b"".join(map(get, array("I", x))) for x in ids)
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()) for each in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), *sha], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return texts.mapInArrow(told("text"), result).union(joined.mapInArrow(told("ids"), result)).withColumnRenamed("key", key)
