"""Token counts (operator 9) by a scan for separators in flat token files without an index.

A file is nothing but ids of fixed width, each text followed by an end id. It is read in blocks of fixed size, which cut
texts anywhere. Each block is searched for end ids with one vector comparison and gives its number of ids, the places
of its end ids and the last of them. A prefix scan over these summaries (not over ids) gives every block the number of
texts and ids before it and the place of the last end id, which stitches a text that spans blocks, however many.

``write_tokens`` makes such files with a byte-level vocabulary: blocks are rows of a Parquet table in the shared folder,
as only Spark's writers reach every store; ``read_flat`` takes plain files. A text's key is kept in file order beside the
blocks, without its place. Null and empty texts have no tokens; a file's ids after its last end id are an unfinished text.
Equal rows are counted each, also where keys are equal or null. An empty table gives no rows. Very long texts span blocks.
Only key and text are read, so other columns can't clash. Plain files are read whole, so they are limited to 2 GB each.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.llm import kernels as K
from inkframe.llm.bpe import bytes_by_id, encoder, read_ranks
from inkframe.llm.common import Scratch

#: Bytes of one block.
BLOCK = 1 << 20
END = 50_256


def _write(shared, pattern: str, end: int, block: int):
    def run(batches):
        from pyspark import TaskContext

        encode = encoder(shared.value, pattern)
        part, seq, keys, held = TaskContext.get().partitionId(), 0, [], bytearray()
        stop = struct.pack("<H", end)

        def row(data):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([bytes(data)], pa.binary()), pa.array([keys], pa.list_(pa.int64()))], names=["file", "block", "data", "keys"])

        for batch, _, _ in K.steps(batches, "text", 1 << 20):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held += np.frombuffer(encode(text), "<u4").astype("<u2").tobytes()
                held += stop
                keys.append(key)
                while len(held) >= block:
                    yield row(held[:block])
                    del held[:block]
                    keys, seq = [], seq + 1
        if held or keys:
            yield row(held)

    return run


def write_tokens(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", end: int = END, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(file, block, data, keys): token files of 16-bit ids, one for each partition of the texts, in their order. Nothing is shuffled."""
    spark = docs.sparkSession
    data = read_ranks(ranks)
    known = bytes_by_id(data)
    if len(known) > 1 << 16 or not 0 <= end < 1 << 16 or (end < len(known) and known[end]):
        raise ValueError(f"16-bit ids with the end id {end} can't hold a vocabulary of {len(known)}")
    shared = spark.sparkContext.broadcast(data)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return (scratch or Scratch(spark, "tokens")).store(docs.mapInArrow(_write(shared, pattern, end, block), "file long, block long, data binary, keys array<long>"), "files")


def read_flat(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of plain token files at a path or pattern; files are numbered by their path."""
    files = spark.read.format("binaryFile").load(path)
    numbers = files.select("path").withColumn("file", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for i in range(0, len(data), block):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // block], pa.int64()), pa.array([data[i : i + block]], pa.binary())], names=["path", "block", "data"])

    return files.select("path", "content").mapInArrow(cut, "path string, block long, data binary").join(numbers, "path").select("file", "block", "data")


def _scan(end: int, dtype: str):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("data")[i].as_py(), dtype)
                ends = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(i, 1), batch.column("block").slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u2", scratch: Scratch | None = None) -> DataFrame:
    """(file, ordinal, start, n_tokens, finished) of every text; start counts the ids of its file before it, n_tokens leaves out the end id."""
    s = scratch or Scratch(blocks.sparkSession, "tokens")
    found = s.store(blocks.select("file", "block", "data").mapInArrow(_scan(end, dtype), "file long, block long, n long, ends array<long>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = found.select("file", "block", "n", F.size("ends").cast("long").alias("m"), F.get("ends", F.size("ends") - 1).alias("last"))
    summary = summary.withColumn("ids", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("texts", F.coalesce(F.sum("m").over(before), F.lit(0)))
    summary = summary.withColumn("stop", F.col("ids") + F.col("last"))
    summary = summary.withColumn("prev", F.coalesce(F.max("stop").over(before), F.lit(-1))).withColumn("all_ids", F.sum("n").over(total)).withColumn("final", F.max("stop").over(total)).withColumn("all_texts", F.sum("m").over(total))
    rows = found.select("file", "block", "ends").join(summary, ["file", "block"]).select("file", "texts", "ids", "prev", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("prev")).otherwise(F.col("ids") + F.get("ends", F.col("i") - 1)) + 1
    done = rows.select("file", (F.col("texts") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("ids") + F.col("at")).alias("stop"))
    done = done.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("finished"))
    left = summary.where("block = 0").select("file", F.col("all_texts").alias("ordinal"), (F.coalesce("final", F.lit(-1)) + 1).alias("start"), "all_ids")
    left = left.where("all_ids > start").select("file", "ordinal", "start", (F.col("all_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("finished"))
    return done.union(left)


def by_key(blocks: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, file, ordinal, start, n_tokens): the counts with the keys that ``write_tokens`` kept."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.size("keys").cast("long").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    keys = blocks.select("file", "block", "keys").join(base, ["file", "block"]).select("file", "base", F.posexplode("keys").alias("i", key)).select("file", (F.col("base") + F.col("i")).alias("ordinal"), key)
    return keys.join(counts, ["file", "ordinal"]).select(key, "file", "ordinal", "start", "n_tokens")
