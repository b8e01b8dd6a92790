"""All pairs of bitmaps, block by block: a task holds two blocks of rows and returns what it finds, so no pair is ever shuffled.

The work is that of every pair, a few nanoseconds for each shift; what is moved grows with the rows times the blocks of their key, and
a task's memory is that of two blocks and of ``CHUNK`` pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and pairs that are held at once.
BLOCK, CHUNK = 4096, 1 << 17


def kept(df: DataFrame) -> DataFrame:
    """The same rows however often they are read: checkpointed where a folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def blocks(t: DataFrame, keys: list[str], columns: list[str], rows: int = BLOCK) -> DataFrame:
    """(keys, block, columns as arrays): the rows of each key in the order of the first column, up to ``rows`` in a block.

    Blocks of a key are numbered in that order too, so that all of one come before all of the next.
    """
    # a partition begins a block, so there are fewer partitions than blocks
    n = max(1, min(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), t.count() // (4 * rows)))
    ordered = t.select(*keys, *columns).repartitionByRange(n, *keys, columns[0]).sortWithinPartitions(*keys, columns[0])
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def run(batches):
        place, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in columns]
            return pa.RecordBatch.from_arrays([*(b.column(k).slice(0, 1) for k in keys), pa.array([place | number]), *lists], names=[*keys, "block", *columns])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if held and any(batch.column(k)[at] != held[0].column(k)[0] for k in keys):
                    yield block()
                    number, held = number + 1, []
                end = min(batch.num_rows, at + rows - sum(b.num_rows for b in held))
                if keys:  # as far as the keys go on
                    same = np.ones(end - at, bool)
                    for k in keys:
                        v = batch.column(k).slice(at, end - at)
                        same &= np.array([x == v[0] for x in v]) if v.null_count else v.to_numpy(zero_copy_only=False) == v[0].as_py()
                    end = at + (end - at if same.all() else int(np.argmin(same)))
                held.append(batch.slice(at, end - at))
                at = end
                if sum(b.num_rows for b in held) == rows:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    return kept(ordered.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block long", *(f"`{c}` array<{kinds[c]}>" for c in columns)])))


def pairs(b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, same, columns_a, columns_b): each two blocks of a key, the earlier one first, and each with itself; dealt evenly to the tasks."""
    n = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = b.groupBy(*keys).agg(F.collect_list("block").alias("all"))
    own = b.select(*keys, "block")
    two = (own.join(F.broadcast(every), keys) if keys else own.crossJoin(F.broadcast(every))).select(*keys, F.col("block").alias("block_a"), F.explode("all").alias("block_b")).where("block_a <= block_b")
    for s in "ab":
        two = two.join(b.select(*keys, F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns)), [*keys, f"block_{s}"])
    return two.select(*keys, (F.col("block_a") == F.col("block_b")).alias("same"), *(f"{c}_{s}" for s in "ab" for c in columns)).repartition(n)


def packed(bits: np.ndarray) -> np.ndarray:
    """Boolean (n, height, width) as (n, k) words of 64 bits."""
    n = len(bits)
    flat = bits.reshape(n, -1)
    wide = -(-flat.shape[1] // 64) * 64
    if wide != flat.shape[1]:
        flat = np.concatenate([flat, np.zeros((n, wide - flat.shape[1]), bool)], axis=1)
    return np.packbits(flat, axis=1).view(np.uint64)


def shifts(reach: int) -> list[tuple[int, int]]:
    """(dy, dx) in the order in which ties are decided."""
    return sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (abs(s[0]) + abs(s[1]), *s))


def windows(a: np.ndarray, b: np.ndarray | None, size_a: tuple[int, int], size_b: tuple[int, int], reach: int) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """(place of the shift, words of a moved, words of b) in the rows that bitmaps of two sizes (height, width) share under each shift, one at least."""
    (ha, wa), (hb, wb) = size_a, size_b
    wide = max(wa, wb)
    for place, (dy, dx) in enumerate(shifts(reach)):
        low, high = max(0, dy), min(hb, ha + dy)
        if high <= low:
            continue
        x = y = None
        if a is not None:
            x = np.zeros((len(a), high - low, wide), bool)
            first, last = max(dx, 0), min(wide, wa + dx)
            if last > first:
                x[:, :, first:last] = a[:, low - dy : high - dy, first - dx : last - dx]
            x = packed(x)
        if b is not None:
            y = np.zeros((len(b), high - low, wide), bool)
            y[:, :, :wb] = b[:, low:high]
            y = packed(y)
        yield place, x, y


def least(a: np.ndarray, b: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a, best) for all pairs of a's and b's boolean bitmaps, chunk by chunk: best is err << 8 | place of the shift, (rows of a, rows of b)."""
    every = list(windows(a, b, a.shape[1:], b.shape[1:], reach))
    step = max(1, CHUNK // len(b))
    pixels = min(a.shape[1], b.shape[1]) * max(a.shape[2], b.shape[2])
    kind = np.uint16 if pixels < 1 << 8 else np.uint32 if pixels < 1 << 24 else np.uint64
    for at in range(0, len(a), step):
        best = None
        for place, x, y in every:
            err = np.bitwise_count(x[at : at + step, 0, None] ^ y[None, :, 0]).astype(kind)
            for k in range(1, x.shape[1]):
                err += np.bitwise_count(x[at : at + step, k, None] ^ y[None, :, k])
            err <<= 8
            err |= kind(place)
            best = err if best is None else np.minimum(best, err, out=best)
        yield at, best


def sized(width: np.ndarray, height: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Places of each (height, width)."""
    key = height.astype(np.int64) << 32 | width
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    return {(int(height[p[0]]), int(width[p[0]])): p for p in np.split(order, cut) if len(p)}


def runs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, arrays not yet converted."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
