"""The adaptive arithmetic coder over pages, which is sequential by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkframe.operators import coding, lockstep, pages
from inkframe.session import spread


def mq_encode(decisions: Iterable[tuple[int, int]], marker: bool = True) -> bytes:
    """Bytes of (context, bit) decisions by the MQ coder of annex E, with the closing marker if asked for."""
    e = coding.Encoder()
    for context, bit in decisions:
        e.bit(context, bit)
    return e.finish() if marker else e.finish()[:-2]


def encode_glyphs(with_bits: DataFrame, side: int = 8) -> DataFrame:
    """(vec_id, payload): a generic region for each square glyph, given as (vec_id, bits array) in row order."""

    def run(batches):
        for b in batches:
            data = [coding.encode_bitmap(np.array(v, bool).reshape(side, side)) for v in b.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(data, pa.binary())], names=["vec_id", "payload"])

    return spread(with_bits.select("vec_id", "bits")).mapInArrow(run, "vec_id long, payload binary")


#: Pixels, and pages, that a task codes together.
TOGETHER, PAGES = 24 << 20, 8192
#: Rows of an Arrow batch of runs.
ROWS = 1 << 16


def _together(items: Iterable[tuple], pixels: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """The items in lists that have about ``TOGETHER`` pixels or ``PAGES`` items."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += pixels(item)
        if n >= TOGETHER or len(held) >= PAGES:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_pages(docs: DataFrame, ink: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, width, height, payload): a generic region for each text as a page; a page without a pixel column has none."""
    kind, black = docs.schema[key].dataType.simpleString(), pages._ink(ink)

    def drawn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lines = (batch.column(1)[i].as_py() or "").split("\n")
                rows = np.zeros((len(lines), max(map(len, lines))), bool)
                for y, line in enumerate(lines):
                    rows[y, : len(line)] = black(np.frombuffer(line.encode("utf-32-le", "replace"), "<u4"))
                yield batch.column(0).slice(i, 1), rows.shape, lockstep.bitmap_decisions(rows) if rows.size else None

    def run(batches):
        for held in _together(drawn(batches), lambda page: page[1][0] * page[1][1]):
            coded = iter(lockstep.encode([d for _, _, d in held if d is not None], 1 << 16))
            data = [None if d is None else next(coded) for _, _, d in held]
            height, width = np.array([s for _, s, _ in held], np.int64).T
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([k for k, _, _ in held]), pa.array(width), pa.array(height), pa.array(data, pa.binary())], names=[key, "width", "height", "payload"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, width long, height long, payload binary")


def row_runs(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, x0, x1) of the black runs of a bitmap."""
    edge = np.diff(np.pad(rows.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


def run_batches(keys: pa.Array, found: list[tuple[np.ndarray, ...]], key: str) -> Iterator[pa.RecordBatch]:
    """(key, y, x0, x1) of the runs found for each key, in batches of up to ``ROWS`` rows."""
    owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    y, x0, x1 = (np.concatenate([f[i] for f in found]) for i in range(3))
    for at in range(0, len(owner), ROWS):
        s = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[s])), *(pa.array(v[s].astype(np.int64)) for v in (y, x0, x1))], names=[key, "y", "x0", "x1"])


def decode_pages(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, y, x0, x1): the black runs of coded generic regions."""
    kind = coded.schema[key].dataType.simpleString()

    def coded_pages(batches):
        for batch in batches:
            for i, (w, h, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "payload")))):
                if data is not None:
                    yield batch.column(0).slice(i, 1), w, h, data

    def run(batches):
        for held in _together(coded_pages(batches), lambda page: page[1] * page[2]):
            found: list = [None] * len(held)

            def keep(i: int, rows: np.ndarray, found: list = found) -> None:
                found[i] = row_runs(rows)

            lockstep.decode_bitmaps([p[1:] for p in held], keep)
            yield from run_batches(pa.concat_arrays([p[0] for p in held]), found, key)

    return coded.select(key, "width", "height", "payload").mapInArrow(run, f"`{key}` {kind}, y long, x0 long, x1 long")
