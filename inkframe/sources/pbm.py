"""Binary PBM (P4) pages as a source and a sink."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Greatest width and height of a page.
MOST = 1 << 24


def parse(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, rows padded to bytes). Comments run from # to the end of a line; a file that ends early is an error."""
    at, fields = 0, []
    while len(fields) < 3:
        if at >= len(data):
            raise ValueError("the header ends early")
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            fields.append(data[at:end])
            at = end
    if fields[0] != b"P4":
        raise ValueError("not a binary PBM file")
    width, height = int(fields[1]), int(fields[2])
    if not (1 <= width <= MOST and 1 <= height <= MOST):
        raise ValueError("width and height must be within 1 and 2**24")
    stride = -(-width // 8)
    rows = data[at + 1 : at + 1 + stride * height]
    if len(rows) < stride * height:
        raise ValueError("the pixels end early")
    return width, height, rows


def render(width: int, height: int, rows: bytes) -> bytes:
    return b"P4\n%d %d\n" % (width, height) + rows


def parsed(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, width, height, rows) of files held in a column."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [parse(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)), pa.array([f[2] for f in found], pa.binary())], names=[key, "width", "height", "rows"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, width int, height int, rows binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rows) of all files of a path or pattern."""
    return parsed(spark.read.format("binaryFile").load(path))


def runs(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, y, x0, x1) of the black runs of pages."""
    import numpy as np

    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, (w, h, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in ("width", "height", "rows")))):
                bits = np.unpackbits(np.frombuffer(rows, np.uint8).reshape(h, -1), axis=1)[:, :w]
                edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                y, x0 = np.nonzero(edge == 1)
                x1 = np.nonzero(edge == -1)[1] - 1
                keys = b.column(key).take(pa.array([i] * len(y), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(y), pa.array(x0), pa.array(x1)], names=[key, "y", "x0", "x1"])

    return pages.mapInArrow(run, f"`{key}` {kind}, y long, x0 long, x1 long")
