"""Segments of a coded document, and the bytes of a whole file (ITU-T T.88, sequential organisation)."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators import coding, kernels, lockstep, matching
from inkframe.session import spread

MAGIC = bytes([0x97, 0x4A, 0x42, 0x32, 0x0D, 0x0A, 0x1A, 0x0A])
#: Numbers of the segment types.
TYPES = {0: "symbol dictionary", 4: "intermediate text region", 6: "immediate text region", 7: "immediate lossless text region", 16: "pattern dictionary", 20: "intermediate halftone region", 22: "immediate halftone region", 23: "immediate lossless halftone region", 36: "intermediate generic region", 38: "immediate generic region", 39: "immediate lossless generic region", 40: "intermediate generic refinement region", 42: "immediate generic refinement region", 43: "immediate lossless generic refinement region", 48: "page information", 49: "end of page", 50: "end of stripe", 51: "end of file", 52: "profiles", 53: "tables", 62: "extension"}
DICTIONARY, TEXT, PAGE, GENERIC, END_PAGE, END_FILE = 0, 6, 48, 38, 49, 51
#: The usual adaptive pixels of template 0, as bytes.
_AT = bytes([3, 0xFF, 0xFD, 0xFF, 2, 0xFE, 0xFE, 0xFE])
#: Pages of one file.
FILE_PAGES = 64


def segments(pages: DataFrame, key: str = "vec_id") -> DataFrame:
    """(page, kind, number): page information, region and end for each page, numbered within pages; base numbers come from the page's rank."""
    kinds = F.explode(F.array(*(F.lit(k).cast("long") for k in (PAGE, GENERIC, END_PAGE))))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(key))
    # numbers run through a shard (a file of up to 1,024 pages), so no sort of all pages is needed
    p = pages.select(key, F.floor(F.col(key) / 1024).cast("long").alias("shard")).withColumn("rank", rank)
    e = p.select("shard", F.col(key).alias("page"), "rank", kinds.alias("kind"))
    at = F.when(F.col("kind") == PAGE, 0).when(F.col("kind") == GENERIC, 1).otherwise(2)
    return e.select("shard", "page", "kind", ((F.col("rank") - 1) * 3 + at).cast("long").alias("number"))


def segment(number: int, kind: int, page: int, payload: bytes, refers: tuple[int, ...] = ()) -> bytes:
    """A segment with its header; more than four references take a 4-byte count and a byte of retention bits for every eight segments."""
    size = "B" if number <= 256 else "H" if number <= 65536 else "I"
    count = struct.pack(">B", len(refers) << 5) if len(refers) <= 4 else struct.pack(">I", 7 << 29 | len(refers)) + bytes((len(refers) + 8) // 8)
    head = struct.pack(">IB", number, kind | (0x40 if page > 255 else 0)) + count
    return head + b"".join(struct.pack(">" + size, r) for r in refers) + struct.pack(">I" if page > 255 else ">B", page) + struct.pack(">I", len(payload)) + payload


def page_information(width: int, height: int, dpi: int = 300) -> bytes:
    metre = round(dpi / 0.0254)
    return struct.pack(">IIIIBH", width, height, metre, metre, 1, 0)


def region(width: int, height: int, data: bytes, x: int = 0, y: int = 0) -> bytes:
    """A generic region with the 16-pixel template and its usual adaptive pixels."""
    return struct.pack(">IIIIBB", width, height, x, y, 0, 0) + _AT + data


def document(pages: list[tuple[int, int, bytes]], dpi: int = 300) -> bytes:
    """A file of (width, height, coded generic region) pages."""
    out, n = MAGIC + struct.pack(">BI", 1, len(pages)), 0
    for i, (w, h, data) in enumerate(pages, 1):
        for kind, payload in ((PAGE, page_information(w, h, dpi)), (GENERIC, region(w, h, data)), (END_PAGE, b"")):
            out += segment(n, kind, i, payload)
            n += 1
    return out + segment(n, END_FILE, 0, b"")


def generic_documents(coded: DataFrame, key: str = "vec_id", per_file: int = FILE_PAGES) -> DataFrame:
    """(file, ids, data): files of up to ``per_file`` pages by ranges of the key, from (key, width, height, payload) of generic regions."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        data = document([(w, h, bytes(p)) for w, h, p in zip(pdf["width"].tolist(), pdf["height"].tolist(), pdf["payload"])])
        return pd.DataFrame({"file": [int(pdf["file"].iloc[0])], "ids": [pdf[key].tolist()], "data": [data]})

    numbered = coded.select(key, "width", "height", "payload", F.floor(F.col(key) / per_file).alias("file"))
    return spread(numbered, "file").groupBy("file").applyInPandas(one, "file long, ids array<long>, data binary")


def dictionary(symbols: list[np.ndarray]) -> bytes:
    """Payload of a symbol dictionary segment."""
    return struct.pack(">H", 0) + _AT + struct.pack(">II", len(symbols), len(symbols)) + coding.encode_dictionary(symbols)


def symbol_document(pages: list[tuple[int, int, list[tuple[int, int, np.ndarray]]]], dpi: int = 300) -> bytes:
    """A file of (width, height, [(y, x, bitmap)]) pages: bitmaps used twice or more are in a dictionary for all pages, the others in their page's.

    Ids are places in the global dictionary, followed by the page's, each ordered by height, width and bits. A page without a
    symbol is an empty generic region. Text regions have corners at the top left and strips of one row.
    """
    return symbol_files([pages], dpi)[0]


def symbol_files(files: list[list[tuple[int, int, list[tuple[int, int, np.ndarray]]]]], dpi: int = 300) -> list[bytes]:
    """:func:`symbol_document` of each of some files; the text regions of all their pages are coded together."""
    decisions, most = [], 1

    def parts(pages):
        """(payload, or the head and place of a text region; kind, page, references) of the segments of a file."""
        nonlocal most
        names: dict[int, tuple] = {}
        key = lambda b: names.get(id(b)) or names.setdefault(id(b), (b.shape, b.tobytes()))
        uses = Counter(key(b) for _, _, found in pages for _, _, b in found)
        every = {key(b): b for _, _, found in pages for _, _, b in found}
        shared = sorted(k for k, n in uses.items() if n > 1)
        n, refers, out = 0, (), []
        if shared:
            out, n, refers = [(dictionary([every[k] for k in shared]), DICTIONARY, 0, ())], 1, (0,)
        place = {k: i for i, k in enumerate(shared)}
        bitmaps = [every[k] for k in shared]
        for page, (width, height, found) in enumerate(pages, 1):
            own = sorted({key(b) for _, _, b in found if uses[key(b)] == 1})
            mine = [(page_information(width, height, dpi), PAGE, ())]
            if own:
                mine.append((dictionary([every[k] for k in own]), DICTIONARY, ()))
            if found:
                here = {k: i for i, k in enumerate(own, len(shared))}
                drawn = sorted((y, x, here[k] if (k := key(b)) in here else place[k]) for y, x, b in found)
                symbols = bitmaps + [every[k] for k in own]
                most = max(most, len(symbols))
                decisions.append(coding.text_decisions(drawn, symbols))
                head = struct.pack(">IIIIBHI", width, height, 0, 0, 0, 1 << 4, len(drawn))
                mine.append(((head, len(decisions) - 1), TEXT, refers + ((n + 1,) if own else ())))
            elif width:
                mine.append((region(width, height, coding.encode_bitmap(np.zeros((height, width), bool))), GENERIC, ()))
            out += [(payload, kind, page, to) for payload, kind, to in [*mine, (b"", END_PAGE, ())]]
            n += len(mine) + 1
        return out

    planned = [parts(pages) for pages in files]
    coded = lockstep.encode(decisions, coding.IDS + (1 << coding.id_bits(most)))
    whole = []
    for pages, out in zip(files, planned):
        data = [MAGIC + struct.pack(">BI", 1, len(pages))]
        for n, (payload, kind, page, to) in enumerate([*out, (b"", END_FILE, 0, ())]):
            data.append(segment(n, kind, page, payload[0] + coded[payload[1]] if kind == TEXT else payload, to))
        whole.append(b"".join(data))
    return whole


def read_segments(data: bytes):
    """(number, kind, references, page, payload) of each segment of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a coded document")
    at = 13 if not data[8] & 2 else 9
    while at < len(data):
        number, flags, count = struct.unpack_from(">IBB", data, at)
        at += 5
        if count >> 5 < 7:
            count, at = count >> 5, at + 1
        else:
            count = struct.unpack_from(">I", data, at)[0] & 0x1FFFFFFF
            at += 4 + (count + 8) // 8
        size = 1 if number <= 256 else 2 if number <= 65536 else 4
        refers = [int.from_bytes(data[at + i * size : at + (i + 1) * size], "big") for i in range(count)]
        at += count * size
        wide = 4 if flags & 0x40 else 1
        page, length = int.from_bytes(data[at : at + wide], "big"), struct.unpack_from(">I", data, at + wide)[0]
        at += wide + 4
        if flags & 63 not in TYPES:
            raise ValueError(f"segment {number} has the unknown type {flags & 63}")
        yield number, flags & 63, refers, page, data[at : at + length]
        at += length


def read_pages(data: bytes) -> list[np.ndarray]:
    """The pages of a file of generic and text regions."""
    return next(read_files([data]))


def read_files(files: list[bytes]) -> Iterator[list[np.ndarray]]:
    """:func:`read_pages` of each of some files; the text regions of all of them are decoded together."""
    texts, planned = [], []
    for data in files:
        known, plan = {}, []
        for number, kind, refers, _, payload in read_segments(data):
            if kind == PAGE:
                plan.append([*struct.unpack_from(">II", payload), []])
            elif kind == DICTIONARY:
                symbols = coding.decode_dictionary(payload[18:], struct.unpack_from(">I", payload, 14)[0])
                known[number] = coding.dots(symbols), np.array([s.shape[1] for s in symbols], np.int64)
            elif kind in (GENERIC, TEXT):
                at = struct.unpack_from(">IIII", payload)
                if kind == GENERIC:
                    plan[-1][2].append((at, payload[26:], None))
                else:
                    wide = np.concatenate([known[r][1] for r in refers]) if refers else np.zeros(0, np.int64)
                    plan[-1][2].append((at, len(texts), [known[r][0] for r in refers]))
                    texts.append((payload[23:], struct.unpack_from(">I", payload, 19)[0], wide))
        planned.append(plan)
    found = lockstep.decode_texts(texts)
    for plan in planned:
        pages = []
        for page_width, page_height, regions in plan:
            pages.append(np.zeros((page_height, page_width), bool))
            for (width, height, x, y), data, dots in regions:
                drawn = coding.Decoder(data).bitmap(width, height) if dots is None else coding.drawn(width, height, *found[data], dots)
                pages[-1][y : y + height, x : x + width] |= drawn
        yield pages


#: Symbols of the files that a task codes together, if these are more than one, and files that it reads together.
TOGETHER, FILES = 400_000, 32


def symbol_documents(symbols: DataFrame, sizes: DataFrame, key: str = "doc_id", per_file: int = FILE_PAGES) -> DataFrame:
    """(file, ids, data): files of up to ``per_file`` pages by ranges of the key, in symbol mode, from symbols (key, x, y, width, height, words) and page sizes.

    Every page of ``sizes`` is in a file, with or without symbols. A file is one task's work, and a task does some files together.
    """
    found = symbols.groupBy(key).agg(F.collect_list(F.struct("x", "y", "width", "height", "words")).alias("symbols"))
    pages = sizes.join(found, key, "left").withColumn("file", F.floor(F.col(key) / per_file))

    def drawn(batches):
        """(file, key, page width, page height, [(y, x, bitmap)]) of each page."""
        known: dict = {}
        for batch in batches:
            file, ids, width, height = (batch.column(c).to_pylist() for c in ("file", key, "page_width", "page_height"))
            held = batch.column("symbols")
            each = held.values
            x, y, w, h = (each.field(c).to_pylist() for c in ("x", "y", "width", "height"))
            words = each.field("words")
            flat, cut, ends = words.values.to_numpy(), words.offsets.to_numpy(), held.offsets.to_numpy().tolist()
            for i in range(batch.num_rows):
                if i and file[i] != file[i - 1]:
                    known = {}
                out = []
                for k in range(ends[i], ends[i + 1]):
                    own = flat[cut[k] : cut[k + 1]]
                    name = w[k], h[k], own.tobytes()
                    if name not in known:
                        known[name] = matching.pixels(own[None], w[k], h[k])[0]
                    out.append((y[k], x[k], known[name]))
                yield file[i], ids[i], width[i], height[i], out

    def run(batches):
        held, n = [], 0

        def files() -> pa.RecordBatch:
            data = symbol_files([[p[2:] for p in pages] for pages in held])
            return pa.RecordBatch.from_arrays([pa.array([p[0][0] for p in held], pa.int64()), pa.array([[p[1] for p in pages] for pages in held], pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["file", "ids", "data"])

        for page in drawn(batches):
            if held and held[-1][0][0] == page[0]:
                held[-1].append(page)
            else:
                if n >= TOGETHER or len(held) >= FILES:
                    yield files()
                    held, n = [], 0
                held.append([page])
            n += len(page[4])
        if held:
            yield files()

    return spread(pages.select("file", key, "page_width", "page_height", "symbols"), "file").sortWithinPartitions("file", key).mapInArrow(run, "file long, ids array<long>, data binary")


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, y, x0, x1): the black runs of every page of files (file, ids, data)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                some = batch.slice(at, FILES)
                for ids, pages in zip(some.column("ids").to_pylist(), read_files(some.column("data").to_pylist())):
                    yield from kernels.run_batches(pa.array(ids, pa.int64()), [kernels.row_runs(page) for page in pages], key)

    return files.select("ids", "data").mapInArrow(run, f"`{key}` long, y long, x0 long, x1 long")


def dictionaries(t: DataFrame, key: str) -> DataFrame:
    """(key, symbols, data): a dictionary alone, without pages, of the distinct bitmaps (key, width, height, words) of each key."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [matching.pixels(np.array([words]), w, h)[0] for w, h, words in zip(pdf["width"].tolist(), pdf["height"].tolist(), pdf["words"])]
        every.sort(key=lambda b: (b.shape, b.tobytes()))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "symbols": [len(every)], "data": [dictionary(every)]})

    kind = t.schema[key].dataType.simpleString()
    return spread(t.select(key, "width", "height", "words").distinct(), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, symbols long, data binary")


def read_dictionaries(d: DataFrame, key: str) -> DataFrame:
    """(key, position, width, height, words) of dictionaries as :func:`dictionaries` makes them."""
    kind = d.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("data").to_pylist()):
                found = coding.decode_dictionary(data[18:], struct.unpack_from(">I", data, 14)[0])
                words = [np.packbits(np.pad(b, ((0, 0), (0, -b.shape[1] % 32))), axis=1).view(">u4").astype(np.int64).ravel() for b in found]
                at = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(at), pa.array(np.arange(len(found))), *(pa.array([b.shape[s] for b in found], pa.int64()) for s in (1, 0)), pa.array(words, pa.list_(pa.int64()))], names=[key, "position", "width", "height", "words"])

    return d.select(key, "data").mapInArrow(run, f"`{key}` {kind}, position long, width long, height long, words array<long>")
