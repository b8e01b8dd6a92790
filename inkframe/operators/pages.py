"""Pages of any size as black runs: components, dots, wide glyphs, and the symbols that are cut from them.

A text is a page, one line per row of pixels and one character per pixel; characters of ``ink`` are black. Runs, components and
boxes keep the page's key, and all work within a page: either in the task that holds the page, or after one exchange by key.
Components are numbered by their first pixel in row order, ``y << 24 | x``, and connect in all eight directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators import blocks

#: Letters that are black where a text stands for a page of separate marks.
INK = "aeo"
#: Sides beyond which a symbol is left out.
OVERSIZE = 10_000
#: Characters of pages that a task works on at once, unless a single page has more.
CHARS = 1 << 18
#: Lines between two pages that are worked on together, more than a dot may be above its base.
APART = 64


def _page_runs(texts: list[str | None], ink: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """(page, y, x0, x1) of all runs, in row order."""
    held = [t or "" for t in texts]
    code = np.frombuffer("".join(t + "\n" for t in held).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in held])
    breaks = np.flatnonzero(code == 10)
    black = ink(code) & (code != 10)
    edge = np.diff(np.concatenate([[0], black.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(breaks, start)
    begin = np.concatenate([[0], breaks + 1])[line]
    page = np.searchsorted(ends, start, side="right")
    first_line = np.searchsorted(breaks, np.concatenate([[0], ends])[page])
    return page, line - first_line, start - begin, stop - 1 - begin


def _ink(letters: str | None) -> Callable[[np.ndarray], np.ndarray]:
    if letters is None:
        return lambda code: code != 32
    table = np.zeros(128, dtype=bool)
    table[[ord(c) for c in letters]] = True
    return lambda code: (code < 128) & table[np.minimum(code, 127)]


def runs(docs: DataFrame, ink: str | None = INK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, y, x0, x1) of the black runs of each page; without ``ink`` all but the space is black. No exchange."""
    kind, black = docs.schema[key].dataType.simpleString(), _ink(ink)

    def run(batches):
        for keys, texts in _some(batches):
            page, y, x0, x1 = _page_runs(texts, black)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(page)), *(pa.array(v.astype(np.int64)) for v in (y, x0, x1))], names=[key, "y", "x0", "x1"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, y long, x0 long, x1 long")


def label(line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For runs in row order, the first run of the component of each; runs of neighbouring lines touch if at most one pixel apart."""
    wide = int(x1.max(initial=0)) + 3
    low = np.searchsorted(line * wide + x1, (line + 1) * wide + np.maximum(x0 - 1, 0))
    high = np.searchsorted(line * wide + x0, (line + 1) * wide + x1 + 1, side="right")
    size = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(line)), size)
    b = np.repeat(low, size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    out = np.arange(len(line))
    while True:
        least, now = np.minimum(out[a], out[b]), out.copy()
        for end in (a, b):
            np.minimum.at(now, end, least)
            np.minimum.at(now, out[end], least)
        now = now[now]
        if (now == out).all():
            return out
        out = now


def components(docs: DataFrame, ink: str | None = INK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, comp, x, y, width, height, n, runs) of the components of each page; runs are structs of y, x0 and x1."""
    return steps(docs, "components", ink=ink, key=key, text=text)


class Sheets:
    """Some pages together, as arrays: runs in row order and components, from end to end in numpy. All of it is by page, so it needs no exchange."""

    def __init__(self, texts: list[str | None], ink: Callable[[np.ndarray], np.ndarray]) -> None:
        self.count = len(texts)
        self.page, self.y, self.x0, self.x1 = _page_runs(texts, ink)
        high = np.zeros(self.count, np.int64)
        np.maximum.at(high, self.page, self.y)
        #: a number for the first line of each page
        self.top = np.concatenate([[0], np.cumsum(high + APART)])[:-1]
        self.line = self.y + self.top[self.page]
        self.wide = int(self.x1.max(initial=0)) + 3
        self.texts = texts

    def components(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """Components in row order of their first runs, runs in order of components, and where each component's begin."""
        if not len(self.page):
            return {k: np.zeros(0, np.int64) for k in ("page", "comp", "x", "y", "width", "height", "n")}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        y, x0, x1 = self.y, self.x0, self.x1
        first, where, count = np.unique(label(self.line, x0, x1), return_inverse=True, return_counts=True)
        order = np.argsort(where, kind="stable")
        cut = np.cumsum(count) - count
        fold = lambda f, v: f.reduceat(v[order], cut)
        left, right, top, bottom, n = fold(np.minimum, x0), fold(np.maximum, x1), fold(np.minimum, y), fold(np.maximum, y), fold(np.add, x1 - x0 + 1)
        return {"page": self.page[first], "comp": y[first] << 24 | x0[first], "x": left, "y": top, "width": right - left + 1, "height": bottom - top + 1, "n": n}, order, cut

    def hits(self, b: dict) -> tuple[np.ndarray, np.ndarray]:
        """(box, run) of every run inside a box, in order of boxes and then in row order."""
        owner = np.repeat(np.arange(len(b["page"])), b["height"])
        line = self.top[b["page"][owner]] + b["y"][owner] + _counted(b["height"])
        left, right = b["x"][owner], b["x"][owner] + b["width"][owner] - 1
        # a box may leave its line's last run to the right, not the range of keys of a line
        low = np.searchsorted(self.line * self.wide + self.x1, line * self.wide + np.minimum(left, self.wide - 1))
        high = np.searchsorted(self.line * self.wide + self.x0, line * self.wide + np.minimum(right, self.wide - 1), side="right")
        size = np.maximum(high - low, 0)
        return np.repeat(owner, size), np.repeat(low, size) + _counted(size)


def _counted(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _of(b: dict, at: np.ndarray) -> dict:
    return {k: v[at] for k, v in b.items()}


def _upper_median(page: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each row its page's element floor(n / 2) from 0 of the sorted values."""
    order = np.lexsort((value, page))
    _, where, count = np.unique(page, return_inverse=True, return_counts=True)
    return value[order][np.cumsum(count) - count + count // 2][where]


def is_dot(c: dict, size_ratio: float, height_ratio: float) -> np.ndarray:
    """Components small against their page's upper medians, and about as wide as high."""
    aspect = c["width"] / c["height"]
    small = (c["n"] <= np.floor(_upper_median(c["page"], c["n"]) * size_ratio)) & (c["height"] <= np.floor(_upper_median(c["page"], c["height"]) * height_ratio))
    return small & (aspect >= 0.5) & (aspect <= 2)


def reach(c: dict, pages: int, first: int = 10) -> np.ndarray:
    """Of each page how far below a dot its base may begin: from mean and deviation of the first components' heights, within 5 and 30."""
    order = np.lexsort((c["comp"], c["x"], c["y"], c["page"]))
    page = c["page"][order]
    top = _counted(np.bincount(page, minlength=pages)) < first
    page, height = page[top], c["height"][order][top]
    n = np.maximum(np.bincount(page, minlength=pages), 1)
    mean = np.bincount(page, height, pages) / n
    deviation = np.sqrt(np.bincount(page, (height - mean[page]) ** 2, pages) / n)
    return np.clip(np.floor(np.round(0.6 * mean + 0.5 * deviation, 9)), 5, 30).astype(np.int64)


def merge_dots(s: Sheets, c: dict, dot: np.ndarray) -> dict:
    """The components with every dot added to its base: the nearest component below, within the page's merge distance, that isn't a dot itself.

    Boxes are united and pixels added; dots with a base are gone. Rows below a dot are searched one after the other, for all dots without a base yet.
    """
    d, base = np.flatnonzero(dot), np.flatnonzero(~dot)
    to = np.arange(len(dot))
    if len(d) and len(base):
        wide = s.wide + 1
        base = base[np.lexsort((c["x"][base], c["y"][base], c["page"][base]))]
        key = (s.top[c["page"][base]] + c["y"][base]) * wide + c["x"][base]
        widest = np.zeros(s.count, np.int64)
        np.maximum.at(widest, c["page"][base], c["width"][base])
        most = reach(c, s.count)[c["page"][d]]
        centre, under = c["x"][d] + c["width"][d] // 2, s.top[c["page"][d]] + c["y"][d] + c["height"][d]
        for gap in range(1, int(most.max()) + 1):
            within = most >= gap
            d, most, centre, under = d[within], most[within], centre[within], under[within]
            row = (under + gap) * wide
            low = np.searchsorted(key, row + np.maximum(centre - 1 - widest[c["page"][d]], 0))
            size = np.searchsorted(key, row + np.minimum(centre + 1, wide - 1), side="right") - low
            owner, at = np.repeat(np.arange(len(d)), size), base[np.repeat(low, size) + _counted(size)]
            fits = centre[owner] <= c["x"][at] + c["width"][at] + 1
            owner, at = owner[fits], at[fits]
            if len(owner):
                best = np.full(len(d), np.iinfo(np.int64).max)
                np.minimum.at(best, owner, c["comp"][at])
                chosen = c["comp"][at] == best[owner]
                to[d[owner[chosen]]] = at[chosen]
                free = np.ones(len(d), bool)
                free[owner] = False
                d, most, centre, under = d[free], most[free], centre[free], under[free]
            if not len(d):
                break
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order], prepend=-1))
    if not len(cut):
        return c | {"parts": np.zeros(0, np.int64)}
    fold = lambda f, v: f.reduceat(v[order], cut)
    left, top = fold(np.minimum, c["x"]), fold(np.minimum, c["y"])
    own = to[order][cut]
    return {"page": c["page"][own], "comp": c["comp"][own], "x": left, "y": top, "width": fold(np.maximum, c["x"] + c["width"]) - left, "height": fold(np.maximum, c["y"] + c["height"]) - top, "n": fold(np.add, c["n"]), "parts": np.diff(np.append(cut, len(order)))}


def wide(c: dict, last: int = 10, factor: float = 1.5) -> dict:
    """Of the components those over ``factor`` times as wide as ``mean_before``, the mean width of the ``last`` before them on the page (1 where there is none), and their places."""
    order = np.lexsort((c["comp"], c["x"], c["y"], c["page"]))
    width = c["width"][order]
    _, count = np.unique(c["page"], return_counts=True)
    before = np.minimum(_counted(count), last)
    total = np.concatenate([[0], np.cumsum(width)])
    here = np.arange(len(order))
    mean = np.where(before > 0, np.round((total[here] - total[here - before]) / np.maximum(before, 1), 6), 1.0)
    hit = width > factor * mean
    return _of(c, order[hit]) | {"mean_before": mean[hit], "at": order[hit]}


def cuts(s: Sheets, b: dict, most_black: float = 0.0, side: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(box, cut): where boxes are cut in two, in columns from their left: the middle of their widest gap.

    A gap is a run of columns of the page inside the box, none at either end, with black pixels for at most ``most_black`` of the height;
    of equally wide ones the leftmost counts. Both halves need ``side`` pixels, else there is no cut.
    """
    room = b["width"] + 1
    start = np.cumsum(room) - room
    box, run = s.hits(b)
    black = np.zeros(int(room.sum()) + 1, np.int64)
    np.add.at(black, start[box] + np.maximum(s.x0[run] - b["x"][box], 0), 1)
    np.add.at(black, start[box] + np.minimum(s.x1[run] - b["x"][box] + 1, b["width"][box]), -1)
    owner = np.repeat(np.arange(len(room)), room)
    column = _counted(room)
    full = np.flatnonzero((np.cumsum(black[:-1]) > most_black * b["height"][owner]) & (column < b["width"][owner]))
    owner, column = owner[full], column[full]
    gap = np.diff(column) - 1
    at = np.flatnonzero((np.diff(owner) == 0) & (gap > 0))
    owner, before, gap = owner[at], column[at], gap[at]
    order = np.lexsort((before, -gap, owner))
    best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
    owner, cut = owner[best], before[best] + 1 + gap[best] // 2
    good = (cut >= side) & (b["width"][owner] - cut >= side)
    return owner[good], cut[good]


def split(c: dict, comp_at: np.ndarray, cut: np.ndarray) -> dict:
    """One box for each component, two for one of ``comp_at``, which is cut."""
    names = ("page", "comp", "x", "y", "width", "height")
    first, second = ({k: v.copy() for k, v in c.items() if k in names}, {k: c[k][comp_at] for k in names})
    first["width"][comp_at] = cut
    second["x"], second["width"] = second["x"] + cut, second["width"] - cut
    part = np.concatenate([np.zeros(len(c["page"]), np.int64), np.ones(len(cut), np.int64)])
    return {k: np.concatenate([first[k], second[k]]) for k in names} | {"part": part}


def symbols(s: Sheets, b: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """What a page shows in each box, cut to its black pixels, blank ones left out; the words of all, and where those of each begin and end.

    Words hold 32 pixels, rows padded, leftmost highest.
    """
    box, run = s.hits(b)
    if not len(box):
        return _of(b, np.zeros(0, np.int64)), np.zeros(0, np.int64), np.zeros(1, np.int64)
    x0, x1, y = np.maximum(s.x0[run], b["x"][box]), np.minimum(s.x1[run], b["x"][box] + b["width"][box] - 1), s.y[run]
    cut = np.flatnonzero(np.diff(box, prepend=-1))
    left, right, top, bottom = np.minimum.reduceat(x0, cut), np.maximum.reduceat(x1, cut), np.minimum.reduceat(y, cut), np.maximum.reduceat(y, cut)
    w, h = right - left + 1, bottom - top + 1
    owner = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(box))))
    stride = -(-w // 32)
    start = np.concatenate([[0], np.cumsum(stride * h)])
    row = (start[owner] + (y - top[owner]) * stride[owner]) * 32 - left[owner]
    bits = np.zeros(start[-1] * 32 + 1, np.int32)
    # runs of one box don't overlap, so marks of beginning and end add up to 0 or 1
    np.add.at(bits, row + x0, 1)
    np.add.at(bits, row + x1 + 1, -1)
    words = np.packbits(np.cumsum(bits[:-1]).astype(bool)).view(">u4").astype(np.int64)
    return _of(b, box[cut]) | {"x": left, "y": top, "width": w, "height": h}, words, start


def _accepted(s: Sheets, found: dict) -> np.ndarray:
    """Places of the symbols of pages that are worth a dictionary: not those whose one symbol is at (0, 0) and covers all but two pixels of each side of the page."""
    count = np.bincount(found["page"], minlength=s.count)[found["page"]]
    whole = np.flatnonzero((count == 1) & (found["x"] == 0) & (found["y"] == 0))
    keep = np.ones(len(count), bool)
    for i in whole.tolist():
        lines = (s.texts[found["page"][i]] or "").split("\n")
        keep[i] = not (found["width"][i] >= max(map(len, lines)) - 2 and found["height"][i] >= len(lines) - 2)
    return np.flatnonzero(keep)


#: What the steps from page to symbol give, besides the page.
STAGES = {
    "components": "comp x y width height n runs",
    "boxes": "comp x y width height n",
    "least": "comp x y width height n",
    "dots": "comp x y width height n",
    "merged": "comp x y width height n parts",
    "wide": "comp x y width height n mean_before",
    "parts": "comp part x y width height",
    "symbols": "comp part x y width height words",
    "extracted": "comp part x y width height words",
    "shapes": "comp part x y width height words",
}
_KINDS = {"runs": "array<struct<y:long,x0:long,x1:long>>", "words": "array<long>", "mean_before": "double"}


def steps(docs: DataFrame, stage: str, pixels: int = 3, size_ratio: float = 0.5, height_ratio: float = 0.5, most_black: float = 0.0, side: int = 5, ink: str | None = INK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ...) of one of ``STAGES``: components, those of ``pixels`` or more, dots, components with dots merged into bases, wide ones, boxes with wide ones split, symbols cut to their
    pixels, these without oversize and whole-page ones (extracted), and the symbols of all components as they are (shapes).

    One pass over the pages, some at a time: no exchange, and as much memory as ``CHARS`` characters or one page take.
    """
    kind, black, names = docs.schema[key].dataType.simpleString(), _ink(ink), STAGES[stage].split()

    def worked(s: Sheets) -> dict:
        c, order, cut = s.components()
        if stage == "components":
            each = pa.StructArray.from_arrays([pa.array(v[order].astype(np.int64)) for v in (s.y, s.x0, s.x1)], ["y", "x0", "x1"])
            return c | {"runs": pa.ListArray.from_arrays(pa.array(np.append(cut, len(order)).astype(np.int32)), each)}
        if stage == "boxes":
            return c
        if stage == "shapes":
            return listed(*symbols(s, c | {"part": np.zeros(len(c["page"]), np.int64)}))
        c = _of(c, c["n"] >= pixels)
        if stage == "least" or not len(c["page"]):
            return c
        dot = is_dot(c, size_ratio, height_ratio)
        if stage == "dots":
            return _of(c, dot)
        c = merge_dots(s, c, dot)
        if stage == "merged":
            return c
        hit = wide(c)
        if stage == "wide":
            return hit
        box, cut = cuts(s, hit, most_black, side)
        boxes = split(c, hit["at"][box], cut)
        if stage == "parts":
            return boxes
        if stage == "extracted":
            boxes = _of(boxes, (boxes["width"] <= OVERSIZE) & (boxes["height"] <= OVERSIZE))
        found, words, start = symbols(s, boxes)
        found = listed(found, words, start)
        if stage == "symbols":
            return found
        at = _accepted(s, found)
        return {k: v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at] for k, v in found.items()}

    def listed(found: dict, words: np.ndarray, start: np.ndarray) -> dict:
        return found | {"words": pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(words))}

    def run(batches):
        for keys, texts in _some(batches):
            out = worked(Sheets(texts, black))
            if len(out["page"]):
                held = [v if isinstance(v, pa.Array) else pa.array(v if v.dtype == np.float64 else v.astype(np.int64)) for v in (out[c] for c in names)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(out["page"])), *held], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} {_KINDS.get(c, 'long')}" for c in names))


def _some(batches) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of batches, ``CHARS`` characters or one page at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1)
        cut = [c for c in np.flatnonzero(np.diff(size // CHARS, prepend=0)).tolist() if c]
        for low, high in zip([0, *cut], [*cut, batch.num_rows]):
            yield batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).to_pylist()


def usable(boxes: DataFrame) -> DataFrame:
    """Boxes with both sides from 1 to ``OVERSIZE``."""
    return boxes.where(F.col("width").between(1, OVERSIZE) & F.col("height").between(1, OVERSIZE))


def accept(found: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The symbols of pages that are worth a dictionary: not those whose one symbol is at (0, 0) and covers all but two pixels of each side of (key, page_width, page_height)."""
    j = found.join(sizes, key).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    whole = (F.col("_n") == 1) & (F.col("x") == 0) & (F.col("y") == 0) & (F.col("width") >= F.col("page_width") - 2) & (F.col("height") >= F.col("page_height") - 2)
    return j.where(~whole).select(*found.columns)


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_width, page_height): the longest line, and how many lines there are."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return docs.select(key, F.array_max(F.transform(lines, lambda s: F.length(s))).cast("long").alias("page_width"), F.size(lines).cast("long").alias("page_height"))


def extract(docs: DataFrame, pixels: int = 3, size_ratio: float = 0.5, height_ratio: float = 0.5, most_black: float = 0.0, side: int = 5, key: str = "doc_id") -> DataFrame:
    """Symbols of pages from end to end: components, least size, dots merged into bases, wide ones split, cut to their pixels, oversize and whole-page ones left out."""
    return steps(docs, "extracted", pixels, size_ratio, height_ratio, most_black, side, key=key)


def templates(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(template_id, width, height, words, usage, pages, scope) of distinct bitmaps, numbered by their first occurrence in reading order of pages.

    Those used more than once, or by the only page, are global; the others belong to their page.
    """
    first = F.min(F.struct(key, "y", "x", "part", "comp"))
    t = found.groupBy("width", "height", "words").agg(F.count("*").alias("usage"), F.array_sort(F.collect_set(key)).alias("pages"), first.alias("f"))
    # kept, as it is read again for the number of pages, and in dictionary_ids for positions
    t = blocks.kept(t)
    n = t.agg((F.min(F.element_at("pages", 1)) == F.max(F.element_at("pages", -1))).alias("single"))  # one row
    scope = F.when((F.col("usage") > 1) | F.col("single"), "global").otherwise("local")
    return t.join(F.broadcast(n)).select(F.col(f"f.{key}").alias("first_page"), F.col("f.y").alias("first_y"), F.col("f.x").alias("first_x"), "width", "height", "words", "usage", "pages", scope.alias("scope"))


def dictionary_ids(t: DataFrame) -> DataFrame:
    """The templates with ``position`` in their dictionary, global or of the page, ordered by height, width and bits, and ``id`` on their page: local ones come after all global ones.

    Positions of the global dictionary are counted within heights and then over the heights, so no task sorts all of it.
    """
    order = ["width", "words"]
    local = F.when(F.col("scope") == "local", F.col("first_page"))
    t = t.withColumn("home", local)
    own = Window.partitionBy("home", "height").orderBy(*order)
    t = t.withColumn("within", F.row_number().over(own) - 1)
    per = t.groupBy("home", "height").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("home").orderBy("height").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).select(F.col("home").alias("h"), F.col("height").alias("hh"), "before")
    t = t.join(per, F.col("home").eqNullSafe(F.col("h")) & (F.col("height") == F.col("hh"))).drop("h", "hh")
    total = t.where("home IS NULL").agg(F.count("*").alias("globals"))  # one row
    position = (F.col("before") + F.col("within")).cast("long")
    return t.join(F.broadcast(total)).withColumn("position", position).withColumn("id", F.when(F.col("home").isNull(), F.col("position")).otherwise(F.col("globals") + F.col("position"))).drop("before", "within", "globals", "home")


def resolve(found: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, x, y, width, height, scope, id): the symbols of each page in coding order (by y, then x) with the ids of their templates.

    A symbol without a template is an error, as a dangling reference.
    """
    named = found.join(ids.select("width", "height", "words", "scope", "id"), ["width", "height", "words"], "left")
    checked = F.coalesce("id", F.raise_error(F.lit("a symbol without a template")).cast("long"))
    w = Window.partitionBy(key).orderBy("y", "x", "comp", "part")
    return named.select(key, (F.row_number().over(w) - 1).cast("long").alias("seq"), "x", "y", "width", "height", "scope", checked.alias("id"))


def region_fits(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a symbol's far corner is an unsigned 32-bit number."""
    return (x >= 0) & (y >= 0) & (x + width < 1 << 32) & (y + height < 1 << 32)
