"""Arithmetic coding of integers, symbol dictionaries, text regions and bitmaps of any size (ITU-T T.88), with the decoder beside it."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed values of ISO/IEC 14492 table E.1: (Qe, next after MPS, next after LPS, switch).
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]

#: The same by index << 1 | more probable bit, which is how states are held.
QE = [s[0] for s in STATES for _ in (0, 1)]
MORE = [up << 1 | m for _, up, _, _ in STATES for m in (0, 1)]
LESS = [down << 1 | m ^ switch for _, _, down, switch in STATES for m in (0, 1)]

#: Fixed values of annex A: (first magnitude of the range, prefix bits, value bits).
INTEGERS = [(0, "0", 2), (4, "10", 4), (20, "110", 6), (84, "1110", 8), (340, "11110", 12), (4436, "11111", 32)]


#: Contexts of integers by name, 512 each; those of ids follow.
NAMES = {"IADT": 0, "IAFS": 512, "IADS": 1024}
IDS = 1536


@functools.lru_cache(1 << 14)
def integer_decisions(value: int | None) -> tuple[tuple[int, int], ...]:
    """(context below 512, bit) of an integer by annex A.2; None is out of band."""
    sign, size = (1, 0) if value is None else (int(value < 0), abs(value))
    low, prefix, bits = next(r for r in reversed(INTEGERS) if size >= r[0])
    if size - low >> bits:
        raise ValueError(f"{value} has no code")
    out, before = [], 1
    for b in map(int, f"{sign}{prefix}{size - low:0{bits}b}"):
        out.append((before, b))
        before = before << 1 | b if before < 256 else ((before << 1 | b) & 511) | 256
    return tuple(out)


@functools.lru_cache(1 << 14)
def _decided(first: int, value: int | None) -> np.ndarray:
    """context << 1 | bit of an integer whose contexts begin at ``first``."""
    return np.array([first + c << 1 | b for c, b in integer_decisions(value)], np.int32)


@functools.lru_cache(1 << 14)
def _identified(value: int, size: int) -> np.ndarray:
    return np.array([IDS + ((1 << i) | value >> size - i) << 1 | value >> size - 1 - i & 1 for i in range(size)], np.int32)


#: Width from which rows are decoded with numpy's help.
WIDE = 48


class Encoder:
    """The MQ coder with named contexts."""

    def __init__(self) -> None:
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray([0])
        self.states: dict = {}

    def bit(self, context, bit: int) -> None:
        state = self.states.get(context, 0)
        qe = QE[state]
        a = self.a - qe
        likely = bit == state & 1
        if (a < qe) == likely:
            a = qe
        else:
            self.c += qe
        if likely and a & 0x8000:
            self.a = a
            return
        self.states[context] = MORE[state] if likely else LESS[state]
        shifts = 16 - a.bit_length()
        self.a = a << shifts
        while shifts >= self.ct:
            self.c <<= self.ct
            shifts -= self.ct
            self._byte()
        self.c <<= shifts
        self.ct -= shifts

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        wide = 20 if self.out[-1] == 0xFF else 19
        self.out.append(self.c >> wide)
        self.c &= (1 << wide) - 1
        self.ct = 27 - wide

    def repeated(self, context, bit: int, times: int) -> None:
        """The same decision so many times; likely ones between two renormalisations are taken at once."""
        while times:
            state = self.states.get(context, 0)
            qe = QE[state]
            if bit == state & 1 and (more := min((self.a - 0x8000) // qe, times - 1)) > 0:
                self.a, self.c, times = self.a - more * qe, self.c + more * qe, times - more
            self.bit(context, bit)
            times -= 1

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:]) + b"\xff\xac"

    def integer(self, name: str, value: int | None) -> None:
        """An integer by annex A.2, in the contexts of ``name``; None is out of band."""
        for before, b in integer_decisions(value):
            self.bit((name, before), b)

    def identity(self, value: int, size: int) -> None:
        """A number of ``size`` bits by annex A.3."""
        before = 1
        for i in range(size - 1, -1, -1):
            b = value >> i & 1
            self.bit(("IAID", before), b)
            before = before << 1 | b

    def bitmap(self, rows: np.ndarray) -> None:
        """A generic region with template 0 and its usual adaptive pixels."""
        for context, bit in zip(contexts(rows).ravel().tolist(), rows.ravel().tolist()):
            self.bit(context, int(bit))


class Decoder:
    """The counterpart of :class:`Encoder`."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.states: dict = {}
        self.c = self._peek(0) << 16
        self.ct = 0
        self._byte()
        self.c, self.ct, self.a = self.c << 7, self.ct - 7, 0x8000

    def _peek(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def _byte(self) -> None:
        if self._peek(self.at) == 0xFF:
            if self._peek(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self._peek(self.at) << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self._peek(self.at) << 8
            self.ct = 8

    def bit(self, context) -> int:
        state = self.states.get(context, 0)
        qe = QE[state]
        a = self.a - qe
        if self.c >> 16 < qe:  # the lower part of the interval
            likely = a < qe
            a = qe
        else:
            self.c -= qe << 16
            if a & 0x8000:
                self.a = a
                return state & 1
            likely = a >= qe
        self.states[context] = MORE[state] if likely else LESS[state]
        shifts = 16 - a.bit_length()
        self.a = a << shifts
        while shifts > self.ct:
            self.c <<= self.ct
            shifts -= self.ct
            self._byte()
        self.c <<= shifts
        self.ct -= shifts
        return state & 1 if likely else 1 - (state & 1)

    def integer(self, name: str) -> int | None:
        before = 1

        def bit() -> int:
            nonlocal before
            b = self.bit((name, before))
            before = before << 1 | b if before < 256 else ((before << 1 | b) & 511) | 256
            return b

        sign, prefix = bit(), ""
        while prefix not in {r[1] for r in INTEGERS}:
            prefix += str(bit())
        low, _, bits = next(r for r in INTEGERS if r[1] == prefix)
        size = low + int("".join(str(bit()) for _ in range(bits)), 2)
        return None if sign and not size else -size if sign else size

    def identity(self, size: int) -> int:
        before = 1
        for _ in range(size):
            before = before << 1 | self.bit(("IAID", before))
        return before - (1 << size)

    def bitmap(self, width: int, height: int) -> np.ndarray:
        return self.rest(np.zeros((height, width), bool), 0, 0)

    def rest(self, rows: np.ndarray, y: int, x: int) -> np.ndarray:
        """The bitmap, of which all before (y, x) is known, with the rest decoded in place."""
        height, width = rows.shape
        padded = lambda i: [0] * 4 + (rows[i].tolist() if i >= 0 else [0] * width) + [0] * 4
        if width >= WIDE:
            return self._wide(rows, y, x)
        up2, up1, bit = padded(y - 2), padded(y - 1), self.bit
        for i in range(y, height):
            own, first = [0] * (width + 8), x if i == y else 0
            own[4 : first + 4] = rows[i, :first].tolist()
            # what moves along: 4 of 5, 6 of 7 and 4 pixels
            a = b = c = 0
            for k in range(4):
                a, c = a << 1 | up2[first + 2 + k], c << 1 | own[first + k]
            for k in range(6):
                b = b << 1 | up1[first + 1 + k]
            for k in range(first + 4, width + 4):
                a, b = (a << 1 | up2[k + 2]) & 31, (b << 1 | up1[k + 3]) & 127
                own[k] = v = bit(a << 11 | b << 4 | c)
                c = (c << 1 | v) & 15
            rows[i] = own[4 : width + 4]
            up2, up1 = up1, own
        return rows

    def _wide(self, rows: np.ndarray, y: int, x: int) -> np.ndarray:
        """:meth:`rest` with what is above found for a row at once, and white in white surroundings decoded as far as the interval lasts."""
        height, width = rows.shape
        get, bit = self.states.get, self.bit
        for i in range(y, height):
            above, white = (v.tolist() for v in surroundings(rows[i - 1] if i else None, rows[i - 2] if i > 1 else None, width))
            own, k = np.zeros(width, bool).tolist(), 0
            if i == y and x:
                own[:x], k = rows[i, :x].tolist(), x
            c = 0
            for v in own[max(k - 4, 0) : k]:
                c = c << 1 | v
            while k < width:
                context = above[k] | c
                state = get(context, 0)
                qe = QE[state]
                a, high = self.a - qe, self.c >> 16
                if a & 0x8000 and high >= qe:  # the usual case of bit()
                    more = 1
                    if not context and not state & 1 and white[k] > 1:
                        more = min((self.a - 0x8000) // qe, high // qe, white[k])
                    self.a -= more * qe
                    self.c -= more * qe << 16
                    v = state & 1
                    if v:
                        own[k] = True
                    k += more
                else:
                    v = bit(context)
                    own[k] = v == 1
                    k += 1
                c = (c << 1 | v) & 15
            rows[i] = own
        return rows


def _fours(row: np.ndarray | None, width: int) -> np.ndarray | None:
    """Each four neighbours of a row, padded by four, as a number; None for a white row."""
    if row is None or not row.any():
        return None
    p = np.zeros(width + 8, np.uint16)
    p[4 : width + 4] = row
    two = p[:-1] << 1 | p[1:]
    return two[:-2] << 2 | two[2:]


def surroundings(up1: np.ndarray | None, up2: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the part of its context in the two rows above, and of how many pixels from there on that part is white."""
    one, two = _fours(up1, width), _fours(up2, width)
    if one is None and two is None:
        return np.zeros(width, np.uint16), np.arange(width, 0, -1)
    above = np.zeros(width, np.uint16)
    # neighbouring fours share pixels, which are equal
    if one is not None:
        above |= (one[1 : width + 1] << 3 | one[4 : width + 4]) << 4
    if two is not None:
        above |= (two[2 : width + 2] << 1 | two[3 : width + 3]) << 11
    until = np.append(np.flatnonzero(above), width)
    return above, np.repeat(until, np.diff(until, prepend=-1))[:width] - np.arange(width)


def contexts(rows: np.ndarray) -> np.ndarray:
    """The 16 pixels before each one: 5 two rows up, 7 one row up, 4 to the left; white outside."""
    h, w = rows.shape
    p = np.zeros((h + 2, w + 8), np.uint16)
    p[2:, 4 : w + 4] = rows
    two = p[:, :-1] << 1 | p[:, 1:]
    four = two[:, :-2] << 2 | two[:, 2:]
    above = (four[:-2, 2 : w + 2] << 1 | four[:-2, 3 : w + 3]) << 11 | (four[1:-1, 1 : w + 1] << 3 | four[1:-1, 4 : w + 4]) << 4
    return above | four[2:, :w]


def id_bits(symbols: int) -> int:
    """Bits of the ids of so many symbols."""
    return max(symbols - 1, 0).bit_length()


def encode_dictionary(symbols: list[np.ndarray]) -> bytes:
    """New symbols, ordered by height and then width: height classes, width differences, bitmaps; all are exported."""
    if not symbols:
        raise ValueError("a dictionary without symbols")
    e, height, at = Encoder(), 0, 0
    while at < len(symbols):
        now, width = symbols[at].shape[0], 0
        e.integer("IADH", now - height)
        height = now
        while at < len(symbols) and symbols[at].shape[0] == height:
            e.integer("IADW", symbols[at].shape[1] - width)
            width = symbols[at].shape[1]
            e.bitmap(symbols[at])
            at += 1
        e.integer("IADW", None)
    e.integer("IAEX", 0)
    e.integer("IAEX", len(symbols))
    return e.finish()


def decode_dictionary(data: bytes, new: int) -> list[np.ndarray]:
    d, out, height = Decoder(data), [], 0
    while len(out) < new:
        height, width = height + d.integer("IADH"), 0
        while (step := d.integer("IADW")) is not None:
            width += step
            out.append(d.bitmap(width, height))
    if (d.integer("IAEX"), d.integer("IAEX")) != (0, new):
        raise ValueError("some symbols aren't exported")
    return out


def encode_text(instances: list[tuple[int, int, int]], symbols: list[np.ndarray]) -> bytes:
    """Instances (y, x, id) in that order, corners at the top left: strips of one row each, S relative to the end of the instance before."""
    e, bits, strip, first, at = Encoder(), id_bits(len(symbols)), 0, 0, 0
    e.integer("IADT", 0)
    while at < len(instances):
        y, x, _ = instances[at]
        e.integer("IADT", y - strip)
        e.integer("IAFS", x - first)
        strip, first, s, begun = y, x, x, True
        while at < len(instances) and instances[at][0] == y:
            _, x, i = instances[at]
            if not begun:
                e.integer("IADS", x - s)
            e.identity(i, bits)
            s, begun, at = x + symbols[i].shape[1] - 1, False, at + 1
        e.integer("IADS", None)
    return e.finish()


def text_decisions(instances: list[tuple[int, int, int]], symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bit, 1) of each decision of :func:`encode_text`, with contexts as ``NAMES`` and ``IDS`` have them."""
    bits, strip, first, at = id_bits(len(symbols)), 0, 0, 0
    out = [_decided(NAMES["IADT"], 0)]
    while at < len(instances):
        y, x, _ = instances[at]
        out += [_decided(NAMES["IADT"], y - strip), _decided(NAMES["IAFS"], x - first)]
        strip, first, s, begun = y, x, x, True
        while at < len(instances) and instances[at][0] == y:
            _, x, i = instances[at]
            if not begun:
                out.append(_decided(NAMES["IADS"], x - s))
            out.append(_identified(i, bits))
            s, begun, at = x + symbols[i].shape[1] - 1, False, at + 1
        out.append(_decided(NAMES["IADS"], None))
    every = np.concatenate(out)
    return every >> 1, (every & 1).astype(np.uint8), np.ones(len(every), np.int64)


def decode_text(data: bytes, count: int, symbols: list[np.ndarray]) -> list[tuple[int, int, int]]:
    d, bits, out, first = Decoder(data), id_bits(len(symbols)), [], 0
    strip = -d.integer("IADT")
    while len(out) < count:
        strip += d.integer("IADT")
        first += d.integer("IAFS")
        s = first
        while True:
            i = d.identity(bits)
            out.append((strip, s, i))
            s += symbols[i].shape[1] - 1
            step = d.integer("IADS")
            if step is None:
                break
            s += step
    return out


def draw(width: int, height: int, instances: list[tuple[int, int, int]], symbols: list[np.ndarray]) -> np.ndarray:
    """The page with all instances on it; what leaves it is cut off."""
    page = np.zeros((height, width), bool)
    for y, x, i in instances:
        part = page[y : y + symbols[i].shape[0], x : x + symbols[i].shape[1]]
        part |= symbols[i][: part.shape[0], : part.shape[1]]
    return page


def dots(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the black pixels of all symbols, one after the other, and how many each has."""
    y, x = zip(*map(np.nonzero, symbols))
    return np.concatenate(y), np.concatenate(x), np.array([len(v) for v in y], np.int64)


def drawn(width: int, height: int, y: np.ndarray, x: np.ndarray, i: np.ndarray, symbols: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """:func:`draw` of instances as arrays, with the :func:`dots` of dictionaries."""
    page = np.zeros((height, width), bool)
    if len(i):
        dy, dx, n = (np.concatenate([s[k] for s in symbols]) for k in range(3))
        start, size = np.cumsum(n) - n, n[i]
        at = np.repeat(start[i] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        rows, columns = np.repeat(y, size) + dy[at], np.repeat(x, size) + dx[at]
        inside = (rows < height) & (columns < width)
        page[rows[inside], columns[inside]] = True
    return page


def encode_bitmap(rows: np.ndarray) -> bytes:
    e = Encoder()
    e.bitmap(rows)
    return e.finish()
