"""The MQ coder over many streams at once: one numpy step takes a decision of every stream, so that a decision costs no interpreter loop.

Bytes and pixels are those of :mod:`coding`. Long runs of white pixels in white surroundings are taken in one step between renormalisations.
Streams take the place of finished ones; what is left of the last few goes through the scalar coder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from inkframe.operators import coding

#: Streams coded at once, and how few of them are left to the scalar coder.
SLOTS, FEW = 1024, 24
#: Bytes of adaptive states held at once.
STATE_BYTES = 64 << 20
#: Width beyond which pages are decoded apart, and pixels of all rows under way.
WIDE, ROOM = 1 << 12, 1 << 22
#: Pixels whose contexts are found at once.
STRIPE = 1 << 20

_QE, _MORE, _LESS = np.array(coding.QE, np.int64), np.array(coding.MORE, np.uint8), np.array(coding.LESS, np.uint8)
#: Shifts that bring an interval back to 0x8000.
_SHIFTS = np.array([16, *(16 - int(a).bit_length() for a in range(1, 1 << 16))], np.int64)


def collapsed(context: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bit, run) with neighbouring decisions for 0 in context 0 as one."""
    white = (context == 0) & (bit == 0)
    white[1:] &= white[:-1].copy()
    white[:1] = False
    at = np.flatnonzero(~white)
    return context[at], bit[at], np.diff(np.append(at, len(context)))


def bitmap_decisions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of a generic region, stripe by stripe."""
    h, w = rows.shape
    step = max(1, STRIPE // max(w, 1))
    if step >= h:
        return collapsed(coding.contexts(rows).ravel(), rows.ravel().astype(np.uint8))
    parts = [collapsed(coding.contexts(rows[max(y - 2, 0) : y + step])[min(y, 2) :].ravel(), rows[y : y + step].ravel().astype(np.uint8)) for y in range(0, h, step)]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _slots(streams: int, contexts: int) -> int:
    return max(1, min(streams, SLOTS, STATE_BYTES // contexts))


def encode(streams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], contexts: int, slots: int | None = None) -> list[bytes]:
    """The bytes of each stream of decisions (context below ``contexts``, bit, how often)."""
    if not streams:
        return []
    size = np.array([len(s[0]) for s in streams])
    order = np.argsort(-size, kind="stable").tolist()
    ctx, bit = (np.concatenate([s[i] for s in streams]) for i in (0, 1))
    run = np.append(np.concatenate([s[2] for s in streams]), 0)
    first = np.cumsum(size) - size
    many = np.array([int(s[2].sum()) for s in streams])
    # a decision shifts by 15 bits at most
    room = 2 * many + 16
    start = np.cumsum(room) - room
    out = np.empty(int(room.sum()), np.uint8)
    out[start] = 0
    slots = _slots(len(streams), contexts) if slots is None else min(slots, len(streams))
    states = np.zeros(slots * contexts, np.uint8)
    done: list[bytes | None] = [None] * len(streams)

    def closed(i: int, a: int, c: int, ct: int, last: int) -> None:
        e = coding.Encoder()
        e.a, e.c, e.ct, e.out = a, c, ct, bytearray(out[start[i] : last + 1].tobytes())
        done[i] = e.finish()

    for i in [i for i in order if not size[i]]:
        closed(i, 0x8000, 0, 12, start[i])
    queue = [i for i in reversed(order) if size[i]]
    who = np.array([queue.pop() for _ in range(min(slots, len(queue)))], np.int64)
    base = np.arange(len(who)) * contexts
    pos, end, last = first[who], first[who] + size[who], start[who].copy()
    left = run[pos]
    a, c, ct = np.full(len(who), 0x8000, np.int64), np.zeros(len(who), np.int64), np.full(len(who), 12, np.int64)
    while len(who) and (queue or len(who) > FEW):
        b, at = bit[pos], base + ctx[pos]
        s = states[at]
        q = _QE[s]
        long = np.flatnonzero(left > 1)
        if len(long):
            more = np.minimum((a[long] - 0x8000) // q[long], left[long] - 1) * (1 - (s[long] & 1))
            a[long] -= q[long] * more
            c[long] += q[long] * more
            left[long] -= more
        a -= q
        likely = (s & 1) == b
        lower = (a < q) == likely
        c += np.where(lower, 0, q)
        a = np.where(lower, q, a)
        r = np.flatnonzero(~likely | (a < 0x8000))
        if len(r):
            states[at[r]] = np.where(likely[r], _MORE[s[r]], _LESS[s[r]])
            n = _SHIFTS[a[r]]
            a[r] <<= n
            while len(r):
                k = np.minimum(n, ct[r])
                c[r] <<= k
                ct[r] -= k
                n -= k
                f = r[ct[r] == 0]
                if len(f):
                    before, high = out[last[f]], c[f]
                    carry = (before != 0xFF) & (high >= 0x8000000)
                    before = before + carry.astype(np.uint8)
                    out[last[f]] = before
                    high = np.where(carry, high & 0x7FFFFFF, high)
                    wide = np.where(before == 0xFF, 20, 19)
                    last[f] += 1
                    out[last[f]] = high >> wide
                    c[f] = high & ((1 << wide) - 1)
                    ct[f] = 27 - wide
                some = n > 0
                r, n = r[some], n[some]
        left -= 1
        pos += left == 0
        left = np.where(left == 0, run[pos], left)
        over = np.flatnonzero(pos == end)
        if len(over):
            gone = []
            for j in over.tolist():
                closed(int(who[j]), int(a[j]), int(c[j]), int(ct[j]), int(last[j]))
                if queue:
                    i = queue.pop()
                    who[j], pos[j], end[j], last[j], left[j] = i, first[i], first[i] + size[i], start[i], run[first[i]]
                    a[j], c[j], ct[j] = 0x8000, 0, 12
                    states[base[j] : base[j] + contexts] = 0
                else:
                    gone.append(j)
            if gone:
                keep = np.ones(len(who), bool)
                keep[gone] = False
                who, base, pos, end, last, left, a, c, ct = (v[keep] for v in (who, base, pos, end, last, left, a, c, ct))
    for j, i in enumerate(who.tolist()):
        e = coding.Encoder()
        e.a, e.c, e.ct, e.out = int(a[j]), int(c[j]), int(ct[j]), bytearray(out[start[i] : last[j] + 1].tobytes())
        held = states[base[j] : base[j] + contexts]
        e.states.update((k, int(held[k])) for k in np.flatnonzero(held).tolist())
        rest = slice(int(pos[j]), int(end[j]))
        for x, b, n in zip(ctx[rest].tolist(), bit[rest].tolist(), [int(left[j]), *run[int(pos[j]) + 1 : int(end[j])].tolist()]):
            e.bit(x, b) if n == 1 else e.repeated(x, b, n)
        done[i] = e.finish()
    return done


class Reader:
    """The registers of many decoders: slot i decodes data[at[i]:], which 0xFF follows twice."""

    def __init__(self, streams: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(s + b"\xff\xff\xff" for s in streams), np.uint8)
        size = np.array([len(s) + 3 for s in streams])
        self.first = np.cumsum(size) - size

    def begin(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, c, ct, at) at the beginning of streams."""
        at = self.first[which]
        c, ct = self.data[at].astype(np.int64) << 16, np.zeros(len(at), np.int64)
        at, c, ct = self.byte(at, c, ct)
        return np.full(len(at), 0x8000, np.int64), c << 7, ct - 7, at

    def byte(self, at: np.ndarray, c: np.ndarray, ct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stuffed = self.data[at] == 0xFF
        following = self.data[at + 1].astype(np.int64)
        marker = stuffed & (following > 0x8F)
        c = c + np.where(marker, 0xFF00, np.where(stuffed, following << 9, following << 8))
        return at + ~marker, c, np.where(stuffed & ~marker, 7, 8)

    def renormalised(self, r: np.ndarray, a: np.ndarray, c: np.ndarray, ct: np.ndarray, at: np.ndarray) -> None:
        n = _SHIFTS[a[r]]
        a[r] <<= n
        while len(r):
            f = r[ct[r] == 0]
            if len(f):
                at[f], c[f], ct[f] = self.byte(at[f], c[f], ct[f])
            k = np.minimum(n, ct[r])
            c[r] <<= k
            ct[r] -= k
            n = n - k
            some = n > 0
            r, n = r[some], n[some]


def scalar(data: bytes, a: int, c: int, ct: int, at: int, states: np.ndarray) -> coding.Decoder:
    """A decoder that goes on where a slot is."""
    d = coding.Decoder(data)
    d.a, d.c, d.ct, d.at = a, c, ct, at
    d.states.update((k, int(states[k])) for k in np.flatnonzero(states).tolist())
    return d


def decode_bitmaps(streams: list[tuple[int, int, bytes]], each: Callable[[int, np.ndarray], None], slots: int | None = None) -> None:
    """Calls ``each`` with the place and the rows of every generic region (width, height, data), in the order in which they are done; none may be without a pixel."""
    far = [i for i, s in enumerate(streams) if s[0] > WIDE]
    if far and len(far) < len(streams):
        # a slot has room for the widest row, so wide pages don't go with narrow ones
        for some in (far, [i for i, s in enumerate(streams) if s[0] <= WIDE]):
            decode_bitmaps([streams[i] for i in some], lambda k, rows, some=some: each(some[k], rows), slots)
        return
    if slots is None:
        slots = min(_slots(len(streams), 1 << 16), ROOM // max([1, *(s[0] for s in streams)]))
    if min(slots, len(streams)) <= FEW:
        for i, (w, h, data) in enumerate(streams):
            each(i, coding.Decoder(data).bitmap(w, h))
        return
    contexts = 1 << 16
    reader = Reader([s[2] for s in streams])
    wide = np.array([s[0] for s in streams])
    queue = np.argsort(np.array([s[0] * s[1] for s in streams]), kind="stable").tolist()
    slots = min(slots, len(streams))
    states = np.zeros(slots * contexts, np.uint8)
    who = np.array([queue.pop() for _ in range(slots)], np.int64)
    # of each slot's row: the part of the contexts that is above, and how many contexts from here on are white
    room = int(wide.max())
    above, white, row = (np.zeros(slots * room, kind) for kind in (np.uint16, np.int32, np.uint8))
    held: list = [None] * slots

    def begin(j: int, i: int) -> None:
        w, h, _ = streams[i]
        # rows done, and all rows
        held[j] = [0, np.zeros((h, w), bool)]
        above[j * room : j * room + w] = 0
        white[j * room : j * room + w] = np.arange(w, 0, -1)
        row[j * room : j * room + w] = 0

    def turn(j: int) -> bool:
        """Keeps the row of a slot and prepares the next; whether there is one."""
        y, rows = held[j]
        h, w = rows.shape
        own = slice(j * room, j * room + w)
        rows[y] = row[own]
        if y + 1 == h:
            return False
        above[own], white[own] = coding.surroundings(rows[y], rows[y - 1] if y else None, w)
        row[own] = 0
        held[j][0] = y + 1
        return True

    for j, i in enumerate(who.tolist()):
        begin(j, i)
    slot = np.arange(slots)
    base, pos = slot * contexts, slot * room
    stop = pos + wide[who]
    a, c, ct, at = reader.begin(who)
    own = np.zeros(slots, np.int64)
    while len(who) and (queue or len(who) > FEW):
        context = above[pos] | own
        spot = base + context
        s = states[spot]
        q = _QE[s]
        calm = np.flatnonzero((context == 0) & (white[pos] > 1) & ((s & 1) == 0))
        if len(calm):
            z, high = q[calm], c[calm] >> 16
            more = np.minimum(np.minimum((a[calm] - 0x8000) // z, high // z), white[pos[calm]] - 1)
            a[calm] -= z * more
            c[calm] -= z * more << 16
            pos[calm] += more
        a -= q
        lower = (c >> 16) < q
        likely = (a < q) == lower
        c -= np.where(lower, 0, q << 16)
        a = np.where(lower, q, a)
        bits = (s & 1) ^ ~likely
        r = np.flatnonzero(lower | (a < 0x8000))
        if len(r):
            states[spot[r]] = np.where(likely[r], _MORE[s[r]], _LESS[s[r]])
            reader.renormalised(r, a, c, ct, at)
        row[pos] = bits
        own = (own << 1 | bits) & 15
        pos += 1
        over = np.flatnonzero(pos == stop)
        if len(over):
            gone = []
            own[over] = 0
            for j in over.tolist():
                m = int(slot[j])
                pos[j] = m * room
                if turn(m):
                    continue
                each(int(who[j]), held[m][1])
                held[m] = None
                if queue:
                    i = queue.pop()
                    begin(m, i)
                    who[j], stop[j] = i, m * room + wide[i]
                    a[j : j + 1], c[j : j + 1], ct[j : j + 1], at[j : j + 1] = reader.begin(np.array([i]))
                    states[base[j] : base[j] + contexts] = 0
                else:
                    gone.append(j)
            if gone:
                keep = np.ones(len(who), bool)
                keep[gone] = False
                who, slot, base, pos, stop, a, c, ct, at, own = (v[keep] for v in (who, slot, base, pos, stop, a, c, ct, at, own))
    for j, i in enumerate(who.tolist()):
        m = int(slot[j])
        y, rows = held[m]
        d = scalar(streams[i][2], int(a[j]), int(c[j]), int(ct[j]), int(at[j] - reader.first[i]), states[base[j] : base[j] + contexts])
        x = int(pos[j]) - m * room
        rows[y, :x] = row[m * room : m * room + x]
        each(i, d.rest(rows, y, x))


# an integer is read in phases: sign, up to five bits of prefix, value
_VALUE = 6
_LOW, _BITS = (np.array([r[i] for r in coding.INTEGERS], np.int64) for i in (0, 2))


def decode_texts(streams: list[tuple[bytes, int, np.ndarray]], slots: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, x, id) of the instances of every text region (data, number of instances, widths of its symbols), as :func:`coding.decode_text` gives them."""
    out: list = [None] * len(streams)

    def scalar_text(i: int) -> None:
        data, count, width = streams[i]
        found = coding.decode_text(data, count, [np.zeros((1, w), bool) for w in width.tolist()])
        out[i] = tuple(np.array(found, np.int64).reshape(-1, 3).T)

    bits = np.array([coding.id_bits(len(s[2])) for s in streams], np.int64)
    many = [i for i, s in enumerate(streams) if s[1] and bits[i]]
    contexts = coding.IDS + (1 << int(max((bits[i] for i in many), default=0)))
    slots = min(len(many), slots or max(1, min(SLOTS, STATE_BYTES // contexts)))
    if slots <= FEW:
        for i in range(len(streams)):
            scalar_text(i)
        return out
    for i in set(range(len(streams))) - set(many):
        scalar_text(i)
    reader = Reader([s[0] for s in streams])
    count = np.array([s[1] for s in streams], np.int64)
    start = np.cumsum(count) - count
    found = np.zeros((3, int(count.sum())), np.int64)
    width = np.concatenate([s[2] for s in streams])
    width_at = np.cumsum([len(s[2]) for s in streams]) - np.array([len(s[2]) for s in streams])
    queue = sorted(many, key=lambda i: count[i])
    who = np.array([queue.pop() for _ in range(slots)], np.int64)
    base = np.arange(slots) * contexts
    states = np.zeros(slots * contexts, np.uint8)
    a, c, ct, at = reader.begin(who)
    zero = lambda: np.zeros(slots, np.int64)
    # what is read: 0 the first strip, 1 a strip, 2 the first S of one, 3 an id, 4 a difference of S
    what, first_context, phase, sign, value, need, low = (zero() for _ in range(7))
    before, strip, first, s, done = np.ones(slots, np.int64), zero(), zero(), zero(), start[who].copy()
    opens = np.array([coding.NAMES["IADT"], coding.NAMES["IADT"], coding.NAMES["IAFS"], coding.IDS, coding.NAMES["IADS"]], np.int64)
    while len(who) and (queue or len(who) > FEW):
        spot = base + first_context + before
        state = states[spot]
        q = _QE[state]
        a -= q
        lower = (c >> 16) < q
        likely = (a < q) == lower
        c -= np.where(lower, 0, q << 16)
        a = np.where(lower, q, a)
        b = ((state & 1) ^ ~likely).astype(np.int64)
        r = np.flatnonzero(lower | (a < 0x8000))
        if len(r):
            states[spot[r]] = np.where(likely[r], _MORE[state[r]], _LESS[state[r]])
            reader.renormalised(r, a, c, ct, at)
        grown = before << 1 | b
        before = np.where((what == 3) | (before < 256), grown, grown & 511 | 256)
        reading = phase == _VALUE
        value = np.where(reading, value << 1 | b, value)
        need -= reading
        sign = np.where(phase == 0, b, sign)
        ends = (phase > 0) & ~reading & ((b == 0) | (phase == 5))
        phase += ~reading
        e = np.flatnonzero(ends)
        if len(e):
            kind = phase[e] - 2 + b[e]
            need[e], low[e], value[e], phase[e] = _BITS[kind], _LOW[kind], 0, _VALUE
        full = np.flatnonzero((phase == _VALUE) & (need == 0))
        if not len(full):
            continue
        size, w = low[full] + value[full], what[full]
        number = np.where(sign[full] == 1, -size, size)
        band = (w == 4) & (sign[full] == 1) & (size == 0)
        last = band & (done[full] == start[who[full]] + count[who[full]])
        k = full[w == 0]
        strip[k] = -number[w == 0]
        k = full[w == 1]
        strip[k] += number[w == 1]
        k = full[w == 2]
        first[k] += number[w == 2]
        s[k] = first[k]
        k, i = full[w == 3], number[w == 3]
        found[0, done[k]], found[1, done[k]], found[2, done[k]] = strip[k], s[k], i
        s[k] += width[width_at[who[k]] + i] - 1
        done[k] += 1
        along = (w == 4) & ~band
        s[full[along]] += number[along]
        w = np.where(band, 1, np.where(along, 3, w + 1))
        what[full], first_context[full], before[full], sign[full], value[full] = w, opens[w], 1, 0, 0
        named = w == 3
        phase[full], need[full], low[full] = np.where(named, _VALUE, 0), np.where(named, bits[who[full]], 0), 0
        if last.any():
            gone = []
            for j in full[last].tolist():
                i = int(who[j])
                out[i] = tuple(found[:, start[i] : start[i] + count[i]])
                if queue:
                    i = queue.pop()
                    who[j] = i
                    a[j : j + 1], c[j : j + 1], ct[j : j + 1], at[j : j + 1] = reader.begin(np.array([i]))
                    states[base[j] : base[j] + contexts] = 0
                    for v in (what, first_context, phase, sign, value, need, low, strip, first, s):
                        v[j] = 0
                    before[j], done[j] = 1, start[i]
                else:
                    gone.append(j)
            if gone:
                keep = np.ones(len(who), bool)
                keep[gone] = False
                who, base, a, c, ct, at, what, first_context, phase, sign, value, need, low, before, strip, first, s, done = (v[keep] for v in (who, base, a, c, ct, at, what, first_context, phase, sign, value, need, low, before, strip, first, s, done))
    # the last few again from their beginning
    for i in who.tolist():
        scalar_text(i)
    return out
