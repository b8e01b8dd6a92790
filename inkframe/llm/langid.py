"""Language identification (operator 6) by interpolated Kneser-Ney character models.

Texts are lower-cased; a run of anything but letters is one boundary symbol. Counts of all 4-grams of symbols are
gathered from every training text, per language, and held as they are: arrays sorted by 4-gram, with one row of
log-probabilities over the languages each; lower orders use continuation counts. A hash of ``SLOT_BITS`` bits only says
where to look first.

All that a 4-gram's probability takes, but the 1-grams, has its last symbol but one. A model of more than ``CELLS``
log-probabilities is cut into parts by that symbol; the driver holds one part at a time, and texts are scored part by part.

The language of a text is the one with the least cross-entropy per symbol. ``rejected`` marks texts whose cross-entropy
is above what the language's own training text shows: its mean, plus ``Z`` standard errors for the text's length,
plus ``MARGIN`` nats.

Null texts and texts without a letter are ``und`` with score 0; without any training text every text is. Of languages with
the same cross-entropy the first by name is taken. Equal rows are each scored for themselves, also where keys are equal or
null; an empty table gives no rows; very long texts are a step of their own. Columns other than key, text and label aren't
read, so none can clash.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import kernels as K
from inkframe.llm.common import Scratch

ORDER = 4
SYMBOL_BITS = 12
SLOT_BITS = 20
#: Log-probabilities of a part of the model, if its 4-grams don't all have one last symbol but one.
CELLS = 16 << 20
#: Labels that one partition numbers before it writes out its counts.
_LABELS = 50_000
#: Integer units of one nat, so that sums don't depend on their order.
UNIT = 1 << 14
Z, MARGIN = 4.0, 0.25
#: Characters of one vectorised step.
_STEP = 256 << 10
_MASK = (1 << SYMBOL_BITS) - 1
#: Code points below have a symbol of their own.
_OWN = 0x250
_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what isn't a letter; rarer letters share symbols by a hash."""
    if not _symbols:
        letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
        code = np.arange(0x110000, dtype=np.uint64)
        shared = _OWN + K.mix(code + np.uint64(99)) % np.uint64((1 << SYMBOL_BITS) - _OWN)
        _symbols.append(np.where(letter, np.where(code < _OWN, code, shared), 0).astype(np.uint64))
    return _symbols[0]


def keys_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram ending at each symbol, symbols by text, whether a text has a letter)."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low])
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "replace"), "<u4")
    sym = symbol_table()[code]
    ends = np.cumsum(sizes)
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    keep[ends[:-1]] |= sym[ends[:-1]] != 0
    keep[0] = sym[0] != 0
    counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])])
    letters = np.diff(np.concatenate([[0], np.cumsum(sym != 0)])[np.concatenate([[0], ends])])
    sym = sym[keep]
    at, key = K.within(counts), sym.copy()
    for j in range(1, ORDER):
        key[j:] |= np.where(at[j:] >= j, sym[:-j] << np.uint64(SYMBOL_BITS * j), np.uint64(0))
    return key, counts, letters > 0


def slot_of(key: np.ndarray) -> np.ndarray:
    return (K.mix(key) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _text_steps(batches):
    for batch, _, _ in K.steps(batches, "text", _STEP):
        yield batch, batch.column("text").to_pylist()


def _tally(batches):
    """(lang, gram, n) of a partition; what is held is written out and begun anew when it grows large."""
    names: dict[str, int] = {}
    held, waiting = [], 0

    def summed():
        both = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        order = np.argsort(both[0], kind="stable")
        key, n = both[0][order], both[1][order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[start], np.add.reduceat(n, start)

    def out(key, n):
        langs = np.array(list(names), dtype=object)
        lang = (key >> np.uint64(ORDER * SYMBOL_BITS)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs[lang], pa.string()), pa.array((key & np.uint64((1 << ORDER * SYMBOL_BITS) - 1)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch, texts in _text_steps(batches):
        key, counts, _ = keys_of(texts)
        lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], dtype=np.uint64)
        key = np.sort(key | np.repeat(lang, counts) << np.uint64(ORDER * SYMBOL_BITS))
        if not len(key):
            continue
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        held.append((key[start], np.diff(np.append(start, len(key)))))
        waiting += len(start)
        if waiting > 3_000_000:
            held = [summed()]
            if len(held[0][0]) > 1_000_000:
                yield out(*held.pop())
            waiting = sum(len(k) for k, _ in held)
        if len(names) > _LABELS:
            yield out(*summed())
            held, waiting = [], 0
            names.clear()
    if held:
        yield out(*summed())


def middle_of(key: np.ndarray) -> np.ndarray:
    """The last symbol but one of each 4-gram."""
    return (key >> np.uint64(SYMBOL_BITS) & np.uint64(_MASK)).astype(np.int64)


def _orders(key: np.ndarray, n: np.ndarray):
    """(order, n-grams, counts) from 4-grams to 2-grams: below the highest order, in how many n-grams of the one above it is the end."""
    for order in range(ORDER, 1, -1):
        if order < ORDER:
            key, n = np.unique(key & np.uint64((1 << SYMBOL_BITS * order) - 1), return_counts=True)
        yield order, key, n


class Totals:
    """What a language's parts have in common: counts of its 1-grams, and how many n-grams of each order occur once and twice."""

    def __init__(self) -> None:
        self.few, self.single = np.zeros((ORDER + 1, 2), np.int64), np.zeros(1 << SYMBOL_BITS, np.int64)

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        for order, k, c in _orders(key, n):
            self.few[order] += (c == 1).sum(), (c == 2).sum()
        self.single += np.bincount((k & np.uint64(_MASK)).astype(np.int64), minlength=1 << SYMBOL_BITS)

    def discount(self, order: int) -> float:
        ones, twos = self.few[order] if order > 1 else ((self.single == 1).sum(), (self.single == 2).sum())
        return ones / (ones + 2 * twos) if ones and twos else 0.75


def _found(have: np.ndarray, wanted: np.ndarray, value: np.ndarray, other: float) -> np.ndarray:
    if not len(have):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return np.where(have[at] == wanted, value[at], other)


class Part:
    """The 4-grams whose last symbol but one is in [low, high): ``keys`` ascending, ``logp[i]`` the languages' log-probabilities of entry i, in units."""

    def __init__(self, low: int, high: int, grams: list[tuple[np.ndarray, np.ndarray]], totals: list[Totals]) -> None:
        """grams: per language the distinct 4-grams and their counts."""
        self.low, self.high = low, high
        self.orders = [self._shares(k, n, t) for (k, n), t in zip(grams, totals)]
        self.keys = np.unique(np.concatenate([k for k, _ in grams])) if grams else np.zeros(0, np.uint64)
        self.logp = self._units(self.keys)

    @staticmethod
    def _shares(key: np.ndarray, n: np.ndarray, totals: Totals) -> list[dict]:
        """From 1-grams to 4-grams: sorted n-grams with the discounted share of their context, sorted contexts with what they leave to the order below."""
        out, single = [], np.flatnonzero(totals.single)
        for order, key, n in [*_orders(key, n), (1, single.astype(np.uint64), totals.single[single])]:
            d = totals.discount(order)
            context, where, kinds = np.unique(key >> np.uint64(SYMBOL_BITS), return_inverse=True, return_counts=True)
            total = np.bincount(where, weights=n, minlength=len(context))
            out.append({"key": key, "own": np.maximum(n - d, 0) / total[where], "context": context, "rest": np.minimum(d, 1) * kinds / total})
        return out[::-1]

    def log(self, key: np.ndarray, lang: int) -> np.ndarray:
        p = np.full(len(key), 1 / (1 << SYMBOL_BITS))
        for i, o in enumerate(self.orders[lang]):
            part = key & np.uint64((1 << SYMBOL_BITS * (i + 1)) - 1)
            p = _found(o["key"], part, o["own"], 0.0) + _found(o["context"], part >> np.uint64(SYMBOL_BITS), o["rest"], 1.0) * p
        return np.log(p)

    def _units(self, key: np.ndarray) -> np.ndarray:
        rows = [self.log(key, i) for i in range(len(self.orders))]
        return np.rint(np.stack(rows, 1) * UNIT).astype(np.int32) if rows else np.zeros((len(key), 0), np.int32)

    def totals(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihood by language of this part's 4-grams in each text, in units; all symbols; whether there is a letter)."""
        if not hasattr(self, "index"):
            self.index = np.full(1 << SLOT_BITS, -1, np.int64)
            self.index[slot_of(self.keys)] = np.arange(len(self.keys))
        key, counts, letters = keys_of(texts)
        total = np.zeros((len(texts), len(self.orders)), np.int64)
        mine = middle_of(key)
        mine = (mine >= self.low) & (mine < self.high)
        key, own = key[mine], np.bincount(np.repeat(np.arange(len(texts)), counts)[mine], minlength=len(texts))
        if len(self.keys) and len(key):
            row = self.index[slot_of(key)]
            # another 4-gram, or none, is the first under this hash
            other = np.flatnonzero((row < 0) | (self.keys[row] != key))
            row[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
            value = self.logp[row]
            new = other[self.keys[row[other]] != key[other]]
        else:
            value, new = np.zeros((len(key), len(self.orders)), np.int32), np.arange(len(key))
        if len(new):
            value[new] = self._units(key[new])
        some = np.flatnonzero(own)
        if len(some):
            total[some] = np.add.reduceat(value, (np.cumsum(own) - own)[some], axis=0, dtype=np.int64)
        return total, counts, letters


class Model:
    """Languages, with mean and deviation of their training symbols' information, and the parts as broadcasts."""

    def __init__(self, langs: list[str], parts: list, mean: np.ndarray, sd: np.ndarray) -> None:
        self.langs, self.parts, self.mean, self.sd = langs, parts, mean, sd


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model of every row whose label isn't null."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    grams = rows.mapInArrow(_tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    middle = F.shiftright("gram", SYMBOL_BITS).bitwiseAND(F.lit(_MASK))
    grams = Scratch(spark, "grams").store(grams.withColumn("middle", middle.cast("int")), "grams")
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    # at most 2**SYMBOL_BITS rows
    sizes = sorted(map(tuple, grams.groupBy("middle").agg(F.countDistinct("gram")).collect()))
    cuts, held = [0], 0
    for m, n in sizes:
        if held and (held + n) * len(langs) > CELLS:
            cuts.append(m)
            held = 0
        held += n
    cuts.append(1 << SYMBOL_BITS)
    spans = list(zip(cuts, cuts[1:]))

    def read(low, high):
        table = (grams if len(spans) == 1 else grams.where((F.col("middle") >= low) & (F.col("middle") < high))).select("lang", "gram", "n").toArrow()
        name = table["lang"].combine_chunks().dictionary_encode()
        name = name.combine_chunks() if isinstance(name, pa.ChunkedArray) else name
        code = np.searchsorted(langs, name.dictionary.to_pylist()) if len(name) else np.zeros(0, np.int64)
        lang, gram, n = code[name.indices.to_numpy()], table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy()
        order = np.lexsort((gram, lang))
        cut = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        return [(gram[order][a:b], n[order][a:b]) for a, b in zip(cut, cut[1:])]

    totals, last = [Totals() for _ in langs], None
    for span in spans:
        last = read(*span)
        for t, (k, n) in zip(totals, last):
            t.add(k, n)
    parts, sums = [], np.zeros((len(langs), 3))
    for span in spans:
        last = last if len(spans) == 1 else read(*span)
        part = Part(*span, last, totals)
        for i, (k, n) in enumerate(last):
            h = -part.log(k, i)
            sums[i] += n.sum(), (n * h).sum(), (n * h * h).sum()
        parts.append(spark.sparkContext.broadcast(part))
    mean = sums[:, 1] / sums[:, 0]
    return Model(langs, parts, mean, np.sqrt(np.maximum(sums[:, 2] / sums[:, 0] - mean**2, 0)))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, cross_entropy, rejected) of every text; score is the posterior with equal priors."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    langs, mean, sd = model.langs, model.mean, model.sd

    def judged(keys, total, counts, letters):
        n = len(counts)
        if langs:
            best = total.argmax(1)
            gap = (total - total.max(1, keepdims=True)) / UNIT
            score = np.where(letters, 1 / np.exp(gap).sum(1), 0.0)
            entropy = -total[np.arange(n), best] / np.maximum(counts, 1) / UNIT
            rejected = ~letters | (entropy > mean[best] + Z * sd[best] / np.sqrt(np.maximum(counts, 1)) + MARGIN)
            names = [langs[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist())]
        else:
            score, entropy, rejected, names = np.zeros(n), np.zeros(n), np.ones(n, bool), ["und"] * n
        return pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), *map(pa.array, (score, entropy, rejected))], names=["key", "lang_pred", "score", "cross_entropy", "rejected"])

    def whole(batches):
        for batch, texts in _text_steps(batches):
            yield judged(batch.column("key"), *model_part.value.totals(texts))

    def scored(part):
        def run(batches):
            for batch, texts in _text_steps(batches):
                total, counts, letters = part.value.totals(texts)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(list(total), pa.list_(pa.int64())), pa.array(counts), pa.array(letters)], names=["row", "key", "total", "symbols", "letters"])

        return run

    def added(batches):
        for batch in batches:
            if batch.num_rows:
                total = np.array([np.sum(x, axis=0) for x in batch.column("totals").to_pylist()], np.int64)
                yield judged(batch.column("key"), total, batch.column("symbols").to_numpy(), batch.column("letters").to_numpy(zero_copy_only=False))

    result = f"key {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    if len(model.parts) == 1:
        model_part = model.parts[0]
        return docs.mapInArrow(whole, result).withColumnRenamed("key", key)
    rows = Scratch(docs.sparkSession, "texts").store(docs.withColumn("row", F.monotonically_increasing_id()), "texts")
    out = None
    for part in model.parts:
        now = rows.mapInArrow(scored(part), f"row long, key {kind}, total array<long>, symbols long, letters boolean")
        out = now if out is None else out.union(now)
    out = out.groupBy("row").agg(F.first("key").alias("key"), F.collect_list("total").alias("totals"), F.first("symbols").alias("symbols"), F.first("letters").alias("letters"))
    return out.drop("row").mapInArrow(added, result).withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    """True where crc32 of the key as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
