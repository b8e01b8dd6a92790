"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from inkframe.llm import bpe, common, decontaminate, jaccard, langid, licenses, quality, queries, suffix_dedup, token_counts, url_filter, wavelet
from inkframe.llm import kernels as K

SF = "/root/testdata/sf0.001"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "a\na\nb\n a\n\na"), (10**6 + 4, "CC BY cc by all rights reserved"), (10**6 + 5, "A b"), (10**6 + 6, "a  B"), (10**6 + 7, "é" * 450), (10**6 + 8, "ab" * 300), (10**6 + 9, "x\x1cy İ Σ 漢字 <|endoftext|> | é <b>")]
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    extra = list(ODD)
    for i in range(30):
        a = rnd.randrange(0, 900)
        noise = lambda: "".join(rnd.choice("xyz") for _ in range(rnd.randrange(400)))
        extra.append((2 * 10**6 + i, noise() + passage[a : a + rnd.randrange(380, 600)] + noise()))
        w = base[:]
        for _ in range(rnd.choice([0, 1, 2, 4])):
            w[rnd.randrange(100)] = f"z{rnd.randrange(10**6)}"
        extra.append((3 * 10**6 + i, " ".join(w)))
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return d.union(spark.createDataFrame([(*x, None) for x in extra], "doc_id long, text string, lang string")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_suffix_dedup(docs, rows, empty):
    seen = Counter()
    for r in rows:
        b = (r.text or "").encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    removed = 0
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(v for v, g in zip(b, gone) if not g)
        spans = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        removed += sum(gone)
    assert removed > 10_000 and got[10**6].text is None
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("words", [51, 7])
def test_passages_of_words(docs, rows, empty, words):
    """Bytes of 400-byte strings that occur twice, and of passages of so many words that two rows have."""
    strings, passages, spans = Counter(), {}, []
    for i, r in enumerate(rows):
        b = (r.text or "").encode()
        strings.update(b[k : k + 400] for k in range(len(b) - 399))
        w = list(re.finditer(rb"[^\x20\x09-\x0D]+", b))
        spans.append([(w[k].start(), w[k + words - 1].end(), b" ".join(m.group() for m in w[k : k + words])) for k in range(len(w) - words + 1)])
        for *_, p in spans[-1]:
            passages.setdefault(p, set()).add(i)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, words=words).collect()}
    more = 0
    for r, own in zip(rows, spans):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if strings[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        before = sum(gone)
        for begin, end, p in own:
            if len(passages[p]) > 1:
                gone[begin:end] = b"\1" * (end - begin)
        more += sum(gone) - before
        x = got[r.doc_id]
        assert (x.n_removed, x.kept_sha256) == (sum(gone), hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest())
    assert len(got) == len(rows) and more > 1_000
    assert suffix_dedup.dedup(empty, words=words).count() == 0


def test_passages_under_400_bytes_leave_the_pipeline(spark):
    import corpus_pipeline as C

    one, two = ([f"{c}{i}" for i in range(51)] for c in "ab")
    text = {1: f"x {' '.join(one)} y", 2: "z\n" + "\n\t".join(one), 3: f"u {' '.join(one[:50])} v", 4: " ".join([*two, "and", *two]), 5: " ".join(one) + "\n", 6: None, 7: "\n"}
    d = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(C.STAGES)["repeated passages"](spark, d, SF).collect()}
    assert got == {1: ("x  y", 4), 2: ("z\n", 2), 3: (text[3], len(text[3])), 4: (text[4], len(text[4])), 6: (None, None), 7: ("\n", 1)}


def test_word_runs_meet_at_segments(monkeypatch):
    """Runs hold every window of a text once, wherever segments end."""
    texts = [b" ".join(b"%d" % (i * i % 97) for i in range(n)) for n in (300, 0, 6, 7, 100)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for size in (1 << 20, 33, 8):
        monkeypatch.setattr(suffix_dedup, "_SEGMENT", size)
        _, _, doc, begin, end = suffix_dedup.word_runs(np.frombuffer(b"".join(texts), np.uint8), off, 7)
        assert {k: sum(len(texts[k][a:b].split()) - 6 for d, a, b in zip(doc, begin, end) if d == k) for k in range(5)} == {0: 294, 1: 0, 2: 0, 3: 1, 4: 94}


def test_wavelet_tokens(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    got = {r.doc_id: tuple(r)[1:] for r in wavelet.read_documents(wavelet.write_shards(docs, P.path("word_bpe_49k.json"), shard=20_000)).collect()}
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(empty, P.path("word_bpe_49k.json"))).count() == 0


def test_distinct():
    x = np.array([7, 3, 7, 2**63, 3, 1], np.uint64)
    one, number = K.distinct(x)
    assert one.tolist() == [0, 1, 3, 5] and (x[one][number] == x).all()
    assert [len(a) for a in K.distinct(x[:0])] == [0, 0]


def test_wavelet_lookup():
    ids = np.random.default_rng(0).integers(0, 3000, 5000).astype(np.uint16)
    s = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(ids, np.array([1]), np.array([5000]), 16).to_bytes())
    assert (s.decode() == ids).all() and all(s.access(i) == ids[i] for i in range(0, 5000, 97))
    for t in (int(ids[0]), int(ids[77]), 2999, 40_000):
        at = np.flatnonzero(ids == t)
        assert s.count(t) == len(at) and s.count(t, 2500) == (at < 2500).sum() and [s.find(t, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        s.find(40_000, 0)


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()}
    for r in rows:
        t = r.text or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        n = Counter(zip(w, w[1:], w[2:]))
        twice = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert x.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (x.base_failed and x.kept)
    judged = [(got[r.doc_id].kept, r.quality) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert all(k for k, q in judged if q == 1) and not any(k for k, q in judged if q == 0)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_duplicate_lines_of_texts_that_end_in_a_break():
    rnd = random.Random(5)
    texts = ["a\na\n", "b\nb", "", "\n", "c\n", "c\nc\n\n", "\n\nd\nd", "e"] + ["".join(rnd.choice("ab \n") for _ in range(rnd.randrange(9))) for _ in range(300)]
    lines = [[x for x in t.split("\n") if SPACED.search(x)] for t in texts]
    got = quality.base_counts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))["n_dup_lines"]
    assert got.tolist() == [len(x) - len(set(x)) for x in lines] and got[:2].tolist() == [1, 1]


def test_quality_ratios_at_every_size():
    """Ratios go from the neighbourhood's to the bucket's own without a step; more text gives more buckets."""
    rnd = np.random.default_rng(3)
    share = np.exp(rnd.normal(0, 1, (2, 1 << 16)))
    raw = 65536 * share[0] / share[0].sum()
    target = raw * share[1] / (raw * share[1]).sum() * 30_000
    own = np.log(target / target.sum() / (raw / raw.sum()))
    off = [np.abs(quality.ratios(raw * n, target * n) / quality.UNIT - own).mean() for n in (1, 99.9, 100.1, 10**5)]
    assert off[0] > off[1] > off[2] > off[3] and off[1] - off[2] < 0.001 and off[3] < 0.02
    steps = [quality.ratios(raw * n, target * n) / quality.UNIT for n in (99.9, 100.1)]
    assert np.abs(steps[0] - steps[1]).max() < 0.01
    assert quality.bits_of(0) == 16 and quality.bits_of(10**8) < quality.bits_of(5 * 10**8) < quality.bits_of(10**10)


def test_quality_rules_with_more_buckets(spark, docs, monkeypatch):
    """The path of large corpora: many narrow buckets, each with evidence of its own."""
    monkeypatch.setattr(quality, "BUCKET_BYTES", 1)
    d = docs.where("doc_id < 1000")
    many = d.crossJoin(spark.range(40)).select((F.col("doc_id") * 40 + F.col("id")).alias("doc_id"), "text")
    good = spark.read.parquet(f"{SF}/labels.parquet").crossJoin(spark.range(40)).select((F.col("doc_id") * 40 + F.col("id")).alias("doc_id"), "quality")
    ratio = quality.fit(many, good.where("quality = 1"))
    assert len(ratio) > 1 << 20
    got = quality.score(many, ratio).join(good, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert bad and max(r.llr for r in bad) < -1 and sum(r.kept for r in good) > 0.98 * len(good)


@pytest.mark.parametrize("block_items", [20_000, 7])
def test_decontamination(spark, docs, rows, empty, block_items):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "cc by"), (901, "--"), (902, None), (903, "CC BY")], "item_id long, text string"))
    window = {}
    for r in items.collect():
        w = ALNUM.findall(lower(r.text))
        for k in [tuple(w[j : j + 8]) for j in range(len(w) - 7)] if len(w) >= 8 else [tuple(w)] if w else []:
            window.setdefault(k, set()).add(str(r.item_id))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, block_items=block_items).collect()}
    for r in rows:
        w, hit, found = ALNUM.findall(lower(r.text)), set(), set()
        for n in {len(k) for k in window}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in window:
                    hit |= set(range(j, j + n))
                    found |= window[k]
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_items > 0").count() == 0


@pytest.mark.parametrize("block_items", [20_000, 1])
def test_decontamination_of_repeated_rows(spark, block_items):
    """Equal rows, and other texts with the same id or none, stay rows of their own in any number of blocks."""
    docs = [(1, "some words of a leaked benchmark item here"), (2, "another one")] * 2 + [(None, "nothing known"), (None, "nothing known at all")]
    d = spark.createDataFrame([], "doc_id long, text string")
    for x in docs:  # a partition, and so a segment, for each
        d = d.union(spark.createDataFrame([x], "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([(1, "a leaked benchmark item"), (2, "benchmark item here"), (3, "never seen")], "item_id long, text string")
    got = [(r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(d, items, block_items=block_items).collect()]
    assert sorted(got) == [(0, 2, 0, 0), (0, 4, 0, 0), (1, 8, 5, 2), (1, 8, 5, 2), (2, 2, 0, 0), (2, 2, 0, 0)]


def test_near_over_an_index(spark, docs, rows):
    index = decontaminate.build_index(docs, common.Scratch(spark, "near"))
    for text, slop in (("of the", 1), ("The, AND of", 6), ("cc by", 0), ("cc by", 1), ("qqqq the", 9)):
        terms = set(ALNUM.findall(lower(text)))
        hit = set()
        for r in rows:
            w = ALNUM.findall(lower(r.text))
            # whichever term is the rarest, a text is hit if one of its places has all others around
            by = {x: [i for i, v in enumerate(w) if v == x and terms <= set(w[max(0, i - slop) : i + slop + 1])] for x in terms}
            if all(by.values()):
                hit.add(r.doc_id)
        got = {r.doc_id: r for r in decontaminate.near(index, text, slop).collect()}
        assert len(got) == len(rows) and hit <= {k for k, r in got.items() if r.n_near}
        for r in rows:
            w = ALNUM.findall(lower(r.text))
            assert all(terms <= set(w[max(0, i - slop) : i + slop + 1]) for i in got[r.doc_id].at)
    assert decontaminate.near(index, "of the", 1).where("n_near > 0").count()


def test_near():
    h, n = decontaminate.words(np.frombuffer(b"a b c d a x x b", np.uint8), np.array([0, 15]))
    s = decontaminate.Segment.build(h, np.arange(8))
    assert s.near(h[[0, 1]], 1).tolist() == [0] and s.near(h[[0, 1]], 3).tolist() == [0, 4] and s.near(np.array([5], np.uint64), 3).tolist() == []


def test_license_scan(docs, rows, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in rows:
        w, at, labels = ALNUM.findall(lower(r.text)), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    at.append(j)
                    labels.add(label)
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert licenses.scan(empty).count() == 0


def test_license_with_a_word_put_in(spark):
    d = spark.createDataFrame([(1, "Licensed under the special Apache License, Version 2.0."), (2, "the version of the license")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(d).collect()} == {1: "apache-2.0", 2: ""}


def test_language_id(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(d.where(~langid.held_out()))
    got = langid.predict(d, model).join(d.select("doc_id", "lang", langid.held_out().alias("ho")), "doc_id").where("ho").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    und = {r.doc_id for r in langid.predict(odd, model).collect() if r.lang_pred == "und"}
    assert und == {10**6, 10**6 + 1, 10**6 + 2}
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_language_id_keeps_4_grams_apart(spark, monkeypatch):
    """4-grams that share a hash slot, more than 64 languages, and a model in parts."""
    word = lambda x: "".join(chr(97 + x // 26**j % 26) for j in range(4))
    key = lambda w: sum(ord(c) << 12 * (3 - j) for j, c in enumerate(w))
    words = [word(x) for x in range(0, 26**4, 101)]
    slots, pairs = {}, []
    for w, s in zip(words, langid.slot_of(np.array([key(w) for w in words], np.uint64)).tolist()):
        if s in slots:
            pairs.append((slots[s], w))
        slots[s] = w
    assert len(pairs) > 3
    texts = [(i, f"{a} {b} {b}", f"l{i % 2}") for i, p in enumerate(pairs) for a, b in [p if i % 2 else p[::-1]]] + [(1000 + i, word(7 * i), f"m{i}") for i in range(70)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    count = {}
    for _, t, lang in texts:
        t = f"\0\0\0{t.replace(' ', chr(0))}\0"
        count.setdefault(lang, Counter()).update(t[i : i + 4] for i in range(len(t) - 3))

    def p(c, gram):
        """Interpolated Kneser-Ney by its definition."""
        if not gram:
            return 1 / 4096
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        same = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        below = p(Counter(g[1:] for g in c), gram[1:])
        return max(c[gram] - d, 0) / sum(same) + min(d, 1) * len(same) / sum(same) * below if same else below

    model = langid.fit(d)
    assert len(model.langs) == 72 and len(model.parts) == 1
    part = model.parts[0].value
    assert len(part.keys) == len({g for c in count.values() for g in c})
    for w in {w for pair in pairs[:3] for w in pair}:
        for lang in ("l0", "l1", "m3"):
            t = f"\0\0\0{w}\0"
            want = sum(np.log(p(count[lang], t[i : i + 4])) for i in range(len(t) - 3))
            assert abs(part.totals([w])[0][0, model.langs.index(lang)] / langid.UNIT - want) < 1e-3
    one = sorted(map(tuple, langid.predict(d, model).collect()))
    monkeypatch.setattr(langid, "CELLS", 5_000)
    model = langid.fit(d)
    assert len(model.parts) > 2 and sorted(map(tuple, langid.predict(d, model).collect())) == one


def _components(rows):
    sets = []
    for r in rows:
        w = SPACED.findall(lower(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return {r.doc_id: (len(sets[i]), least[top(i)]) for i, r in enumerate(rows)}


def test_components(spark):
    rnd = random.Random(2)
    chain = rnd.sample(range(200), 60)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2100) for i in range(40)] + [(7, 7), (1001, 1000)]
    edges += [(rnd.randrange(3000, 3200), rnd.randrange(3000, 3200)) for _ in range(120)]
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted((v, top(v)) for v in up)
    assert common.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("pairs", [4, 0])
def test_jaccard_join(docs, rows, monkeypatch, pairs):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == _components(rows)


@pytest.mark.parametrize("pairs", [4, 0])
def test_jaccard_groups(docs, rows, empty, monkeypatch, pairs):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect()} == _components(rows)
    assert jaccard.groups(empty).count() == 0


def test_jaccard_links(docs, rows, monkeypatch):
    """Every link, also inside a component and across the blocks of a column."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sets = {}
    for r in rows:
        w = SPACED.findall(lower(r.text))
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
    near = lambda a, b: len(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    members, pairs = jaccard.links(docs)
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: sum(1 for m, b in sets.items() if m != k and near(a, b)) for k, a in sets.items()}
    of = {r.class_id: sets[r.doc_id] for r in members.collect() if sets[r.doc_id]}
    want = [(a, b) for a in of for b in of if a < b and near(of[a], of[b])]
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len(want) > 40


def test_jaccard_join_of_nothing(empty):
    assert jaccard.join(empty).count() == 0


def _library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, rows, empty):
    lib = _library()
    long = [(5 * 10**6, "x" * 9000), (5 * 10**6 + 1, "ab \n\n " * 3000), (5 * 10**6 + 2, ("word" + "!" * 30 + "  ") * 300), (5 * 10**6 + 3, "a\x1cb " * 2000)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    out = bpe.decode(bpe.encode(every, P.path(queries.RANKS), P.PATTERN, chunk=1000, overlap=100), P.path(queries.RANKS), P.PATTERN)
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in out.collect()}
    texts = {r.doc_id: r.text or "" for r in rows} | dict(long)
    assert got == {k: (np.array(lib.encode_ordinary(t), "<u4").tobytes(), t.encode()) for k, t in texts.items()}
    assert bpe.digests(empty, P.path(queries.RANKS), P.PATTERN).count() == 0


def test_token_counts(spark, docs, rows, empty, tmp_path):
    lib = _library()
    files = token_counts.write_tokens(docs, P.path(queries.RANKS), P.PATTERN, block=1000)
    got = {r.doc_id: r.n_tokens for r in token_counts.by_key(files, token_counts.count_tokens(files)).collect()}
    assert got == {r.doc_id: len(lib.encode_ordinary(r.text or "")) for r in rows}
    ids = [1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    for block in (2, 6, 1000):
        flat = token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path / "*.bin"), block), end=9).orderBy("ordinal").collect()
        assert [(r.start, r.n_tokens, r.finished) for r in flat] == [(0, 2, True), (3, 0, True), (4, 5, True), (10, 2, False)]
    assert token_counts.count_tokens(token_counts.write_tokens(empty, P.path(queries.RANKS), P.PATTERN)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/2", "ftp://x.net/es/3#y", "http://net/fr/", "x", None, "http://q.org", "http://example.com://en/", "http://notexample.com/en/"]
    urls += [f"http://h.org/good/{i}.html" for i in range(40)] + [f"http://h.org/bad/{i}.html" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/bad/" in (u or ""))) for i, u in enumerate(urls) if i % 2], "doc_id long, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, queries.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("x.net", "/es/3", "net/es/"), ("net", "/fr/", "net/fr/"), ("", "", None), ("", "", None), ("q.org", "", None), ("example.com:", "//en/", None), ("notexample.com", "/en/", "com/")]
    assert {r.verdict for i, r in got.items() if "/bad/" in (urls[i] or "")} == {"block"} and {r.verdict for i, r in got.items() if "/good/" in (urls[i] or "")} == {"allow"}
    assert url_filter.judge(pages.limit(0), labels, queries.RULES).count() == 0


def test_url_filter_judges_every_level(spark):
    """A bad host whose labels are spread over folders, a bad folder in the middle of a good host, and segments beyond the fourth."""
    spread = [f"http://spread.org/{c}/sub/x{c}{i}" for c in "abcdef" for i in range(2)]
    inner = [f"http://mixed.org/{a}/{c}/p" for a in ("fine", "foul") for c in "abcdefghij"]
    deep = [f"http://deep.org/a/b/c/d/{c}{c}/end/{c}.html" for c in "abcdefghij"]
    urls = spread + inner + deep + [f"http://good{i}.org/" for i in range(200)] + ["http://spread.org/new/sub/y", "http://mixed.org/foul/new/p", "http://mixed.org/fine/new/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spread" in u or "foul" in u)) for i, u in enumerate(urls[:-3])], "doc_id long, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, []).collect()}
    assert len(got) == len(urls)
    assert {r.verdict for r in got.values() if r.host == "spread.org" or "/foul/" in r.path} == {"block"}
    assert {r.verdict for r in got.values() if r.host != "spread.org" and "/foul/" not in r.path} == {"allow"}
    assert {r.template for r in got.values() if r.host == "deep.org"} == {"deep.org/a/b/c/d/*/end/*.html"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as C

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now, stored = d, common.Scratch(spark, "stages")
    for name, stage in C.STAGES[:-1]:
        now = stored.store(stage(spark, now, SF), name)
        assert now.columns == C.COLUMNS, name
    lib = _library()
    kept = {r.doc_id: r.text for r in now.collect()}
    got = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert got.keys() == kept.keys() and 50 < len(got) < d.count()
    for k, t in kept.items():
        ids = np.array(lib.encode_ordinary(t), "<u4").tobytes()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
