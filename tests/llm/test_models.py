"""Scores of the learned operators against their definitions, written out without arrays."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkframe.llm import langid, quality, url_filter


def test_likelihood_ratios_by_definition(spark):
    """Both multinomials, the back-off from wide to narrow buckets, and the mean over a text's n-grams."""
    rnd, size = random.Random(8), quality.LEAST_BITS
    good, bad = ([f"{p}{i}" for i in range(60)] for p in "gb")
    texts = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(rnd.randrange(50, 90))) + ("." if i % 2 else "")) for i in range(200)] + [(200, None), (201, ""), (202, "g1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    trusted = {i for i in range(0, 200, 5) if i % 3}
    grams = {}
    for i, t in texts:
        data = (t or "").encode()
        grams[i] = quality.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]), size)[0].tolist()
        words = (t or "").replace(".", " .").split()
        assert len(grams[i]) == len(words) + max(len(words) - 1, 0)
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in trusted for b in grams[i])
    share = sum(target.values()) / sum(raw.values())

    def ratio(bucket, bits=size):
        if bits < quality.TOP_BITS:
            return 1.0
        t, e = (sum(n for b, n in c.items() if b >> (size - bits) == bucket >> (size - bits)) for c in (target, raw))
        e *= share
        return (t + quality.EVIDENCE * ratio(bucket, bits - 1)) / (e + quality.EVIDENCE)

    log = {b: math.log(ratio(b)) for b in raw}
    got = quality.score(docs, quality.fit(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"))).collect()
    for r in got:
        want = sum(log[b] for b in grams[r.doc_id]) / max(len(grams[r.doc_id]), 1)
        assert abs(r.llr - want) < 1e-5 and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_held_out_quality(spark):
    """Fitted on the good documents of one half, the other half's are kept and its bad ones rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels.where("quality = 1 AND doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept for r in got if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in got) and not any(r.kept for r in got if r.quality == 0)


def _tree(urls, labels):
    """(template, purity) of every url, node by node. urls: (host, path); labels: bad or not, or None."""
    segments = [p.removeprefix("/").split("/") for _, p in urls]
    out = [None] * len(urls)

    def purity(m, b, parent):
        pm, pb, pp = parent
        rest = pm - m
        pooled = pb / max(pm, 1)
        se = math.sqrt(pooled * (1 - pooled) * (1 / max(m, 1) + 1 / max(rest, 1)))
        gap = abs(b / max(m, 1) - (pb - b) / max(rest, 1))
        return pp if not m or not rest or gap <= url_filter.Z * se else (b + url_filter.WEIGHT * pp) / (m + url_filter.WEIGHT)

    def generalised(s):
        text, number = "", False
        for c in s:
            if c in "0123456789":
                text += "" if number else "#"
                number = True
            else:
                text, number = text + c, False
        return text

    def node(template, members, depth, parent):
        known = [labels[i] for i in members if labels[i] is not None]
        mine = (len(known), sum(known), purity(len(known), sum(known), parent))
        further = [i for i in members if len(segments[i]) > depth]
        kinds = {generalised(segments[i][depth]) for i in further}
        wild = len(kinds) >= url_filter.KINDS and 100 * len(kinds) > url_filter.SPREAD * len(further)
        below = defaultdict(list)
        for i in members:
            if len(segments[i]) <= depth:
                out[i] = (template, mine[2])
                continue
            s = generalised(segments[i][depth])
            if wild:
                dot = s.rfind(".")
                end = s[dot + 1 :]
                s = "*" + (s[dot:] if dot >= 0 and end and all(c == "#" or "a" <= c <= "z" for c in end) else "")
            below[s].append(i)
        for s, some in below.items():
            node(f"{template}/{s}", some, depth + 1, mine)

    known = [x for x in labels if x is not None]
    top = (len(known), sum(known), sum(known) / max(len(known), 1))
    for host in {h for h, _ in urls}:
        node(host, [i for i, (h, _) in enumerate(urls) if h == host], 0, top)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_url_tree_by_definition(spark, seed):
    rnd = random.Random(seed)
    urls, labels = [], []
    for _ in range(900):
        host = rnd.choice(["a.org", "a.org", "b.org", "c.org"])
        section = rnd.choice(["good", "bad", "mixed", "x1", "x22"])
        path = rnd.choice(["", "/", f"/{section}", f"/{section}/{rnd.randrange(40)}.html", f"/{section}/{''.join(rnd.choice('pqrs') for _ in range(4))}/a/b/c/{rnd.randrange(3)}.HTM", f"/{section}/k{rnd.choice('abcdefghijkl')}.x"])
        urls.append((host, path))
        rate = {"bad": 0.9, "good": 0.02}.get(section, 0.4) if host != "c.org" else 0.95
        labels.append(int(rnd.random() < rate) if rnd.random() < 0.5 else None)
    pages = spark.createDataFrame([(i, f"http://{h}{p}?q") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    marks = spark.createDataFrame([(i, x) for i, x in enumerate(labels) if x is not None], "doc_id long, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, marks, []).collect()}
    for i, (template, purity) in enumerate(_tree(urls, labels)):
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9 and got[i].verdict == ("block" if purity >= url_filter.LIMIT else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"} and any("*" in r.template for r in got.values())


def test_rejection_of_other_languages(spark):
    """Text unlike any language that was learned is rejected; text like it isn't."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(d.where(~langid.held_out()))
    held = langid.predict(d.where(langid.held_out()), model).collect()
    assert sum(r.rejected for r in held) < 0.05 * len(held)
    other = [(1, "съешь же ещё этих мягких французских булок да выпей чаю " * 5), (2, "zxqj vwkq pqzx jjqz kwvx " * 10), (3, "漢字仮名交じり文" * 20)]
    assert all(r.rejected for r in langid.predict(spark.createDataFrame(other, "doc_id long, text string"), model).collect())
