"""Odd tables for every operator: hash traps, clashing columns, repeated rows, null keys, very long texts, empty tables."""

import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from inkframe.llm import bpe, common, decontaminate, jaccard, langid, licenses, quality, queries, suffix_dedup, token_counts, url_filter, wavelet

SF = "/root/testdata/sf0.001"


def _words(n):
    """A Thue-Morse word and its complement: equal under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def _quality(d):
    return quality.score(d, quality.fit(d, d.select("doc_id").limit(3)))


def _decontaminate(d):
    items = d.sparkSession.createDataFrame([(1, "the first of some words"), (2, "Of some")], "item_id long, text string")
    return decontaminate.decontaminate(d, items)


def _tokens(d):
    files = token_counts.write_tokens(d, P.path(queries.RANKS), P.PATTERN)
    return token_counts.by_key(files, token_counts.count_tokens(files)).drop("file", "ordinal", "start")


RUN = {
    "op1": lambda d: suffix_dedup.dedup(d, with_text=False),
    "op2": lambda d: wavelet.read_documents(wavelet.write_shards(d, P.path(queries.WORDS))),
    "op3": _quality,
    "op4": _decontaminate,
    "op5": licenses.scan,
    "op6": lambda d: langid.predict(d, langid.fit(d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")))),
    "op7": lambda d: jaccard.join(d).drop("class_id"),
    "op8": lambda d: bpe.digests(d, P.path(queries.RANKS), P.PATTERN),
    "op9": _tokens,
}
PASSAGE = " ".join(f"word{i * i % 97}" for i in range(120))
ROWS = [(1, "the first of some words"), (2, PASSAGE), (3, f"other begin {PASSAGE} other end"), (4, None), (5, ""), (6, " \n"), (7, "x" * 500), (8, "cc by, All Rights Reserved"), (9, PASSAGE + " tail")]


def _rows(df, columns):
    return sorted(str([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", RUN)
def test_clashing_columns(spark, name):
    """Columns with the names that an operator uses itself change nothing."""
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    plain = RUN[name](d)
    clash = d
    for c in ("_row", "_z", "key", "row", "a", "b", "n", "h", "pos", "words", "grams", "ids", "seq", "part", "segment", "_spans", "c0", "c1", "kept_text", "size", "comp", "lang_x"):
        clash = clash.withColumn(c, F.lit("own"))
    assert _rows(RUN[name](clash), plain.columns) == _rows(plain, plain.columns)


@pytest.mark.parametrize("name", RUN)
def test_repeated_rows_and_null_keys(spark, name):
    """Every row has a result: equal rows equal ones, and null keys stay."""
    rows = [(1, PASSAGE), (1, PASSAGE), (2, "some text of its own"), (None, "some words"), (None, None), (None, "some words"), (3, "Some  text of its own")]
    got = [(r["doc_id"], r) for r in RUN[name](spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(str(k) for k, _ in got) == sorted(str(k) for k, _ in rows)
    places = {"start"} if name == "op2" else set()
    one, two = ([r[c] for c in r.__fields__ if c not in places] for k, r in got if k == 1)
    assert one == two
    if name == "op1":
        assert all(r["n_removed"] == r["n_bytes"] for k, r in got if k == 1)
    if name == "op7":
        assert all((r["component_id"], r["n_links"]) == (1, 1) for k, r in got if k == 1)
        assert {r["component_id"] for k, r in got if k in (2, 3)} == {2}


@pytest.mark.parametrize("name", RUN)
def test_very_long_text(spark, name):
    """A text of 3 MB between small ones."""
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(450_000))
    rows = [(1, PASSAGE), (2, long), (3, PASSAGE + " x"), (4, "z" * 200_000)]
    got = {r.doc_id: r for r in RUN[name](spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert set(got) == {1, 2, 3, 4}
    if name in ("op3", "op4", "op5"):
        assert got[2].n_words == 450_000
    if name == "op7":
        assert got[2].n_shingles == len({tuple(w) for w in zip(*(long.split()[i:] for i in range(5)))}) and got[1].component_id == got[3].component_id == 1
    if name == "op8":
        assert got[2].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    if name == "op1":
        assert (got[2].n_bytes, got[1].n_removed, got[4].n_removed) == (len(long), len(PASSAGE), 200_000)


@pytest.mark.parametrize("name", RUN)
def test_empty_table(spark, name):
    assert RUN[name](spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_fool_polynomials(spark):
    a, b = _words(2048)
    d = spark.createDataFrame([(1, f"{a} q w e r"), (2, f"{b} q w e r"), (3, f"{a}\n{b}"), (4, f"{a}\n{a}")], "doc_id long, text string")
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(d.where("doc_id < 3")).collect()} == {1: (1, 0), 2: (2, 0)}
    items = spark.createDataFrame([(1, f"{a} q w e r")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(d, items).collect()} == {1: 5, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.n_dup_lines for r in quality.score(d, quality.fit(d, d.limit(0).select("doc_id"))).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    texts = [a[:1024] + "|", b[:1024] + "|", a[:400] + "!" + b[:400]]
    seen = [t[i : i + 400] for t in texts for i in range(len(t) - 399)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen.count(t[i : i + 400]) > 1:
                gone[i : i + 400] = b"\1" * 400
        assert got[k] == sum(gone)


def test_licence_texts(spark):
    """A long licence with a word left out and one put in, and half of it; other words with its commonest pairs."""
    mit = max((t for t, label in licenses.TEMPLATES if label == "mit"), key=len)
    w = mit.split()
    changed = " ".join([*w[:20], *w[21:60], "surely", *w[60:]])
    rows = [(1, mit.upper()), (2, "x " + changed.replace(" or ", ", or ")), (3, " ".join(w[: len(w) // 2])), (4, "the software of the software or the software"), (5, "Σας CC BY İstanbul")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.labels for k, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "", 5: "cc-by"}
    assert got[1].score == 1.0 and 0.85 <= got[2].score < 1 and got[5].n_words == len(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "Σας cc by İstanbul"))


def test_urls_with_clashing_columns_and_null_keys(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "own"), (1, "http://a.net/es/x", "own"), (None, "http://b.org/q/1", "own"), (2, None, "own")], "page_id long, url string, template string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (None, 1, 1), (2, None, 0)], "doc_id long, toxic int, n int")
    got = url_filter.judge(pages, labels, queries.RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got) == [(0, "b.org", "/q/1", None, "allow"), (1, "a.net", "/es/x", "net/es/", "block"), (1, "a.net", "/es/x", "net/es/", "block"), (2, "", "", None, "allow")] or len(got) == 4


def test_pipeline_keeps_odd_rows(spark):
    """Null and repeated ids neither lose clean rows nor spare bad ones; extra columns are left out; an empty table stays empty."""
    import corpus_pipeline as C

    d = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    item = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    bad = " ".join(item)
    rows = [(None, text[0], "en", "s", 1, "own"), (None, bad, "en", "s", 1, "own"), (7, bad, "en", "s", 1, "own"), (7, text[1], "en", "s", 1, "own"), (7, text[1], "en", "s", 1, "own"), (None, None, "en", "s", 1, "own")]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    s = common.Scratch(spark, "odd")
    near = s.store(dict(C.STAGES)["near duplicates"](spark, own, SF), "near")
    assert near.columns == C.COLUMNS and sorted(str((r.doc_id, r.text)) for r in near.collect()) == sorted(str(x) for x in [(None, bad), (7, text[1]), (None, None), (None, text[0])])
    clean = s.store(dict(C.STAGES)["benchmark passages"](spark, own, SF), "clean")
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(x) for x in [(None, text[0]), (7, text[1]), (7, text[1]), (None, None)])
    for name, stage in C.STAGES:
        assert s.store(stage(spark, d.limit(0), SF), f"none {name}").count() == 0


def test_shared_folder_is_asked_for(spark):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf(), "getCheckpointDir": lambda self: None})()
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster())
