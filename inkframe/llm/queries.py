"""The operators' queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import bpe, decontaminate, jaccard, langid, licenses, quality, suffix_dedup, token_counts, url_filter, wavelet
from inkframe.llm.common import Scratch, table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizers.path(WORDS))
    return wavelet.read_documents(shards)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality.score(docs, ratio, with_text=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizers.path(RANKS), tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "tokens")
    files = token_counts.write_tokens(table(spark, sf_dir, "documents"), tokenizers.path(RANKS), tokenizers.PATTERN, scratch=s)
    return token_counts.by_key(files, token_counts.count_tokens(files, scratch=s)).select("doc_id", "n_tokens")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("purity", 9).alias("purity"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_wavelet_tokens, op3_quality_rules, op4_decontamination, op5_license_scan, op6_language_id, op7_jaccard_join, op8_byte_bpe, op9_token_counts, op10_url_filter)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _license_templates() -> str:
    """The templates' grams as SQL rows."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return ", ".join(f"({quoted(gram)}, {n}, {at}, {grams}, {size}, '{label}', {base})" for gram, n, at, grams, size, label, base in licenses.template_rows())


ORACLES = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i : i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM twice),
run AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step) GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS s, s - 1 AS e FROM run UNION ALL SELECT d.doc_id, coalesce(max(run.e), 1), octet_length(any_value(b)) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN e >= s THEN hex(b[s : e]) ELSE '' END, '' ORDER BY s, e))) AS kept_sha256 FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d LEFT JOIN (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id) USING (doc_id) JOIN kept USING (doc_id)""",
    "op5_license_scan": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t(gram, template, place, grams, size, label, base) AS (VALUES {_license_templates()}),
g AS (SELECT doc_id, i - 1 AS pos, w[i : i + k - 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT unnest([2, 4]) AS k) WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, template, grams, size, label, base, pos - place AS diagonal, count(*) AS votes, min(place) AS a, max(place) AS z FROM g JOIN t USING (gram) GROUP BY ALL),
jump AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= 3 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
merged AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS k FROM jump),
span AS (SELECT doc_id, label, base, grams, sum(votes) AS votes, max(diagonal + z + 1 + size - grams) - min(diagonal + a) AS length, size,
  count(*) FILTER (votes = grams) AS whole, min(diagonal) FILTER (votes = grams) AS first_at, max(diagonal) FILTER (votes = grams) AS last_at FROM merged GROUP BY doc_id, template, label, base, grams, size, k),
judged AS (SELECT *, CASE WHEN base THEN whole > 0 ELSE 100 * votes >= 85 * grams AND 100 * length <= 150 * size END AS ok FROM span)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(sum(whole) FILTER (base), 0) AS BIGINT) AS n_base, min(first_at) FILTER (base) AS first_word, max(last_at) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole > 0), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok), '') AS labels,
  coalesce(max(least(1.0, CAST(votes AS DOUBLE) / grams)) FILTER (ok), 0.0) AS score
FROM d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id, len(w)""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s : s + 7] AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS s FROM i WHERE len(w) >= 8)
        UNION SELECT item_id, w FROM i WHERE len(w) BETWEEN 1 AND 7),
sizes AS (SELECT DISTINCT len(k) AS n FROM win),
place AS (SELECT doc_id, s, n, w[s : s + n - 1] AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM place JOIN win USING (k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(v, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.v WHERE reach.r < edge.b),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN degree USING (doc_id) JOIN reach ON reach.v = d.doc_id GROUP BY ALL""",
}
