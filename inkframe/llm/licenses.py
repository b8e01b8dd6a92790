"""License scans (operator 5) by diagonal voting, in DataFrame operations only.

Every rolling run of two and of four words of every text is hashed (64 bits) and joined to the runs of the templates, by hash
and then word for word; short templates vote by two words, long ones by four. A match votes for its diagonal, the text
position less the template position. All runs of a template on one diagonal are an exact place of it. Diagonals at most
``slack`` apart, where words were inserted or left out, are merged; a merged span is verified by the part of the
template's runs that it holds and by its length, and only verified spans count for labels and score. The templates
are a fixed list, so broadcasting them is bounded.

Null and empty texts have no words: their counts are 0, positions null, labels empty, score 0. Equal rows are each
scanned for themselves, also where keys are equal or null; an empty table gives no rows. A label that several spans give
counts once. Of a very long text only the words that match leave its task. Only the key and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that count as base places, with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Public notices and licence texts that give further labels, whole or in large part.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("either version 3 of the license or at your option any later version", "gpl-3"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("no part of this publication may be reproduced without permission", "no-copying"),
    ("dedicated to the public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd-3",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl-2.0",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "public-domain",
    ),
]
#: Separators of words in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words from which a template votes by runs of four words instead of two.
LONG = 16
#: Part of a template's grams that a span must hold, in hundredths, and its length in hundredths of the template's.
COVER, STRETCH = 85, 150


def template_rows() -> list[tuple]:
    """(words of the gram, template, position, grams of the template, its words, label, base)."""
    rows = []
    for number, (phrase, label) in enumerate(BASE + TEMPLATES):
        words = phrase.split()
        k = 4 if len(words) >= LONG else 2
        rows += [(words[i : i + k], number, i, len(words) - k + 1, len(words), label, number < len(BASE)) for i in range(len(words) - k + 1)]
    return rows


def places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, template, ..., diagonal, votes): one row per diagonal with a vote, and one of template -1 per text, whose diagonal is its number of words."""
    spark = docs.sparkSession
    rows = template_rows()
    t = spark.createDataFrame(rows, "gram array<string>, template int, at int, grams int, size int, label string, base boolean")
    t = t.withColumn("h", F.xxhash64("gram"))
    hashes = [r.h for r in t.select("h").distinct().collect()]  # as many as the templates have grams
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    words = F.array_remove(F.split(low, SEPARATORS), "")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words"))
    at = lambda i: F.get("words", i)
    four = F.transform("words", lambda w, i: F.struct(w.alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), at(i + 3).alias("d")))
    none = F.lit(None).cast("string")
    end = F.array(F.struct(*(none.alias(c) for c in "abcd")))
    rolled = base.select("row", "key", F.posexplode(F.concat(four, end)).alias("pos", "w")).select("row", "key", "pos", "w.*")
    two, all4 = F.array("a", "b"), F.array("a", "b", "c", "d")
    rolled = rolled.withColumns({"h2": F.xxhash64(two), "h4": F.xxhash64(all4)})
    ends = F.col("a").isNull()
    rolled = rolled.where(ends | F.col("h2").isin(hashes) | F.col("h4").isin(hashes))
    grams = rolled.select("row", "key", "pos", ends.alias("end"), F.explode(F.when(ends, F.array(two)).otherwise(F.array(two, all4))).alias("gram"))
    # a vote needs the words themselves, not only their hash
    hit = grams.withColumn("h", F.xxhash64("gram")).join(F.broadcast(t.withColumnRenamed("gram", "wanted")), "h", "left")
    hit = hit.where("end OR gram = wanted").withColumn("template", F.when(F.col("end"), F.lit(-1)).otherwise(F.col("template")))
    hit = hit.withColumn("diagonal", (F.col("pos") - F.coalesce("at", F.lit(0))).cast("long"))
    return hit.groupBy("row", "key", "template", "grams", "size", "label", "base", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", slack: int = 3) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every text; spans are (label, begin, end) in words."""
    found = places(docs, key, text)
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(w)
    new = before.isNull() | (F.col("diagonal") - before > slack)
    grouped = found.withColumn("group", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy("row", "key", "template", "grams", "size", "label", "base", "group").agg(
        F.sum("votes").alias("votes"),
        F.min(F.col("diagonal") + F.coalesce("first", F.lit(0))).alias("begin"),
        F.max(F.col("diagonal") + F.col("last") + 1 + F.col("size") - F.col("grams")).alias("end"),
        F.sum((F.col("votes") == F.col("grams")).cast("long")).alias("whole"),
        F.min(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("first_at"),
        F.max(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("last_at"),
    )
    real = F.col("template") >= 0
    place = real & F.col("base")
    verified = real & ((place & (F.col("whole") > 0)) | (~F.col("base") & (100 * F.col("votes") >= COVER * F.col("grams")) & (100 * (F.col("end") - F.col("begin")) <= STRETCH * F.col("size"))))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row").agg(
        F.first("key").alias(key),
        F.max(F.when(~real, F.col("begin"))).alias("n_words"),
        F.sum(F.when(place, F.col("whole")).otherwise(F.lit(0))).alias("n_base"),
        F.min(F.when(place, F.col("first_at"))).alias("first_word"),
        F.max(F.when(place, F.col("last_at"))).alias("last_word"),
        joined(F.when(place & (F.col("whole") > 0), F.col("label"))).alias("base_labels"),
        joined(F.when(verified, F.col("label"))).alias("labels"),
        F.max(F.when(verified, F.least(F.lit(1.0), F.col("votes") / F.col("grams"))).otherwise(F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("label", "begin", "end")))).alias("spans"),
    )
    return out.drop("row")
