"""License scans by diagonal voting. DataFrame functions only.

Every rolling word pair of every text is joined, by its hash, to the positions of that pair in the license
templates (a fixed, small table). A match at word p of the text and word t of a template votes for the
diagonal p - t; a diagonal's votes are the list of the template's pairs that stand on it. Neighbouring
diagonals (a few words inserted or left out) are merged: each diagonal that has votes is looked at with those
up to DRIFT to either side, so a span's drift is bounded, however long the chain of diagonals is. The merged
span is verified by alignment: the longest sequence of its votes in which both the place in the text and
the place in the template grow is the share of the template that stands there, in order. Pairs in another order
or from another place of the text don't add up. A span of a short template (and of the base phrases) is a
match only where every pair stands on one diagonal, which is word for word.

The join compares the words themselves beside the hash, so every vote is exact. Templates may have any length.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases: a null or empty text has no words and no labels, null first and last places and score 0;
a text of one word has no pairs; repeated rows (same id and text) get equal results, also where the id
is null; other columns pass through, and a result column whose name is taken gets underscores before it.
Texts are scanned whole. Only matched pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import null_safe_key, spare_name

#: Phrases whose places are counted: words and label (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Longer templates: label and a license's usual notice, its opening or its whole text (fixed values).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
)
#: Share of a template's pairs that must stand in a span in order, and how far to either side its diagonals may lie.
COVER, DRIFT = 0.75, 4
#: Templates of so few pairs count only where every pair is there on one diagonal.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_pairs(spark: SparkSession) -> DataFrame:
    """(template, phrase, label, pairs, place, ta, tb, h): a row for each word pair of each template."""
    rows = []
    for k, (phrase, label, text) in enumerate([*((True, n, p) for p, n in PHRASES), *((False, n, p) for n, p in TEMPLATES)]):
        words = text.split()
        rows += [(k, phrase, label, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    out = spark.createDataFrame(rows, "template int, phrase boolean, label string, pairs int, place int, ta string, tb string")
    return out.withColumn("h", pair_hash(F.col("ta"), F.col("tb")))


def votes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each document, template and diagonal with votes: the template's pairs that stand there (no more than it has)."""
    spark = docs.sparkSession
    words = F.col("words")
    rows = docs.select(null_safe_key(id_col).alias("key"), F.xxhash64(text).alias("xh"), words_of(F.col(text)).alias("words")).where(F.size("words") > 1)
    pairs = rows.select("key", "xh", F.posexplode(F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b"))).alias("at", "pair"))
    pairs = pairs.select("key", "xh", "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    # A constant table of a few hundred rows: broadcast.
    templates = F.broadcast(template_pairs(spark))
    hit = (pair_hash(F.col("a"), F.col("b")) == F.col("h")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    found = pairs.join(templates, hit)
    return found.groupBy("key", "xh", "template", "phrase", "label", "pairs", (F.col("at") - F.col("place")).cast("long").alias("diagonal")).agg(
        F.collect_list("place").alias("places")
    )


def in_order(votes: Column) -> Column:
    """Length of the longest sequence of votes (at, place) in which both grow.

    The votes come by place, those of one place by falling `at`, so that no two of them follow one another; then
    it is the longest growing sequence of `at`. The state holds, for each length, the least last `at` of such a sequence.
    """
    ordered = F.array_sort(F.transform(votes, lambda v: F.struct(v["place"].alias("place"), (-v["at"]).alias("back"))))
    ends = F.aggregate(ordered, F.array().cast("array<bigint>"), lambda held, v: F.concat(
        F.filter(held, lambda x: x < -v["back"]), F.array(-v["back"]),
        F.slice(F.filter(held, lambda x: x >= -v["back"]), F.lit(2), F.greatest(F.lit(1), F.size(held))),
    ))
    return F.size(ends)


def spans(voted: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals and keep what stands in order for enough of its template: key, xh, ..., cover."""
    near = W.partitionBy("key", "xh", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    strict = F.col("phrase") | (F.col("pairs") <= SHORT)
    count = F.size("places")
    # What has too few votes in all goes before anything is gathered.
    enough = F.when(strict, count == F.col("pairs")).otherwise(F.sum(count).over(near) >= F.col("pairs") * COVER)
    votes_of = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place")))
    marked = voted.withColumn("enough", enough)
    # Only what lies beside such a diagonal is gathered.
    marked = marked.withColumn("beside", F.max("enough").over(near)).where("beside").withColumn("band", F.flatten(F.collect_list(votes_of).over(near)))
    cover = F.when(strict, F.lit(1.0)).otherwise(in_order(F.col("band")) / F.col("pairs"))
    return marked.where("enough").withColumn("cover", cover).where(F.col("cover") >= COVER).select("key", "xh", "template", "phrase", "label", "pairs", "diagonal", "cover")


def licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("phrase")
    found = spans(votes(docs, id_col, text)).groupBy("key", "xh").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    held = spare_name(docs, "license")
    found = found.select(F.col("key").alias("found_key"), F.col("xh").alias("found_xh"), F.struct("n_base", "first_word", "last_word", "base_labels", "labels", "score").alias(held))
    n_words, key, xh = (spare_name(docs, c) for c in ("n_words", "license_key", "license_xh"))
    slim = docs.withColumns({n_words: F.size(words_of(F.col(text))).cast("long"), key: null_safe_key(id_col), xh: F.xxhash64(text)}).drop(text)
    out = slim.join(found, (F.col(key) == F.col("found_key")) & (F.col(xh) == F.col("found_xh")), "left").drop("found_key", "found_xh", key, xh)
    for c, none in (("n_base", F.lit(0).cast("long")), ("first_word", None), ("last_word", None), ("base_labels", F.lit("")), ("labels", F.lit("")), ("score", F.lit(0.0))):
        value = F.col(f"{held}.{c}")
        out = out.withColumn(spare_name(docs, c), value if none is None else F.coalesce(value, none))
    return out.drop(held)
