"""License scans: base phrases, and an exact containment join of text blocks with license notices; DataFrame functions only.

For a notice of L words, a text's blocks are the windows of 2L words that start at every L-th word, so any passage of
L + 1 words lies whole in one block. A block matches a notice if it holds the share ``CONTAINED`` of its distinct words.
The join is one by words: the words of every notice are ordered by how many documents hold them, rarest first, and a
matching block must hold one of the first ``size - needed + 1`` of them (prefix). Each place of such a word leads to the
two blocks around it; blocks of too few words go (length), and so does a place that is not the first of the block's
rarest common word, or whose rank leaves too few words (position). What remains, one place for each block and notice,
is counted in full.
"""
from __future__ import annotations

import json
import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a notice's distinct words that a block must hold.
CONTAINED = 0.9
#: Words of all notices together up to which the prefix table goes to every executor; beyond, Spark chooses the join.
BROADCAST_WORDS = 200_000
#: Places into which the rows of one text are dealt.
SALTS = 16
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Labels and public license notices.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
                   "or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-attribution-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    """The words of a notice, as ``words`` finds them in a column."""
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), BREAK), "")


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals, planned without a scan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def places(phrase: str, held: str) -> Column:
    """First word of every place where the phrase's words stand consecutively, from 0."""
    parts = phrase.split(" ")
    there = reduce(lambda a, b: a & b, [F.array_contains(held, p) for p in parts])

    def starts(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.get(F.col(held), i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(held) - 1), starts)).otherwise(F.array().cast("array<int>"))


def frequencies(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary, over the whole table; one row for each word comes back."""
    if not vocabulary:
        return {}
    known = rows_of(documents.sparkSession, [{"word": w} for w in vocabulary], "word:string")
    known = F.broadcast(known) if len(vocabulary) <= BROADCAST_WORDS else known
    held = documents.select(F.explode(F.array_distinct(words("text"))).alias("word"))
    return {r["word"]: r["n"] for r in held.join(known, "word").groupBy("word").agg(F.count("*").alias("n")).collect()}


def blocks_matching(documents: DataFrame, notices: list[tuple[str, str]], contained: float = CONTAINED) -> DataFrame:
    """``text_key, label, notice, start, share``: every block that holds enough of a notice, once for each row it is in."""
    spark = documents.sparkSession
    listed = [(number, label, words_of(text)) for number, (label, text) in enumerate(notices)]
    listed = [x for x in listed if x[2]]
    counts = frequencies(documents, sorted({w for *_, found in listed for w in found}))
    index = []
    for number, label, found in listed:
        ordered = sorted(set(found), key=lambda w: (counts.get(w, 0), w))
        needed = ceil(contained * len(ordered) - 1e-9)
        index += [{"word": w, "rank": rank, "notice": number, "label": label, "length": len(found), "needed": needed, "ordered": ordered}
                  for rank, w in enumerate(ordered[:len(ordered) - needed + 1])]
    prefixes = rows_of(spark, index, "word:string,rank:int,notice:int,label:string,length:int,needed:int,ordered:array<string>")
    prefixes = F.broadcast(prefixes) if sum(len(x["ordered"]) for x in index) <= BROADCAST_WORDS else prefixes

    read = documents.select(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), words("text").alias("held"))
    met = read.select("text_key", "held", F.posexplode("held").alias("at", "word")).join(prefixes, "word")
    last = F.call_function("div", F.col("at"), F.col("length")).cast("int")
    around = met.withColumn("window", F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))))
    start = F.col("window") * F.col("length")
    left = around.filter(F.size("held") - start >= F.col("needed")).select(
        "text_key", "label", "notice", "word", "rank", "needed", "ordered", "at", start.alias("start"),
        F.slice("held", start + 1, 2 * F.col("length")).alias("block"))
    ranked = left.filter((F.array_position("block", F.col("word")) == F.col("at") - F.col("start") + 1)
                         & (F.least(F.size("ordered") - F.col("rank"), F.size(F.array_distinct("block"))) >= F.col("needed")))
    common = ranked.withColumn("common", F.array_intersect("ordered", "block"))
    return (common.filter((F.get("common", F.lit(0)) == F.col("word")) & (F.size("common") >= F.col("needed")))
            .select("text_key", "label", "notice", "start", (F.size("common") / F.size("ordered")).alias("share")))


def scan(documents: DataFrame, notices: list[tuple[str, str]] = list(NOTICES), contained: float = CONTAINED) -> DataFrame:
    """Counts, places and labels of every row, over whole texts.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are of the base phrases; ``labels`` adds those of the
    notices that a block holds (one that holds a notice and more words holds it too), ``score`` is the largest share of a notice in a block, 1 where a base phrase stands, else
    0. Null and empty texts have no word and no label. Equal texts get equal results and stay repeated, null ids too; an
    empty table gives no row; without notices only base phrases are found. Other columns are not read.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
                            words("text").alias("held"))
    listed = read.select("doc_id", "text_key", F.size("held").cast("long").alias("n_words"),
                         *[places(phrase, "held").alias(f"places_{k}") for k, (phrase, _) in enumerate(PHRASES)])
    every = [F.col(f"places_{k}") for k in range(len(PHRASES))]
    base = listed.select(
        "doc_id", "text_key", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), "n_words", reduce(lambda a, b: a + b, [F.size(x) for x in every]).cast("long").alias("n_base"),
        F.least(*[F.array_min(x) for x in every]).cast("long").alias("first_word"), F.greatest(*[F.array_max(x) for x in every]).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(x) > 0, label) for x, (_, label) in zip(every, PHRASES)])).alias("own"))
    found = (blocks_matching(documents, notices, contained).groupBy("text_key")
             .agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    # as many found rows as matching texts: no side of bounded size; the copies of one text meet them in SALTS places
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = base.join(salted.hint("merge"), ["text_key", "salt"], "left")
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH notices AS (
  SELECT label, len(w) AS length, list_distinct(w) AS w FROM (
    SELECT label, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (VALUES {', '.join(f'({quoted(label)}, {quoted(text)})' for label, text in NOTICES)}) AS v(label, t))),
read AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
base AS (
  SELECT row, doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c FROM read),
blocks AS (
  SELECT row, label, notices.w AS notice, list_distinct(read.w[k * length + 1:(k + 2) * length]) AS block
  FROM read JOIN notices ON true, unnest(range(CAST(ceil(len(read.w) / length) AS BIGINT))) AS u(k)),
shares AS (
  SELECT row, label, len(list_intersect(notice, block)) / len(notice) AS share FROM blocks
  WHERE len(list_intersect(notice, block)) >= ceil({CONTAINED} * len(notice) - 1e-9)),
found AS (SELECT row, list(DISTINCT label) AS more, max(share) AS share FROM shares GROUP BY row),
own AS (
  SELECT *, list_concat(a, b, c) AS spots,
         list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END],
                     lambda x: x IS NOT NULL) AS own FROM base LEFT JOIN found USING (row))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word,
       CAST(list_max(spots) AS BIGINT) AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM own"""


@query("op12_licenses", SQL)
def _(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
