"""License scans by diagonal voting, with DataFrame functions only.

Templates (license phrases and notices) and documents are cut into rolling word 3-grams. The
hashes of all the documents' 3-grams are joined to the templates' positions (a fixed table of a few
hundred rows, broadcast); words are compared too, so equal hashes of different words don't count.
Each match votes for its offset diagonal, document position less template position. Votes are
aggregated by document, template and diagonal; neighbouring diagonals (up to DRIFT words apart,
that is, small insertions or deletions) are merged; a merged span is verified by the share of
distinct template positions it covers. Licenses of one family share most of their notices, so their
templates are the names that tell them apart. A phrase stands at a place if one diagonal has all of its
votes. Votes are counted as distinct positions before anything meets by document, and only matches
are shuffled.

Defined results: a null text is empty; rows with equal doc_id and text have equal results; rows
that share a doc_id are told apart by their text; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, once, table

K = 3
DRIFT = 3
COVERED = 0.6

# The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The wording of well-known public license notices and their labels.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "apache-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "mit",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one": "mpl-2",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib",
    "GNU General Public License": "gpl",
    "GNU Lesser General Public License": "lgpl",
    "GNU Affero General Public License": "agpl",
    "Creative Commons Attribution 4.0": "cc-by",
    "Creative Commons Attribution ShareAlike": "cc-by-sa",
    "Creative Commons Attribution NonCommercial": "cc-by-nc",
    "has waived all copyright and related or neighboring rights to this work CC0 1.0 Universal": "cc0",
}
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row for each 3-gram of each template: a table of fixed size."""
    rows = []
    for n, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        grams = len(words) - K + 1
        rows += [(n, n < len(phrases), label, grams, at, *words[at : at + K]) for at in range(grams)]
    out = spark.createDataFrame(rows, "template int, is_phrase boolean, label string, grams int, at int, t0 string, t1 string, t2 string")
    return out.withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def _words(text):
    """The text's words; a text that starts with a gap would otherwise start with an empty one."""
    return F.split(F.regexp_replace(ascii_lower(text), "^" + WORD_GAP + "|" + WORD_GAP + "$", ""), WORD_GAP)


def matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, text_hash, template, is_phrase, label, grams, diagonal, votes) of all diagonals with votes."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), once(_words(F.col("text"))).alias("w"))
    n = F.size("w") - (K - 1)
    words = words.where(n > 0).select("doc_id", "text_hash", F.arrays_zip(*[F.slice("w", i + 1, n).alias(f"w{i}") for i in range(K)]).alias("grams_"))
    rolled = words.select("doc_id", "text_hash", F.posexplode("grams_").alias("pos", "g")).select(
        "doc_id", "text_hash", "pos", F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2")
    )
    fixed = templates(docs.sparkSession, phrases, notices)
    hit = rolled.withColumn("gram", F.xxhash64("w0", "w1", "w2")).join(F.broadcast(fixed), "gram")  # fixed size
    hit = hit.where("w0 = t0 and w1 = t1 and w2 = t2")
    keys = ["doc_id", "text_hash", "template", "is_phrase", "label", "grams"]
    hit = hit.select(*keys, (F.col("pos") - F.col("at")).alias("diagonal"), "at").distinct()
    return hit.groupBy(*keys, "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, drift: int = DRIFT, covered: float = COVERED) -> DataFrame:
    """The columns of op8 for every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = matches(docs, phrases, notices)
    whole = F.col("is_phrase") & (F.col("votes") == F.col("grams"))
    lane = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    span = found.withColumn("_new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(lane) > drift).cast("int"), F.lit(1)))
    span = span.withColumn("_span", F.sum("_new").over(lane))
    span = span.groupBy("doc_id", "text_hash", "template", "is_phrase", "label", "grams", "_span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("_covered"),
        F.sum(whole.cast("long")).alias("_whole"),
        F.min(F.when(whole, F.col("diagonal"))).alias("_first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("_last"),
    )
    share = F.col("_covered") / F.col("grams")
    verified = (F.col("_whole") > 0) | (~F.col("is_phrase") & (share >= covered))
    hits = span.groupBy("doc_id", "text_hash").agg(
        F.sum("_whole").alias("n_base"),
        F.min("_first").cast("long").alias("first_word"),
        F.max("_last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_whole") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
        F.max(F.when(verified, share)).alias("score"),
    )
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), once(_words(F.col("text"))).alias("w"))
    each = each.select("doc_id", "text_hash", F.when(F.col("w")[0] == "", F.lit(0)).otherwise(F.size("w")).cast("long").alias("n_words"))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return each.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _rows(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> str:
    out = []
    for n, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = words_of(text)
        out += [f"({n}, {str(n < len(phrases)).lower()}, '{label}', {len(words) - K + 1}, {at}, '{words[at]}', '{words[at + 1]}', '{words[at + 2]}')" for at in range(len(words) - K + 1)]
    return ", ".join(out)


ORACLE = {
    "op8_license_scan": rf"""
with t(template, is_phrase, label, grams, spot, t0, t1, t2) as (values {_rows()}),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, unnest(range(0, len(w) - 2)) as pos from w where len(w) > 2),
h as (select doc_id, template, is_phrase, label, grams, pos - spot as diagonal, spot from p join t on w[pos + 1] = t0 and w[pos + 2] = t1 and w[pos + 3] = t2),
v as (select doc_id, template, is_phrase, label, grams, diagonal, count(*) as votes, list(spot) as ats from h group by all),
f as (select *, coalesce(cast(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {DRIFT} as int), 1) as fresh from v),
s as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as span from f),
m as (select doc_id, template, is_phrase, label, grams, span, len(list_distinct(flatten(list(ats)))) / any_value(grams) as share, count(*) filter (is_phrase and votes = grams) as n_whole,
    min(diagonal) filter (is_phrase and votes = grams) as first_at, max(diagonal) filter (is_phrase and votes = grams) as last_at from s group by all),
d as (select doc_id, cast(sum(n_whole) as bigint) as n_base, min(first_at) as first_word, max(last_at) as last_word,
    coalesce(array_to_string(list_sort(list(distinct label) filter (n_whole > 0)), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list(distinct label) filter (n_whole > 0 or (not is_phrase and share >= {COVERED}))), ','), '') as labels,
    max(share) filter (n_whole > 0 or (not is_phrase and share >= {COVERED})) as score from m group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from w left join d using (doc_id)
"""
}
QUERIES = {"op8_license_scan": op8_license_scan}
