"""License scans by diagonal voting, of DataFrame expressions alone.

The hashes of all runs of K words of each text are joined with those of the
templates. A match votes for a diagonal, the place in the text less the place in
the template; the template places that it covers are bits, so that repeated votes for
a place count once. Diagonals up to BAND apart are merged, since words put in
or left out shift the rest, and a span stands where the merged ones cover enough of
the template's places. Texts are never shuffled: matches are, and a row for each document.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import FEW

# What parts words, once A-Z are lowered; the base phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Words in a run, words that diagonals of one span may lie apart, and the least share of a template's runs that a span covers.
K, BAND, LEAST_SHARE = 4, 4, 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str


# Notices of public licenses.
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Licensed under the MIT License"),
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def words_of(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits and of all other than ASCII characters; A-Z are lowered, null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _runs(words: Column, k: int) -> Column:
    """(place, hash) of each run of k words."""
    run = lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.element_at(words, i + (j + 1)) for j in range(k)]).alias("h"))
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), run)).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))


def phrase_places(words: Column, phrase: str) -> Column:
    """The places, from 0, where the words of a phrase stand; only where the text has them all are places tried."""
    parts = phrase.split(" ")
    stands = lambda i: reduce(lambda a, b: a & b, [F.element_at(words, i + (j + 1)) == p for j, p in enumerate(parts)])
    has_all = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in dict.fromkeys(parts)])
    return F.when(has_all & (F.size(words) >= len(parts)), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)).otherwise(F.array().cast("array<int>"))


def template_table(spark: SparkSession, templates: Sequence[Template], k: int = K) -> DataFrame:
    """A row (h, place, template) for each run of words of the templates; ``template`` has no, label, n_words and n_runs.

    A template of under k words has no run, and so is never found.
    """
    rows = spark.createDataFrame([(no, t.label, t.text) for no, t in enumerate(templates)], "no int, label string, text string").withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    template = F.struct("no", "label", n.alias("n_words"), (n - (k - 1)).alias("n_runs")).alias("template")
    return rows.select(template, F.explode(_runs(F.col("words"), k)).alias("r")).select(F.col("r.h").alias("h"), F.col("r.at").alias("place"), "template")


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: Sequence[Template] = TEMPLATES, phrases=PHRASES, k: int = K, band: int = BAND, least_share: float = LEAST_SHARE) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with n_words, n_base, first_word, last_word,
    base_labels, labels, score and spans.

    ``base_labels``: labels of the phrases that the text has, with the number of
    places and the first and last of them beside (null without any). ``spans``: no and
    label of a template, its first and last word in the text, from 0, and the share of
    its runs of k words there, ``least_share`` at least, in the order of the text; of merged
    diagonals the best, of equal ones the first. ``labels``: both kinds, distinct
    and sorted. ``score``: 1 for a text with a phrase, else the greatest share of any
    template that merged diagonals cover, be it too small for a span.

    A null text has no words, nor has an empty one. Rows are scanned each for itself, repeated ones
    alike, texts of any length whole; an empty table gives one, and columns of
    any name may be kept. Templates of up to FEW runs are broadcast, more are joined by
    their hashes. Rows are read once and numbered in the order of the input: of one
    whose order changes from read to read, keep a table first.
    """
    known = template_table(docs.sparkSession, templates, k)
    if sum(len(t.text) for t in templates) // 2 <= FEW:  # a word and what parts it from the next have two characters at least
        known = F.broadcast(known)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), words_of(F.col(f"`{text}`")).alias("words"))
    df = df.withColumn("places", F.array(*[phrase_places(F.col("words"), p) for _, p in phrases]))
    every = F.flatten("places")
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (label, _) in enumerate(phrases)]))))
    long = lambda c: c.cast("bigint")
    head = F.struct("row", long(F.size("words")).alias("n_words"), long(F.size(every)).alias("n_base"), long(F.array_min(every)).alias("first_word"), long(F.array_max(every)).alias("last_word"), labels.alias("base_labels"))
    df = df.select(F.monotonically_increasing_id().alias("rid"), head.alias("head"), _runs(F.col("words"), k).alias("runs"))
    # The row itself is one more element, so that it is not repeated beside each run.
    first = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("h"), F.col("head").alias("head")))
    others = F.transform("runs", lambda r: F.struct(r["at"].alias("at"), r["h"].alias("h"), F.lit(None).cast(df.schema["head"].dataType).alias("head")))
    df = df.select("rid", F.explode(F.concat(first, others)).alias("e")).select("rid", F.col("e.at").alias("at"), F.col("e.h").alias("h"), F.col("e.head").alias("head"))
    votes = df.join(known, "h", "left").where((F.col("at") < 0) | F.col("place").isNotNull())

    carried = F.first("head", ignorenulls=True).alias("head")
    part = F.floor(F.col("place") / 64)
    bit = F.expr("shiftleft(1L, place % 64)")
    votes = votes.groupBy("rid", "template", (F.col("at") - F.col("place")).alias("diagonal"), part.alias("part")).agg(carried, F.bit_or(bit).alias("bits"), F.min("at").alias("low"), F.max("at").alias("high"))
    votes = votes.repartition("rid")  # all that follows keeps this partitioning
    near = F.when(F.col("diagonal").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.col("diagonal") - band, F.col("diagonal") + band))
    merged = votes.withColumn("anchor", F.explode(near)).groupBy("rid", "template", "anchor", "part")
    merged = merged.agg(carried, F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("diagonal") == F.col("anchor")).alias("own"))
    merged = merged.groupBy("rid", "template", "anchor").agg(carried, F.sum(F.bit_count("bits")).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("own").alias("own"))
    share = F.col("n") / F.col("template.n_runs")
    merged = merged.where(F.col("anchor").isNull() | F.col("own")).withColumn("share", share)
    # Diagonals that cover too little are of use for the score only: of each template one row of them stays.
    strong = F.when(F.col("share") >= least_share, F.col("anchor"))
    merged = merged.groupBy("rid", "template", strong.alias("anchor")).agg(carried, F.max(F.struct("share", (-F.col("anchor")).alias("before"), "low", "high")).alias("best"))
    by = "partition by rid, template order by anchor"
    apart = F.coalesce(F.expr(f"anchor - lag(anchor) over ({by})") > F.expr(f"least({2 * band}, template.n_words div 2)"), F.lit(True))
    merged = merged.withColumn("apart", apart.cast("int")).withColumn("island", F.expr(f"sum(apart) over ({by} rows unbounded preceding)"))
    merged = merged.groupBy("rid", "template", "island").agg(carried, F.max("best").alias("best"), F.max(F.col("anchor").isNotNull()).alias("strong"))
    span = F.struct(F.col("best.low").alias("first"), (F.col("best.high") + (k - 1)).alias("last"), F.col("template.no").alias("no"), F.col("template.label").alias("label"), F.col("best.share").alias("share"))
    found = merged.groupBy("rid").agg(carried, F.max("best.share").alias("share"), F.array_sort(F.collect_list(F.when(F.col("strong"), span))).alias("spans"))
    all_labels = F.array_sort(F.array_distinct(F.concat("head.base_labels", F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.col("head.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return found.select("head.row", "head.n_words", "head.n_base", "head.first_word", "head.last_word", "head.base_labels", all_labels.alias("labels"), score.alias("score"), "spans")
