"""License scan: an exact set-similarity join of text blocks with notice templates.

DataFrame functions only. A template is the set T of its distinct words; its blocks are the
windows of consecutive words of a text, as long as the template divided by the threshold,
wherever lines or paragraphs break. A block contains the template when it holds at least
c = ceil(threshold * |T|) of its words.

One scan over the texts finds the base phrases, the template words that each text holds, and,
for the few texts that hold c words of some template at all, the places of these words.
Document frequencies over the whole corpus then put all template words in one global order,
rarest first. The places are laid out in tiles that overlap by the longest window, so each
block lies in a tile. A tile is the sorted set B of its template words, and it is joined with
the templates by an inverted index under three filters:

- prefix: B must hold one of the |T| - c + 1 rarest words of T;
- length: B must have c words or more;
- position: with their first common word at place p of T and q of B, at most
  min(|T| - p, |B| - q) words are common, and this must reach c.

Only pairs that pass have their windows measured. The templates are a parameter, their index
is broadcast where Spark finds it small; what is shuffled are word places of the texts that
hold enough template words, and no text is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import materialize, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what stands between words

#: The phrases that label a text wherever their words follow each other.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices of public licences, short and in full, under labels of their own.
TEMPLATES = {
    "notice-mit": "Released under the MIT License",
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0",
    "notice-gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "notice-lgpl": "licensed under the GNU Lesser General Public License",
    "notice-agpl": "licensed under the GNU Affero General Public License",
    "notice-mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "notice-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "notice-cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "notice-cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "notice-cc0": "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication",
    "notice-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "notice-all-rights-reserved": "All rights reserved",
    "text-mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "text-apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "text-gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    "text-bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
    "text-isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
}


def _words(text: Column) -> Column:
    """A text's words with one blank around each: lower case A-Z, gaps made blank."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _places(words: Column, phrase: str) -> dict[str, Column]:
    """How often a phrase stands in the blank-separated words, and its first and last start."""
    parts = F.split(words, f"(?<= ){phrase}(?= )")
    count_words = lambda s: F.size(F.filter(F.split(s, " "), lambda w: w != ""))
    n = F.size(parts) - 1
    return {
        "n": n,
        "first": F.when(n > 0, count_words(F.get(parts, F.lit(0)))),
        "last": F.when(n > 0, count_words(words) - count_words(F.element_at(parts, -1)) - len(phrase.split())),
    }


def shapes(templates: dict[str, str], threshold: float) -> dict[str, dict]:
    """need (c), words (T) and window of each template that has words."""
    out = {}
    for label, text in templates.items():
        said = template_words(text)
        if said:
            own = sorted(set(said))
            out[label] = {"words": own, "need": max(1, math.ceil(threshold * len(own) - 1e-9)), "window": max(len(said), math.floor(len(said) / threshold + 1e-9))}
    return out


def scan(docs: DataFrame, shaped: dict[str, dict], phrases=None) -> DataFrame:
    """docs (doc_id, text) as (row, doc_id, n_words, base_, held, hits), without the text.

    base_ tells of the phrases, held are the distinct template words of the text, and hits
    their places (pos, word) where the text holds the words that some template needs.
    """
    phrases = phrases or PHRASES
    vocabulary = sorted({w for t in shaped.values() for w in t["words"]})
    spaced = docs.select("doc_id", _words(F.col("text")).alias("words_"))
    n_words = F.when(F.col("words_") == "  ", 0).otherwise(F.length("words_") - F.length(F.replace("words_", F.lit(" "), F.lit(""))) - 1)
    some = F.lit(False)
    for phrase, _ in phrases:
        some = some | F.contains("words_", F.lit(f" {phrase} "))
    found = [_places(F.col("words_"), phrase) for phrase, _ in phrases]
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(p["n"] > 0, F.lit(label)) for p, (_, label) in zip(found, phrases, strict=True))), lambda x: x.isNotNull())))
    base = F.when(
        some,
        F.struct(
            sum((p["n"] for p in found[1:]), found[0]["n"]).alias("n"), F.least(*(p["first"] for p in found)).alias("first"),
            F.greatest(*(p["last"] for p in found)).alias("last"), labels.alias("labels"),
        ),
    )
    all_ = F.split(F.btrim("words_"), " ")
    known = lambda w: w.isin(vocabulary)
    told = spaced.select("doc_id", n_words.cast("long").alias("n_words"), base.alias("base_"), all_.alias("all_"), F.array_distinct(F.filter(all_, known)).alias("held"))
    enough = F.lit(False)
    for t in shaped.values():
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, t["words"])))) >= t["need"])
    places = F.transform("all_", lambda w, i: F.when(known(w), F.struct(i.alias("pos"), w.alias("word"))))
    hits = F.when(enough, F.filter(places, lambda x: x.isNotNull()))
    return told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "base_", "held", hits.alias("hits"))


def ordered_words(scanned: DataFrame) -> list[str]:
    """The template words that occur, by document frequency over the whole corpus, rarest first."""
    counted = scanned.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in sorted(counted.collect(), key=lambda r: (r["n"], r["word"]))]  # no more than the templates' words


def postings(spark: SparkSession, shaped: dict[str, dict], order: list[str]) -> DataFrame:
    """(rank, p, label, need, size, window, words) of each prefix word; words that no text holds come first and have no posting."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, t in shaped.items():
        own = sorted((rank.get(w, -1) for w in t["words"]))
        for p, r in enumerate(own[: len(own) - t["need"] + 1]):
            if r >= 0:
                rows.append((r, p, label, t["need"], len(own), t["window"], [x for x in own if x >= 0]))
    return spark.createDataFrame(rows, "rank int, p int, label string, need int, size int, window int, words array<int>")


def tiles(scanned: DataFrame, order: list[str], step: int) -> DataFrame:
    """(row, places, set): the places (pos, rank) of 2 * step words of a text, and their ranks in global order."""
    ranked = scanned.sparkSession.createDataFrame(list(enumerate(order)), "rank int, word string")
    hits = scanned.where(F.col("hits").isNotNull()).select("row", F.inline("hits")).join(F.broadcast(ranked), "word")
    at = (F.col("pos") / step).cast("int")
    dealt = hits.select("row", "pos", "rank", F.explode(F.array(at, at - 1)).alias("tile")).where("tile >= 0")
    made = dealt.groupBy("row", "tile").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("places"))
    return made.select("row", "places", F.array_sort(F.array_distinct(F.col("places.rank"))).alias("set"))


# The length and the positional filter on pairs.
LONG_ENOUGH = "size(set) >= need"
WELL_PLACED = "size - p >= need and size(set) - q >= need"


def prefix_pairs(tiled: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a tile and a template that share a prefix word, at their first common word (p, q)."""
    met = tiled.select("row", "places", "set", F.posexplode("set").alias("q", "rank")).join(F.broadcast(index), "rank")
    earlier = F.arrays_overlap(F.slice("words", F.lit(1), F.array_position("words", F.col("rank")).cast("int") - 1), F.slice("set", F.lit(1), F.col("q")))
    return met.where(~F.coalesce(earlier, F.lit(False)))


def containments(scanned: DataFrame, shaped: dict[str, dict]) -> DataFrame:
    """(row, label, score) of every text with a block that contains a template to the threshold."""
    order = ordered_words(scanned)
    tiled = tiles(scanned, order, max(t["window"] for t in shaped.values()))
    pairs = prefix_pairs(tiled, postings(scanned.sparkSession, shaped, order)).where(LONG_ENOUGH).where(WELL_PLACED)
    pairs = pairs.where(F.size(F.array_intersect("words", "set")) >= F.col("need"))
    own = pairs.withColumn("places", F.filter("places", lambda x: F.array_contains(F.col("words"), x["rank"])))
    # A best block begins at a common word; its others follow within the window.
    inside = lambda x, i: F.filter(F.slice(F.col("places"), i + 1, F.col("window")), lambda y: y["pos"] < x["pos"] + F.col("window"))
    common = F.array_max(F.transform("places", lambda x, i: F.size(F.array_distinct(F.transform(inside(x, i), lambda y: y["rank"])))))
    return own.withColumn("common", common).where("common >= need").select("row", "label", (F.col("common") / F.col("size")).alias("score"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """One row for each row of docs: words, base phrase places, labels and score.

    n_base counts the places where the words of a base phrase follow each other, first_word
    and last_word are their least and greatest start. labels adds the templates that a window
    of the text's words contains to the threshold; a notice that is part of another's text is
    labelled with it. score is 1 where a base phrase stands, else the largest containment, else 0.

    A null text is empty; a null doc_id is returned as null; repeated rows get the same answer;
    other columns are not read; long texts are scanned whole; an empty table gives an empty
    result. Without templates, or with templates without words, only the phrases label.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shaped = shapes(TEMPLATES if templates is None else templates, threshold)
    scanned = materialize(scan(plain, shaped), "scanned")
    none = F.array().cast("array<string>")
    if shaped:
        hits = containments(scanned, shaped).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
        answered = scanned.drop("held", "hits").join(hits, "row", "left")
    else:
        answered = scanned.withColumns({"found": none, "best": F.lit(0.0)})
    base_labels = F.coalesce("base_.labels", none)
    return answered.select(
        "doc_id",
        "n_words",
        F.coalesce("base_.n", F.lit(0)).cast("long").alias("n_base"),
        F.col("base_.first").cast("long").alias("first_word"),
        F.col("base_.last").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("base_.n") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
