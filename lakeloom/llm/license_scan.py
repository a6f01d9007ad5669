"""License scans by diagonal voting.

All rolling word 2-grams of a document are hashed. Hashes that occur in no template are dropped
inside the row (the templates are a fixed, small list); the rest are joined by Spark to the template
positions that hold the same gram, and the gram's words are compared, so a hash collision cannot
vote. Each match votes for its diagonal, document position minus template position. Votes are
counted by (document, template, diagonal), diagonals at most ``SLACK`` words apart are merged (a word
more or less moves a passage to the next diagonal), and a merged span is verified against the share
of the template that it covers: the most distinct template positions that one stretch of the document
holds. A stretch is as long as the template and ``SLACK`` grams for each break of a verified passage,
so grams that a text repeats count once and grams far apart do not add up. A phrase is a template whose single diagonal must hold every gram.

Defined results. Null or empty text: no words, no labels, null positions, score zero. Repeated rows
are scanned each on its own. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, shingle_hashes

GRAM = 2
SLACK = 3
#: Share of a notice's grams that a merged span has to cover.
COVERED = 0.9
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels they give.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Wording of public licence notices and the labels they give.
NOTICES = {
    "Released under the MIT License": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit-text",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl-text",
    "GNU Lesser General Public License": "lgpl",
    "GNU Affero General Public License": "agpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "Licensed under CC BY 4.0": "cc-by-4.0",
    "Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Boost Software License - Version 1.0": "bsl-1.0",
    # whole licence texts
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit-full",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-2-conditions",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "isc-full",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely": "zlib",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.": "apache-2.0",
}


def scan_words(text: Column) -> Column:
    """Letters, digits and non-ASCII runs of a text, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BREAKS, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def template_positions(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, grams, often, tpos, gram, h): a row for each gram of each template;
    often is the number of places of the template's commonest gram. Its size is that of the fixed lists
    above."""
    rows = []
    for k, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = template_words(text)
        grams = [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
        often = max(map(grams.count, grams))
        rows += [(k, label, k < len(PHRASES), len(grams), often, i, gram) for i, gram in enumerate(grams)]
    found = spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, often int, tpos int, gram string")
    return found.withColumn("h", F.get(shingle_hashes(F.split("gram", " "), GRAM), F.lit(0)))


def _scanned(words: Column, known: list[int]) -> Column:
    """Word count and the places whose gram hash some template holds, with the gram's words."""
    def hits(hashes: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda i: F.get(hashes, i).isin(known))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(hashes, i).alias("h"), F.array_join(F.slice(words, i + 1, GRAM), " ").alias("gram")))

    return F.struct(F.size(words).cast("long").alias("n_words"), let(shingle_hashes(words, GRAM), hits).alias("hits"))


def diagonals(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, label, phrase, grams, often, diagonal, votes, at), and a row
    with a null template for each document without votes. ``row`` numbers the input rows, ``at`` has
    the document positions of the votes."""
    templates = template_positions(docs.sparkSession)
    known = [r["h"] for r in templates.select("h").distinct().collect()]  # bounded by the fixed lists
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(scan_words(F.col("text")), lambda w: _scanned(w, known)).alias("s"))
    rows = rows.select("row", "doc_id", "s.n_words", F.explode_outer("s.hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    matched = rows.join(F.broadcast(templates), ["h", "gram"], "left").repartition("row")
    return matched.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "often", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("pos").alias("votes"), F.collect_list("pos").alias("at")
    )


def stretch_of(grams: Column) -> Column:
    """Words of a document that a verified span may take: a break costs at least a gram, so it has no
    more breaks than grams to miss; one more for a repeated word, which costs none."""
    return grams + SLACK * (F.floor(grams * (1 - COVERED) + 1e-9).cast("int") + 1)


def _covered(matches: Column, grams: Column, often: Column) -> Column:
    """Most distinct template positions in a stretch of the document. ``matches`` are sorted pairs
    (pos, tpos); a position of a document matches at most ``often`` positions of the template."""
    stretch = stretch_of(grams)

    def best(ms: Column) -> Column:
        def ahead(j: Column) -> Column:
            near = F.filter(F.slice(ms, j + 1, stretch * often), lambda x: x["pos"] < F.get(ms, j)["pos"] + stretch)
            return F.size(F.array_distinct(F.transform(near, lambda x: x["tpos"])))

        whole = F.size(F.array_distinct(F.transform(ms, lambda x: x["tpos"])))
        fits = F.element_at(ms, -1)["pos"] < F.get(ms, F.lit(0))["pos"] + stretch
        begins = F.filter(F.sequence(F.lit(0), F.size(ms) - 1), lambda j: F.coalesce(F.get(ms, j - 1)["pos"] < F.get(ms, j)["pos"], F.lit(True)))
        return F.when(fits, whole).otherwise(F.array_max(F.transform(begins, ahead)))

    return let(matches, best)


def spans(found: DataFrame) -> DataFrame:
    """Merged neighbouring diagonals with the share of the template that they cover, and the places
    of a phrase among them."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True)).cast("int")
    merged = found.withColumn("jump", jump).withColumn("span", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("phrase") & (F.col("votes") == F.col("grams")), F.col("diagonal"))
    pairs = F.transform("at", lambda p: F.struct(p.alias("pos"), (p - F.col("diagonal")).alias("tpos")))
    joined = merged.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "often", "span").agg(
        F.count(place).alias("places"),
        F.min(place).alias("first_place"),
        F.max(place).alias("last_place"),
        F.array_sort(F.flatten(F.collect_list(pairs))).alias("matches"),
    )
    return joined.withColumn("covered", F.when(F.col("template").isNotNull(), _covered(F.col("matches"), F.col("grams"), F.col("often")) / F.col("grams"))).drop("matches")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each document: places and labels of the phrases, labels of verified spans, score."""
    verified = spans(diagonals(docs))
    base = F.when(F.col("places") > 0, F.col("label"))
    own = F.when(F.coalesce(~F.col("phrase"), F.lit(False)) & (F.col("covered") >= COVERED), F.col("label"))
    sure = F.when(F.coalesce("phrase", F.lit(False)), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce("covered", F.lit(0.0)))
    found = verified.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"),
        F.collect_set(base).alias("by_phrase"),
        F.collect_set(own).alias("by_notice"),
        F.round(F.max(sure), 6).alias("score"),
    )
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("by_phrase"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("by_phrase", "by_notice")), ",").alias("labels"),
        "score",
    )
