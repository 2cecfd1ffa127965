"""License scan by diagonal voting.

Every rolling word pair of every text is joined with the places where license templates have it; a template's further
words decide which places match. Matches with the same offset of text and template lie on one diagonal. Votes of
neighbouring diagonals are merged, and spans with enough of a template are verified: its words are looked for in the
text one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Phrases that give the base labels, and count place by place.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of license texts and of the notices that refer to them, with the labels they add; 64 words each at most.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-copies": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-copies": "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-rights": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-limits": "see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-version": "either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl": "under the terms of the gnu affero general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-1.0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
}
#: Words of a rolling gram of templates; phrases have grams of two.
GRAM = 3
#: Diagonals at most so far apart are one span: words that the text adds to or lacks of the template.
SLACK = 3
#: Share of a template's grams that a span must have, and then of its words, found in their order.
VOTES, WORDS = 0.6, 0.75
_MARK = "\u0001"


def _templates() -> str:
    """SQL values: pair of words, third word or null, template, place in it, its grams, its words, whether a phrase."""
    rows = [(_MARK, "", None, "", 0, 1, 0, True)]
    for names, k, base in ((PHRASES, 2, True), (TEMPLATES, GRAM, False)):
        for a, b in names.items():
            text, label = (a, b) if base else (b, a)
            w = text.split()
            rows += [(w[i], w[i + 1], w[i + 2] if k == 3 else None, label, i, len(w) - k + 1, len(w), base) for i in range(len(w) - k + 1)]
    quote = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, a-z and characters beyond ASCII; none gives an empty array."""
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def _lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def votes(docs: DataFrame) -> DataFrame:
    """Matches of grams: a row for each place of a template's gram in a text, and a row with pos -1 for each text.

    The templates are constants of this module, some hundred grams, and so their side of the join is broadcast.
    """
    spark = docs.sparkSession
    grams = spark.sql(f"select xxhash64(a, b) as gram, c as third, label, place, grams, n as length, base from values {_templates()} as t(a, b, c, label, place, grams, n, base)")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A mark before the words, so that every text has a match to be counted by.
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(F.array(F.lit(_MARK), F.lit("")), words(F.col("text"))).alias("w"))
    each = rows.select("doc_id", "row", "w", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c"))).alias("pos", "g"))
    each = each.withColumns({"gram": F.xxhash64(F.lower("g.a"), F.lower("g.b")), "next": F.col("g.c")})
    hit = each.join(F.broadcast(grams), (each["gram"] == grams["gram"]) & (F.col("third").isNull() | (F.col("third") == F.lower("next"))))
    pos = F.col("pos") - 2
    near = F.when(~F.col("base"), F.transform(F.slice("w", F.greatest(F.lit(3), pos + 3 - F.col("place") - SLACK), F.col("length") + 2 * SLACK), _lower))
    return hit.select("doc_id", "row", F.size("w").alias("n"), pos.cast("long").alias("pos"), "label", "base", F.col("place").cast("long").alias("place"), "grams", F.col("length").cast("long").alias("length"), near.alias("near"))


def in_order(template: Column, near: Column) -> Column:
    """Words of ``template`` that are found in ``near`` one after the other, each a few words on from the last found."""

    def step(acc: Column, word: Column) -> Column:
        ahead = F.array_position(F.slice(near, acc["at"] + 1, 2 * SLACK + 1), word).cast("int")
        return F.struct((acc["at"] + ahead).alias("at"), (acc["same"] + (ahead > 0).cast("int")).alias("same"))

    return F.aggregate(template, F.struct(F.lit(0).alias("at"), F.lit(0).alias("same")), step)["same"]


def spans(hits: DataFrame) -> DataFrame:
    """Verified spans: row, label, base, start, stop, coverage."""
    at = hits.where(F.col("label") != "").withColumn("diagonal", F.col("pos") - F.col("place"))
    by = ["row", "label", "base", "grams", "length"]
    seen = F.bit_or(F.expr("shiftleft(1L, cast(place as int))"))
    each = at.groupBy(*by, "diagonal").agg(seen.alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("near", "pos").alias("near"))
    order = Window.partitionBy("row", "label", "base").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    each = each.withColumn("island", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = each.groupBy(*by, "island").agg(
        F.bit_or("seen").alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("diagonal"),
        F.max_by("near", F.struct(F.bit_count("seen"), -F.col("diagonal"))).alias("near"),
    )
    share = F.bit_count("seen") / F.col("grams")
    values = ", ".join(f"('{label}', split('{text}', ' '))" for label, text in TEMPLATES.items())
    merged = merged.join(F.broadcast(hits.sparkSession.sql(f"select * from values {values} as t(label, template)")), "label", "left")
    known = in_order(F.col("template"), F.col("near")) / F.size("template")
    merged = merged.withColumn("coverage", F.when(F.col("base"), share).otherwise(F.least(share, known)))
    good = F.when(F.col("base"), share == 1).otherwise((share >= VOTES) & (known >= WORDS))
    start = F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("first"))
    stop = F.when(F.col("base"), F.col("diagonal") + F.col("length")).otherwise(F.col("last") + GRAM)
    return merged.where(good).select("row", "label", "base", start.alias("start"), stop.alias("stop"), "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """Licenses of each document (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base label needs a phrase's words one after the other, and every place counts; a template's label needs a
    verified span. The score is the best coverage. A null text is empty: no words, no labels (empty strings), score 0.
    Each row stands for itself, repeated or not, by a number that is written with its matches; other columns are
    ignored; an empty table gives an empty result. Only matches are shuffled, first summed where they are found.
    """
    hits = written(votes(docs.select("doc_id", "text")), "license-votes")
    every = hits.where(F.col("label") == "").select("doc_id", "row", (F.col("n") - 2).cast("long").alias("n_words"))
    found = spans(hits).groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    out = every.join(found, "row", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))
