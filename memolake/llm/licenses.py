"""License scans by diagonal voting (operator 9): DataFrame functions only.

Each text is brought to words parted by one blank. All its k-gram hashes are joined to the positions at which the
templates have them; the templates are constants of this module, so that side is broadcast. A hit at word p that the
template has at word t votes for the diagonal p - t. Votes are summed per (document, template, diagonal). A diagonal that
no other within ``drift`` words outvotes is an anchor, and merges those neighbours (words were put in or left out), so a
span never drifts further, and never takes more of the text than the template's length and the drift. The span is then
verified on that stretch of text: k-grams compared as text, and not only as hashes, count as far as they rise in the text
and in the template together, and must cover enough of the template,
and enough of what tells it from others: its k-grams with the version's number, and those that a template of another label,
which has much of its text, lacks. So a notice of another version, or of another license of a family, isn't labelled.

A document's rows never meet before the votes: only hits and one sentinel row per document are shuffled.

Defined results: null text counts as empty; a document without words has no labels and score 0; null or repeated
doc_ids are kept apart, row for row; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm.common import table

K = 3
#: Diagonals at most so many words from an anchor are of its span; a span proves at least this share of a template.
DRIFT, COVER = 4, 0.6
#: Templates of other labels that have such a share of a template are its siblings; a span proves such a share of what tells.
SIBLING, TELL = COVER, 0.75

#: Phrases that name a license, and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The usual wording of notices, grants and whole short licenses, and labels.
TEXTS = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License version 2"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS"""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation"""),
    ("agpl", """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
TEMPLATES = [(label, " ".join(re.findall("[0-9a-z]+", text.lower()))) for label, text in TEXTS]


def grams_of(text: str, k: int = K) -> list[str]:
    w = text.split(" ")
    return [" ".join(w[t : t + k]) for t in range(len(w) - k + 1)]


def telling(n: int, templates=TEMPLATES, k: int = K) -> set[str]:
    """The k-grams of a template that tell it from others."""
    label, text = templates[n]
    own = set(grams_of(text, k))
    version = re.search(r"-(\d+)\.\d+$", label)
    found = {g for g in own if version and version[1] in g.split(" ")}
    for other, sibling in templates:
        theirs = own & set(grams_of(sibling, k))
        if other != label and len(theirs) >= SIBLING * len(own):
            found |= own - theirs
    return found


def plain_words(text: Column) -> Column:
    """Words of lower-case text, one blank between them. A-Z are word characters before they are lowered; the two
    letters outside ASCII that Unicode lowers into ASCII are kept out of it."""
    apart = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    for letter in ("\u212a", "\u0130"):
        apart = F.replace(apart, F.lit(letter), F.lit("ç"))
    return F.lower(apart)


def blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def grams(words: str, k: int = K) -> Column:
    pattern = r"(?<![^ ])(?=(" + " ".join(["[^ ]+"] * k) + r")(?![^ ]))"
    return F.regexp_extract_all(F.col(words), F.lit(pattern), F.lit(1))


def template_rows(templates=TEMPLATES, k: int = K) -> list[tuple]:
    """(template, label, its k-grams, its telling ones, place, k-gram, whether that tells)."""
    rows = []
    for n, (label, text) in enumerate(templates):
        tell, found = telling(n, templates, k), grams_of(text, k)
        rows += [(n, label, len(found), sum(g in tell for g in found), t, g, g in tell) for t, g in enumerate(found)]
    return rows


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, of_grams, of_telling, t, t_gram, tells, t_hash); template -1 is the sentinel, whose k-gram is empty."""
    rows = [(-1, "", 0, 0, 0, "", False), *template_rows(templates, k)]
    return spark.createDataFrame(rows, "template int, label string, of_grams int, of_telling int, t int, t_gram string, tells boolean").withColumn("t_hash", F.xxhash64("t_gram"))


def licensed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    spark = docs.sparkSession
    any_phrase = "(?<![^ ])(?:" + "|".join(PHRASES) + ")(?![^ ])"
    base = docs.select(F.col(doc_id).alias("doc_id"), plain_words(F.col(text)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    has = F.regexp_count("words", F.lit(any_phrase))
    base = base.withColumn("n_base", has.cast("long"))
    found = F.col("n_base") > 0
    # (?s): U+0085, U+2028 and U+2029 are word characters here.
    facts = base.select(
        "row", "doc_id", "n_base",
        F.when(F.col("words") == "", F.lit(0)).otherwise(blanks(F.col("words")) + 1).cast("long").alias("n_words"),
        F.when(found, blanks(F.regexp_extract("words", f"(?s)^(.*?){any_phrase}", 1))).alias("first_word"),
        F.when(found, blanks(F.regexp_extract("words", f"(?s)^(.*){any_phrase}", 1))).alias("last_word"),
        F.when(found, F.array_compact(F.array(*[F.when(F.col("words").rlike(f"(?<![^ ]){p}(?![^ ])"), F.lit(x)) for p, x in PHRASES.items()]))).otherwise(F.array().cast("array<string>")).alias("base"),
        F.concat(F.array(F.lit("")), grams("words")).alias("grams"),
    )
    about = F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base")
    hits = facts.select("row", about.alias("about"), F.posexplode("grams").alias("p", "gram"))
    wanted = F.broadcast(template_grams(spark))  # constants of this module
    hits = hits.join(wanted, F.xxhash64("gram") == F.col("t_hash")).where(F.col("gram") == F.col("t_gram"))
    # The sentinel, at place 0 before all k-grams, stays by itself: it has the document's facts, the hits don't need them.
    sentinel = F.col("template") == -1
    votes = hits.groupBy("row", "template", (F.col("p") - 1 - F.col("t")).alias("diagonal")).agg(
        F.first(F.when(sentinel, F.col("about")), ignorenulls=True).alias("about"), F.first("label").alias("label"), F.first("of_grams").alias("of_grams"), F.first("of_telling").alias("of_telling"),
        F.collect_set(F.struct("t", "tells")).alias("ts"),
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-drift, drift)
    strength = F.struct(F.size("ts").alias("n"), (-F.col("diagonal")).alias("d"))
    anchors = votes.withColumn("near", F.collect_list(F.struct("diagonal", "ts")).over(near)).withColumn("most", F.max(strength).over(near)).where(strength == F.col("most"))
    places = F.array_sort(F.flatten(F.transform("near", lambda x: F.transform(x["ts"], lambda y: F.struct((y["t"] + x["diagonal"]).alias("p"), y["t"].alias("t"), y["tells"].cast("int").alias("tells"))))))
    # Of the k-grams in the order of the text, those that stand later in the template than all before.
    none = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("told"))
    rising = F.aggregate(places, none, lambda s, x: F.when(x["t"] > s["last"], F.struct(x["t"].alias("last"), (s["n"] + 1).alias("n"), (s["told"] + x["tells"]).alias("told"))).otherwise(s))
    spans = anchors.select("row", "template", "about", "label", "of_telling", "of_grams", rising.alias("up"))
    spans = spans.select("row", "template", "about", "label", (F.col("up.n") / F.greatest("of_grams", F.lit(1))).alias("cover"), (F.col("up.told") >= TELL * F.col("of_telling")).alias("tells"))
    good = (F.col("template") >= 0) & (F.col("cover") >= cover) & F.col("tells")
    out = spans.groupBy("row").agg(
        F.first("about", ignorenulls=True).alias("about"),
        F.collect_set(F.when(good, F.col("label"))).alias("own"),
        F.max(F.when(good, F.col("cover")).otherwise(F.lit(0.0))).alias("cover"),
    )
    return out.select(
        "about.doc_id", "about.n_words", "about.n_base", "about.first_word", "about.last_word",
        F.array_join(F.array_sort("about.base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("about.base", "own")), ",").alias("labels"),
        F.when(F.col("about.n_base") > 0, F.lit(1.0)).otherwise(F.least(F.col("cover"), F.lit(1.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _values() -> str:
    return ", ".join(f"({n}, '{label}', {of}, {of_telling}, {t}, '{g}', {tells})" for n, label, of, of_telling, t, g, tells in template_rows())


OP9_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
words AS (SELECT r, doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM docs),
places AS (SELECT r, u.i - 1 AS p, w[u.i:u.i+3] AS four FROM words, unnest(range(1, len(w) + 1)) AS u(i)),
named AS (SELECT r, p, CASE WHEN array_to_string(four, ' ') = 'gnu general public license' THEN 'gpl'
    WHEN array_to_string(four[1:2], ' ') = 'apache license' THEN 'apache' WHEN array_to_string(four[1:2], ' ') = 'cc by' THEN 'cc-by'
    WHEN array_to_string(four[1:2], ' ') = 'mit license' THEN 'mit' END AS x FROM places),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list(DISTINCT x)) AS b FROM named WHERE x IS NOT NULL GROUP BY r),
tpl(template, label, of_grams, of_telling, t, gram, tells) AS (VALUES {_values()}),
votes AS (SELECT DISTINCT r, template, label, of_grams, of_telling, p - t AS d, t, tells FROM places JOIN tpl ON len(four) >= 3 AND array_to_string(four[1:3], ' ') = gram),
strength AS (SELECT r, template, label, of_grams, of_telling, d, count(*) * 1000000000 - d AS n FROM votes GROUP BY r, template, label, of_grams, of_telling, d),
anchors AS (SELECT r, template, label, of_grams, of_telling, d AS anchor FROM (
  SELECT *, max(n) OVER (PARTITION BY r, template ORDER BY d RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING) AS most FROM strength) WHERE n = most),
rising AS (SELECT a.*, v.tells, v.t > coalesce(max(v.t) OVER (PARTITION BY a.r, a.template, anchor ORDER BY v.d + v.t, v.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS up
  FROM anchors a JOIN votes v ON v.r = a.r AND v.template = a.template AND v.d BETWEEN anchor - {DRIFT} AND anchor + {DRIFT}),
spans AS (SELECT r, label, count(*) FILTER (up) / any_value(of_grams)::DOUBLE AS cover, count(*) FILTER (up AND tells) >= {TELL} * any_value(of_telling) AS tells FROM rising GROUP BY r, template, label, anchor),
own AS (SELECT r, list(DISTINCT label) AS o, max(cover) AS cover FROM spans WHERE cover >= {COVER} AND tells GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(o, [])))), ','), '') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE least(coalesce(cover, 0.0), 1.0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""
