"""License scans by diagonal voting.

All rolling k-word grams of every text are hashed and joined with the grams of
the templates. A hit at word i of the text and word j of a template votes for
the diagonal i - j, the place where the template would start. Votes are
aggregated by diagonal, neighbouring diagonals of one template are merged (an
inserted or missing word shifts the rest by one) as far as a share of the template's
length allows, and a merged span counts if it covers enough of the template. Every hit is confirmed on the words, so hash
collisions never vote. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import constant_rows, lower_ascii

K = 3
BITS = 63
NEIGHBOUR = 3
LEAST_COVER = 0.6
#: The diagonals of a span lie within this share of the template's grams, or within NEIGHBOUR.
DRIFT = 0.1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False


#: Phrases that count wherever they stand word for word.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Usual notices, as lower-case words.
NOTICES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
_NO_WARRANTY_BSD = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
#: Whole texts of short licenses and the boilerplate of long ones, as published, in lower-case words without the line of the owner.
LICENSES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
        "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template("bsd-2", f"{_BSD_TERMS} {_NO_WARRANTY_BSD}"),
    Template(
        "bsd-3",
        f"{_BSD_TERMS} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        f"permission {_NO_WARRANTY_BSD}",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not "
        "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source "
        "distribution",
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness "
        "for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org "
        "licenses",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means",
    ),
)


def license_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII; empty for a null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _template_grams(df: DataFrame, templates: Sequence[Template]) -> DataFrame:
    rows = []
    for number, t in enumerate(templates):
        split = t.text.split()
        if len(split) < K:
            raise ValueError(f"a template needs {K} words: {t.text!r}")
        rows += [(number, j, len(split) - K + 1, t.label, t.exact, " ".join(split[j : j + K])) for j in range(len(split) - K + 1)]
    return constant_rows(df.sparkSession, ["template", "j", "n_grams", "label", "exact", "gram"], rows).withColumn("hash", F.xxhash64("gram"))


def license_spans(docs: DataFrame, id_col: str, text_col: str, templates: Sequence[Template]) -> DataFrame:
    """(id, digest, label, exact, places, first_place, last_place, cover, start) for each verified span.

    ``digest`` is the text's xxhash64, so that rows which share an id but not their text stay apart.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (K - 1)), lambda i: F.concat_ws(" ", *(F.element_at("words", i + j) for j in range(K))))
    rolling = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), license_words(F.col(text_col)).alias("words"))
        .filter(F.size("words") >= K)
        .select("id", "digest", F.posexplode(grams).alias("i", "gram"))
        .withColumn("hash", F.xxhash64("gram"))
    )
    # The templates are a parameter: a few grams each, whatever the input.
    hits = rolling.join(F.broadcast(_template_grams(docs, templates)), ["hash", "gram"])
    # Which grams of its template a diagonal has, as bits: one mask for each BITS grams of the longest template.
    masks = [f"mask{m}" for m in range(-(-max(len(t.text.split()) - K + 1 for t in templates) // BITS))]
    votes = hits.groupBy("id", "digest", "template", "label", "exact", "n_grams", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        *(F.bit_or(F.expr(f"case when j div {BITS} = {m} then shiftleft(1L, cast(j % {BITS} as int)) else 0L end")).alias(c) for m, c in enumerate(masks))
    )
    there = sum((F.bit_count(c) for c in masks[1:]), F.bit_count(masks[0]))
    by_template = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    full = F.col("exact") & (there == F.col("n_grams"))
    run = Window.partitionBy("id", "digest", "template", "run")
    reach = F.greatest(F.lit(NEIGHBOUR), F.floor(F.col("n_grams") * DRIFT))
    merged = (
        votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by_template) > NEIGHBOUR).cast("int"))
        .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by_template))
        .withColumn("span", F.floor((F.col("diagonal") - F.min("diagonal").over(run)) / (reach + 1)))
        .groupBy("id", "digest", "template", "label", "exact", "n_grams", "run", "span")
        .agg(
            *(F.bit_or(c).alias(c) for c in masks),
            F.sum(full.cast("long")).alias("places"),
            F.min(F.when(full, F.col("diagonal"))).alias("first_place"),
            F.max(F.when(full, F.col("diagonal"))).alias("last_place"),
            F.min("diagonal").alias("start"),
        )
        .withColumn("cover", there / F.col("n_grams"))
    )
    return merged.filter((F.col("exact") & (F.col("places") > 0)) | (~F.col("exact") & (F.col("cover") >= LEAST_COVER)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = PHRASES + NOTICES + LICENSES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    Exact templates give ``n_base`` (all their places), the places' smallest and largest first
    word, and ``base_labels``; ``labels`` adds the notices and licenses. ``score`` is the best share of a
    template that one span covers, 0 without any. Null and empty texts have no words; very long texts
    count as a whole; repeated rows each get the same result; a null id is an id like any other, and
    ids may be strings; an empty table gives an empty one. Other columns of ``docs`` are left aside.
    """
    spans = license_spans(docs, id_col, text_col, templates)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  # at most one element for each label of the templates
    found = spans.groupBy("id", "digest").agg(
        F.sum("places").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_digest"), F.size(license_words(F.col(text_col))).cast("long").alias("n_words"))
    return rows.join(found, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")), "left").select(
        F.col("row_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
