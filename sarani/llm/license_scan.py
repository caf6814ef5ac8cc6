"""License scans by diagonal voting, native DataFrame operations only.

Rolling word k-gram hashes of every text join the places of the same k-grams in the
templates: pairs of words for short phrases, four words for whole texts. A common k-gram votes
for the diagonal (place in the text minus place in the template). Votes of one diagonal are
aggregated as bits, neighbouring diagonals are merged, so that inserted or lost words do
not break a match, and merged spans are verified by the part of the template they cover and
by their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from sarani.session import BROADCAST_ROWS

SHORT_GRAM, LONG_GRAM = 2, 4  # words of a k-gram
SHORT = 40  # templates of fewer words vote by pairs
NEAR = 2  # diagonals at most so far apart are merged
LEAST_COVER = 0.6  # part of a long template's k-grams that a span must hold
MOST_LENGTH = 1.5  # times the template's length that a span may have
_BITS = 64

# Phrases with their labels. A base phrase counts where it stands complete.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Texts of the method's own labels, lines first, then the whole texts of public
# licenses and of their notices; parts of them count too.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the apache license version 2 0": "apache-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
    and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
    PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit-full",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
    PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
    OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
    CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE.""": "isc-full",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
    THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd-full",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission.""": "bsd-3-clause",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
    liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
    for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
    following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
    the original software. If you use this software in a product, an acknowledgment in the product documentation would be
    appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
    misrepresented as being the original software. 3. This notice may not be removed or altered from any source
    distribution.""": "zlib-full",
    """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
    and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
    Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
    statement, including the above license grant, this restriction and the following disclaimer, must be included in all
    copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
    works are solely in the form of machine-executable object code generated by a source language processor.""": "boost-full",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
    of this software dedicate any and all copyright interest in the software to the public domain. We make this
    dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
    dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
    copyright law.""": "unlicense-full",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
    governing permissions and limitations under the License.""": "apache-header",
    """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details.""": "gpl-header",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
    Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
    later version.""": "lgpl-header",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
    Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
    later version.""": "agpl-header",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""": "mpl-header",
    """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license,
    visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA
    94042, USA.""": "cc-by-header",
    """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
    """: "cc0-header",
}


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, A-Z in lower case.

    Only the two letters whose lower case falls into ASCII could make other text equal to an
    ASCII word; they are replaced first. Other letters stay above ASCII in lower case, so
    words keep their bounds, and no ASCII word is won or lost.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ķ")), F.lit("İ"), F.lit("ı"))
    parts = F.split(F.lower(safe), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def template_words(phrase: str) -> list[str]:
    """The words of a template, which is ASCII."""
    if not phrase.isascii():
        raise ValueError(f"a template is ASCII text: {phrase}")
    held = re.findall("[a-z0-9]+", phrase.lower())
    if len(held) < SHORT_GRAM:
        raise ValueError(f"a template has {SHORT_GRAM} words or more: {phrase}")
    return held


def gram_size(held: list[str]) -> int:
    return SHORT_GRAM if len(held) < SHORT else LONG_GRAM


def template_places(spark, phrases: dict[str, str], base: bool) -> DataFrame:
    """template, label, is_base, k, grams, at, gram (its words): one row per k-gram of each template."""
    rows = []
    for phrase, label in phrases.items():
        held = template_words(phrase)
        k = gram_size(held)
        rows += [(" ".join(held), label, base, k, len(held) - k + 1, i, held[i : i + k]) for i in range(len(held) - k + 1)]
    return spark.createDataFrame(rows, "template string, label string, is_base boolean, k int, grams int, at int, gram_words array<string>")


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, texts: dict[str, str] | None = None,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    n_base counts the places of complete base phrases, first_word and last_word are their
    smallest and largest start; base_labels and labels are sorted and joined by commas, empty
    if none. score is 1 for a base phrase, else the largest covered part of a long text, 0
    without a match. Null and empty texts have no words. Repeated and null ids give a row per
    row. Templates have any length; they are broadcast if they are few enough. Other columns
    are not read.
    """
    spark = docs.sparkSession
    base, texts = BASE if base is None else base, TEXTS if texts is None else texts
    templates = template_places(spark, base, True).unionByName(template_places(spark, texts, False))
    templates = templates.withColumn("gram", F.xxhash64("gram_words"))
    longest = max((len(template_words(p)) for p in [*base, *texts]), default=1)
    votes = [f"v{j}" for j in range(-(-longest // _BITS))]
    if sum(len(template_words(p)) for p in [*base, *texts]) <= BROADCAST_ROWS:
        templates = F.broadcast(templates)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), words(body).alias("words")).withColumn("row", F.monotonically_increasing_id())
    # The last words pair with null; so each text with words has a row at place 0.
    shifted = lambda n: F.slice("words", n + 1, F.greatest(F.size("words"), F.lit(1)))
    letters = "abcd"
    opened = cut.select(
        "row", "doc_id", F.size("words").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), *[shifted(i).alias(c) for i, c in enumerate(letters[1:], 1)])).alias("place", "w"),
    )
    whole = lambda k: F.array(*[F.col(f"w.{c}") for c in letters[:k]])
    some = lambda k: F.when(F.col(f"w.{letters[k - 1]}").isNotNull(), F.xxhash64(whole(k)))
    each = F.array(*[F.struct(F.lit(k).alias("k"), some(k).alias("gram"), whole(k).alias("own")) for k in (SHORT_GRAM, LONG_GRAM)])
    grams = opened.select("row", "doc_id", "n_words", "place", F.inline(each))
    met = grams.join(templates, ["k", "gram"], "left")
    met = met.withColumn("hit", F.coalesce(F.col("own") == F.col("gram_words"), F.lit(False)))
    met = met.where(f"hit OR (k = {SHORT_GRAM} AND (place = 0 OR place IS NULL))")

    owner = ["row", "doc_id", "n_words"]
    bit = lambda j: F.when(F.col("hit") & (F.floor(F.col("at") / _BITS) == j), F.expr(f"shiftleft(1L, at % {_BITS})"))
    diagonals = met.groupBy(*owner, F.when(F.col("hit"), F.col("template")).alias("template"), F.when(F.col("hit"), F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("grams").alias("grams"), F.first("k").alias("k"),
        *[F.bit_or(bit(j)).alias(v) for j, v in enumerate(votes)], F.min("place").alias("low"), F.max("place").alias("high"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    marked = diagonals.withColumn("opens", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("int"))
    merged = marked.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = lambda of: sum((F.coalesce(F.bit_count(of(v)), F.lit(0)) for v in votes), F.lit(0))
    cover = counted(F.col) / F.col("grams")
    spans = merged.groupBy(*owner, "template", "span").agg(
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("grams").alias("grams"), F.first("k").alias("k"), F.max(cover).alias("one"),
        counted(F.bit_or).alias("covered"), (F.max("high") - F.min("low") + F.first("k")).alias("length"),
        F.sum((cover == 1).cast("long")).alias("complete"), F.min(F.when(cover == 1, F.col("diagonal"))).alias("first"),
        F.max(F.when(cover == 1, F.col("diagonal"))).alias("last"),
    )
    fits = F.col("length") <= MOST_LENGTH * (F.col("grams") + F.col("k") - 1)
    share = F.greatest("one", F.when(fits, F.col("covered") / F.col("grams")).otherwise(0.0))
    is_base, is_long = F.coalesce("is_base", F.lit(False)), ~F.coalesce("is_base", F.lit(True))
    found_base, found_long = is_base & (F.col("complete") > 0), is_long & (share >= LEAST_COVER)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy(*owner).agg(
        F.sum(F.when(found_base, F.col("complete")).otherwise(0)).alias("n_base"),
        F.min(F.when(found_base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(found_base, F.col("last"))).cast("long").alias("last_word"),
        joined(F.when(found_base, F.col("label"))).alias("base_labels"), joined(F.when(found_base | found_long, F.col("label"))).alias("labels"),
        F.max(F.when(found_base, 1.0).when(found_long, share).otherwise(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
