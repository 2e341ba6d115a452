"""License scan by diagonal voting.

Every rolling word k-gram of every document is hashed and joined with the k-grams of license templates. A hit votes for
the diagonal (document position less template position); diagonals that lie close are merged, since an inserted or
dropped word shifts the rest by one, and the span of a merged diagonal is verified by the template words it covers.

The templates (short statements, whole license texts and notices) are a fixed table, so their side is broadcast. Votes are
pre-aggregated by (document, template, diagonal) and no group is larger than a document's own hits.

Defined results: null text is the empty text, with no words, labels or places (score 0); rows repeated whole share one
result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, text_of, tune

#: Words of a gram; templates shorter than that are one gram.
K = 4
#: Merged diagonals differ by so many words at most, and follow within so many words.
SHIFT, GAP = 3, 24
#: Share of a template's words that a span must cover to carry its label.
COVERED = 0.8

# Phrases whose places are counted, and license statements with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
)

# Whole license texts and notices. Copyright lines, which differ between copies, are left out.
TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd",
    ),
    (
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        "bsd-3-clause",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        "isc",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "apache",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
        "gpl",
    ),
    (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
        "lgpl",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mpl",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        "unlicense",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. 3. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
)


def template_words(text: str) -> str:
    """A template's words, as a document's are taken, with spaces between."""
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(_LOWER)))


_LOWER = {c: c + 32 for c in range(65, 91)}

#: Words: runs of anything but ASCII that is no digit or letter. Case is folded per word below.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    """Words with A-Z lowered. The Kelvin sign is the one letter that lower() would turn into ASCII; it is set apart."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ķ"))), F.lit(_WORD), F.lit(0))


def _gram(h: Column, at: Column, k: int) -> Column:
    return F.when(at + (k - 1) < F.size(h), F.xxhash64(F.lit(k), *[F.get(h, at + o) for o in range(k)]))


def template_grams(spark, templates, phrases) -> DataFrame:
    """(template, tpos, n, gram, words, label, base) of every template gram; a fixed, small table."""
    texts = [*((template_words(t), lab, False) for t, lab in templates), *((t, lab, True) for t, lab in phrases)]
    rows = [(i, text, len(text.split()), label, base) for i, (text, label, base) in enumerate(texts)]
    table = spark.createDataFrame(rows, "template int, words string, n int, label string, base boolean")
    table = table.withColumn("th", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)))
    at = table.select("*", F.posexplode("th").alias("tpos", "_w"))
    sizes = sorted({min(K, r[2]) for r in rows})
    k = F.least(F.col("n"), F.lit(K))
    gram = F.lit(None).cast("long")
    for size in sizes:
        gram = F.when(k == size, _gram(F.col("th"), F.col("tpos"), size)).otherwise(gram)
    return at.select("template", "tpos", "n", k.alias("k"), "words", "label", "base", gram.alias("gram")).where("gram is not null")


def scan(docs: DataFrame, templates=(*TEMPLATES, *TEXTS), phrases=PHRASES, covered: float = COVERED) -> DataFrame:
    """Labels, places and score of every row."""
    spark = tune(docs.sparkSession)
    table = template_grams(spark, templates, phrases)
    sizes = sorted({min(K, len(template_words(t).split())) for t, _ in (*templates, *phrases)})
    k1, k2 = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1, k2, _words(text_of()).alias("w"))
    hashed = rows.select("_k1", "_k2", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    at = hashed.select("_k1", "_k2", "w", "h", F.posexplode("h").alias("pos", "_w"))
    grams = at.select("_k1", "_k2", "w", "pos", F.explode(F.array(*[_gram(F.col("h"), F.col("pos"), k) for k in sizes])).alias("gram"))
    hits = grams.join(F.broadcast(table), "gram")
    # a hash hit holds only where the words themselves agree
    agree = F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " ") == F.array_join(F.slice(F.split("words", " "), F.col("tpos") + 1, F.col("k")), " ")
    hits = hits.where(agree).select("_k1", "_k2", "template", "base", "label", "n", "k", "pos", "tpos").distinct()
    diagonals = hits.groupBy("_k1", "_k2", "template", "base", "label", "n", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"), F.count("*").alias("votes"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("tpos"), F.col("tpos") + F.col("k") - 1)))).alias("seen"),
    )
    # neighbours by diagonal: a text that repeats phrases of its own has far diagonals, which must not part near ones
    order = Window.partitionBy("_k1", "_k2", "template").orderBy("diagonal")
    between = F.greatest(F.col("first") - F.lag("last").over(order), F.lag("first").over(order) - F.col("last"))
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT) | (between > GAP) | F.col("base")
    merged = diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    spans = merged.groupBy("_k1", "_k2", "template", "base", "label", "n", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
    spans = spans.withColumn("cover", F.col("seen") / F.col("n"))
    whole = F.col("base") & (F.col("seen") == F.col("n"))
    found = spans.groupBy("_k1", "_k2").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | (F.col("cover") >= covered), F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    return rows.select("doc_id", "_k1", "_k2", F.size("w").cast("long").alias("n_words")).join(found, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir):
    """op10: license labels of all ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
