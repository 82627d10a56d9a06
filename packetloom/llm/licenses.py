"""Licence scan: Dice coefficient over word bigrams of normalised text; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Templates of public licences and of the notices that name them (name, text).
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-notice", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0-notice", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("bsd-3-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]
THRESHOLD = 0.8


def normalise(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams in order; a single word stands for itself."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """Sizes n for which 2 * min(n, m) / (n + m) can reach the threshold."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each template and each unit size its bound admits, so that pruning is an equi-join on size."""
    made = [(i, name, bigrams(normalise(text))) for i, (name, text) in enumerate(templates)]
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("m")) for i, name, g in made if g]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    low, high = F.ceil(F.col("m") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("m") * (2 - threshold) / threshold + 1e-9)
    return t.withColumn("n", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def unit_bigrams(words: Column) -> Column:
    """Distinct bigrams; ``words`` stays out of the lambda, which would compute it again for each word."""
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n > 0, pairs).otherwise(words))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licences found: (doc_id, line, license, dice, n_bigrams), one row a unit that reaches the threshold.

    Units are each line (numbered from 1) and, as line 0, the whole text where it has several lines.
    The template of the highest Dice coefficient is taken, the first in code-point order at a tie.
    Text is lower-cased and all but ASCII letters and digits count as blanks. A unit's word count
    must reach the least bound of a template and its distinct words may exceed the greatest by one
    at most before its bigrams are made (it has no more bigrams than words and, as each further
    distinct word brings one, no fewer than distinct words less one), and its exact bigram count
    must lie within a template's bounds before the two are compared. Null and empty texts
    give nothing; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    t = template_table(spark, templates or TEMPLATES, threshold)
    sizes = [size_bounds(len(bigrams(normalise(x))), threshold) for _, x in templates or TEMPLATES]
    least, most = min(a for a, _ in sizes), max(b for _, b in sizes)
    text = F.regexp_replace(F.lower(F.coalesce(docs["text"], F.lit(""))), "[^a-z0-9\n]+", " ")
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.regexp_replace("text", "[ \n]+", " "))).otherwise(F.array(F.lit("")))
    u = d.select("doc_id", "row", F.posexplode(F.concat(whole, lines)).alias("line", "unit"))
    words = F.split(F.trim("unit"), " ")
    u = u.filter((F.trim("unit") != "") & (F.size(words) >= least) & (F.size(F.array_distinct(words)) - 1 <= most))
    u = u.select("doc_id", "row", "line", unit_bigrams(words).alias("b")).withColumn("n", F.size("b"))
    pairs = u.join(F.broadcast(t), "n")  # the templates are a fixed list: its size is known here
    dice = F.lit(2.0) * F.size(F.array_intersect("b", "grams")) / (F.col("n") + F.col("m"))
    best = pairs.select("doc_id", "row", "line", "n", "license", dice.alias("dice")).filter(F.col("dice") >= threshold)
    best = best.groupBy("row", "doc_id", "line", "n").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("x"))
    return best.select("doc_id", "line", F.col("x.license").alias("license"), F.round(-F.col("x.d"), 6).alias("dice"), F.col("n").cast("long").alias("n_bigrams"))


def oracle() -> str:
    made = [(name, bigrams(normalise(text))) for name, text in TEMPLATES]
    values = ", ".join("('" + name + "', [" + ", ".join(f"'{g}'" for g in grams) + "])" for name, grams in made)
    return f"""
WITH t(license, grams) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS text FROM documents),
l AS (SELECT doc_id, r, string_split(text, chr(10)) AS lines, text FROM d),
u AS (SELECT doc_id, r, 0 AS line, replace(text, chr(10), ' ') AS unit FROM l WHERE len(lines) > 1
      UNION ALL SELECT doc_id, r, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS unit FROM l),
w AS (SELECT doc_id, r, line, [x for x in string_split(unit, ' ') if x <> ''] AS words FROM u),
b AS (SELECT doc_id, r, line, CASE WHEN len(words) > 1 THEN list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) ELSE words END AS b
      FROM w WHERE len(words) BETWEEN 1 AND 100000),
p AS (SELECT doc_id, r, line, license, len(b) AS n, 2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice FROM b, t
      WHERE len(b) * 3 >= len(grams) * 2 - 1 AND len(b) * 2 <= len(grams) * 3 + 1),
q AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, license) AS k FROM p WHERE dice >= {THRESHOLD})
SELECT doc_id, line::INT AS line, license, round(dice, 6) AS dice, n::BIGINT AS n_bigrams FROM q WHERE k = 1
"""
