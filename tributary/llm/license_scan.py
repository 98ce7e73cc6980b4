"""Licence scans: normalised text against licence templates by Dice coefficient.

A text is compared in units: its lines, its paragraphs (between blank lines), the
whole, and for each template the windows of as many words as it has that begin with one
of its bigrams, so a notice of several lines or paragraphs inside a longer text, and one
inside a line, are found. A unit is normalised (A-Z lower-cased, everything but letters and digits one
blank) and made a set of word bigrams A; a template's set is B. Found is
``2 |A & B| / (|A| + |B|)`` of at least ``DICE`` per cent. Sizes prune first: |A| must
lie between |B| t / (2 - t) and |B| (2 - t) / t. Since a unit also needs at least
|B| t / (2 - t) of the template's bigrams, it has one of any |B| minus that plus one
of them; texts without any of these anchors are left out by one regular
expression. Windows with fewer of the template's bigrams than that are left out
before their sets are made. That loses nothing.

All of it is Spark SQL functions. The bigrams of the texts with an anchor meet those of
the templates, a fixed table, by a broadcast join; their places are shuffled, and those texts.

Defined cases: null and empty texts and units of one word find nothing; repeated
rows count with the id they share, null ids together; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import Scratch, table

DICE = 75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: licence notices
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_bigrams(text: str) -> list[str]:
    found = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def least_shared(n: int, dice: int) -> int:
    """The bigrams of a template of n that every unit found must have."""
    return -(-n * dice // (200 - dice))


def anchors(templates: dict[str, str], dice: int) -> str:
    """A regular expression that every text with a find matches."""
    chosen: dict[str, set[str]] = {}
    for text in templates.values():
        grams = sorted(template_bigrams(text), key=lambda g: (-len(g), g))
        for g in grams[: len(grams) - least_shared(len(grams), dice) + 1]:
            first, second = g.split(" ")
            chosen.setdefault(first, set()).add(second)
    some = "|".join(f"{a}[^\\p{{L}}\\p{{N}}]+(?:{'|'.join(sorted(b))})" for a, b in sorted(chosen.items()))
    return f"(?i)(?<![\\p{{L}}\\p{{N}}])(?:{some})(?![\\p{{L}}\\p{{N}}])"


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^\\p{L}\\p{N}]+", " "))


def _bigrams(text: str) -> Column:
    """The bigrams of a normalised text, in order."""
    w = F.split(text, " ")
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _permille(grams: Column, own: Column) -> Column:
    return F.floor(2000 * F.size(F.array_intersect(grams, own)) / (F.size(grams) + F.size(own))).cast("bigint")


def _finds(grams: Column, templates: dict[str, str], dice: int) -> Column:
    """Structs of license and permille for each template within the size bounds that is alike enough."""
    found = []
    size = F.size(grams)
    for name, text in templates.items():
        own = template_bigrams(text)
        n = len(own)
        fits = (size >= least_shared(n, dice)) & (size * dice <= n * (200 - dice))
        found.append(F.when(fits, F.struct(F.lit(name).alias("license"), _permille(grams, F.array(*map(F.lit, own))).alias("permille"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull() & (x["permille"] >= 10 * dice))


def _window_finds(likely: DataFrame, templates: dict[str, str], dice: int) -> DataFrame:
    """doc_id, license, permille of the best window, for each text (row, doc_id, text) and template."""
    spark = likely.sparkSession
    known = [F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, template_bigrams(t))).alias("own"), F.lit(len(re.findall("[a-z0-9]+", t.lower()))).alias("n_words")) for name, t in templates.items()]
    template = spark.range(1).select(F.explode(F.array(*known)).alias("t")).select("t.*")
    texts = likely.select("row", "doc_id", _normal(F.col("text")).alias("words")).select("row", "doc_id", _bigrams("words").alias("grams"))
    wanted = template.select("license", "n_words", F.size("own").alias("n"), F.explode("own").alias("gram"))
    hits = texts.select("row", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(wanted), "gram")
    # as many hits as a find needs must lie in the window that begins at this one
    ordered = Window.partitionBy("row", "license").orderBy("at")
    least = F.ceil(F.col("n") * dice / (200 - dice)).cast("int")
    ahead = F.collect_list("at").over(ordered.rowsBetween(Window.currentRow, max(least_shared(len(template_bigrams(t)), dice) for t in templates.values()) - 1))
    begun = hits.select("row", "license", "at", "n_words", F.get(ahead, least - 1).alias("last"))
    starts = begun.where("last <= at + n_words - 2").groupBy("row", "license").agg(F.collect_list("at").alias("starts"))
    met = texts.join(starts, "row").join(F.broadcast(template), "license")
    best = F.array_max(F.transform("starts", lambda a: _permille(F.array_distinct(F.slice("grams", a + 1, F.col("n_words") - 1)), F.col("own"))))
    return met.select("doc_id", "license", best.alias("permille")).where(F.col("permille") >= 10 * dice)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: int = DICE) -> DataFrame:
    """doc_id, license, n_units (lines, paragraphs and whole texts alike enough) and permille (of the best unit, windows too) of each licence found in a document."""
    likely = docs.select("doc_id", "text").where(F.col("text").rlike(anchors(templates, dice))).withColumn("row", F.monotonically_increasing_id())
    likely = Scratch(docs.sparkSession, "license-scan").save(likely, "likely")  # so that a row keeps its number
    units = F.concat(F.split("text", "\n"), F.split("text", "\n[\\x20\\x09-\\x0D]*\n"), F.array("text"))
    normal = likely.select("doc_id", F.explode(units).alias("unit")).select("doc_id", _normal(F.col("unit")).alias("unit"))
    pairs = normal.select("doc_id", F.array_distinct(_bigrams("unit")).alias("grams"))
    whole = pairs.select("doc_id", F.explode(_finds(F.col("grams"), templates, dice)).alias("f")).select("doc_id", "f.license", "f.permille", F.lit(1).alias("unit"))
    found = whole.unionByName(_window_finds(likely, templates, dice).withColumn("unit", F.lit(0)))
    return found.groupBy("doc_id", "license").agg(F.sum("unit").alias("n_units"), F.max("permille").alias("permille"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_template(name: str, text: str) -> str:
    return f"select '{name}' license, {len(re.findall('[a-z0-9]+', text.lower()))} n_words, {template_bigrams(text)!r} b"


def _sql_words(text: str) -> str:
    return f"string_split(trim(regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"


ORACLE_SQL = {
    "op3_license_scan": f"""
with t as ({" union all ".join(_sql_template(n, t) for n, t in TEMPLATES.items())}),
u as (select doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')), [text])) u
      from documents where text is not null),
w as (select doc_id, row_number() over () k, {_sql_words("u")} w from u),
g as (select doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from w where len(w) > 1),
f as (select doc_id, license, cast(floor(2000.0 * len(list_intersect(g, b)) / (len(g) + len(b))) as bigint) p, 1 unit
      from g join t on len(g) <= 2 * len(b) and len(g) * 2 >= len(b)),
dw as (select doc_id, row_number() over () k, {_sql_words("text")} w from documents where text is not null),
dg as (select doc_id, k, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) g from dw where len(w) > 1),
tg as (select license, unnest(b) gram from t),
h as (select k, pos, license from (select k, unnest(g) gram, generate_subscripts(g, 1) pos from dg) join tg using (gram)),
win as (select doc_id, license, list_distinct(g[pos:pos + n_words - 2]) g, b from h join dg using (k) join t using (license)),
f2 as (select doc_id, license, cast(floor(2000.0 * len(list_intersect(g, b)) / (len(g) + len(b))) as bigint) p, 0 unit from win)
select doc_id, license, cast(sum(unit) as bigint) n_units, max(p) permille from (select * from f union all select * from f2) where p >= {10 * DICE} group by doc_id, license
"""
}

QUERIES = {"op3_license_scan": op3_license_scan}
