"""License scans: TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory. DataFrame functions only.

The units of a file are its windows: up to ``WINDOW`` consecutive lines, as headers are
wrapped over lines, and the whole text, however long. A word weighs its count in the unit
times its inverse document frequency, counted over all words of all files. Vectors stay
sparse: rows of (unit, term), joined with the frequencies and the templates' terms.

A cosine of THRESHOLD needs one of a template's rarest terms, those without which the
rest of its vector is shorter than THRESHOLD. Only files with such a term are taken
apart, and there only windows with such a line; no other unit can reach the threshold.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgraph.llm.common import table, written
from gridgraph.plans.lineage import cut

THRESHOLD = 0.75
#: Lines of a window, at most.
WINDOW = 8
WORD = r"[\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = "This program is free software{}; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."

#: Wording of common licence statements, notices, titles and whole licences,
#: by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", _MIT),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GPL.format("", 3)),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0-or-later", _GPL.format("", 2)),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def terms(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """term, df: how many files have each word; the empty term counts files with any."""
    words = F.array_distinct(terms(F.col(text_col)))
    return files.select(words.alias("words")).filter(F.size("words") > 0).select(F.explode(F.array_append("words", F.lit(""))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _array(words: list[str]) -> Column:
    """Words as one constant, however many."""
    return F.split(F.lit(" ".join(words)), " ")


def _idf(df: Column, n: int) -> Column:
    return F.ln(F.lit(1.0 + n) / (df + F.lit(1.0))) + F.lit(1.0)


def _windows(lines: Column, hot: Column, window: int) -> Column:
    """(line, last): windows of up to ``window`` lines with one of the lines ``hot`` in
    it, and the whole text."""
    last = F.size(lines) - 1
    ends = lambda i, a: F.transform(F.sequence(i, F.least(a + window - 1, last)), lambda b: F.struct(a.alias("line"), b.alias("last")))
    starts = lambda i: F.flatten(F.transform(F.sequence(F.greatest(i - window + 1, F.lit(0)), i), lambda a: ends(i, a)))
    return F.array_distinct(F.concat(F.flatten(F.transform(hot, starts)), F.array(F.struct(F.lit(0).alias("line"), last.alias("last")))))


def headers(files: DataFrame, row_col: str, text_col: str, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """row, t1 (a hash of the text), license, line_no, n_lines, score: the best template
    (ties to the first license by name) of each unit that reaches the threshold. Null and
    empty texts have no units. Rows of one id and text have the same units, once; rows
    that share an id, or have none, with different texts are told apart by ``t1``."""
    spark = files.sparkSession
    files = files.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("t"))
    seen = written(frequencies(files, "t"), "license-frequencies")
    model = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    of_template = model.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    # The templates are a given short list, and so are their terms.
    of_template = sorted(tuple(r) for r in of_template.collect())
    known = sorted({term for *_, term, _ in of_template})
    df = {r.term: r.df for r in seen.filter(F.array_contains(_array([*known, ""]), F.col("term"))).collect()}
    n = df.get("", 0)
    fixed, needed = [], set()
    for (template, name), rows in itertools.groupby(of_template, lambda r: r[:2]):
        w = {term: tf * (math.log((1.0 + n) / (df.get(term, 0) + 1.0)) + 1.0) for *_, term, tf in rows}
        norm = math.sqrt(sum(x * x for x in w.values()))
        fixed += [(template, name, term, x / norm) for term, x in w.items()]
        mass = 0.0
        for term in sorted(w, key=lambda t: (-df.get(t, 0), t)):
            mass += (w[term] / norm) ** 2
            if mass >= threshold * threshold - 1e-9:
                needed.add(term)
    weights = spark.createDataFrame(fixed, "template int, license string, term string, w double")
    needed = _array(sorted(needed))

    some = files.filter(F.arrays_overlap(terms(F.col("t")), needed)).select("row", F.xxhash64("t").alias("t1"), F.split("t", "\n", -1).alias("lines")).dropDuplicates(["row", "t1"])
    hot = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.arrays_overlap(terms(F.get("lines", i)), needed))
    units = some.select("row", "t1", "lines", F.explode(_windows(F.col("lines"), hot, window)).alias("u"))
    text = F.array_join(F.slice("lines", F.col("u.line") + 1, F.col("u.last") - F.col("u.line") + 1), "\n")
    unit = ["row", "t1", "line", "last"]
    each = units.select("row", "t1", "u.line", "u.last", F.explode(terms(text)).alias("term")).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    each = written(each.join(seen, "term").select(*unit, "term", (F.col("tf") * _idf(F.col("df"), n)).alias("v")), "license-terms")
    length = each.groupBy(*unit).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = each.join(weights, "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    same = F.col("d.row").eqNullSafe(F.col("l.row"))
    for c in unit[1:]:
        same &= F.col(f"d.{c}") == F.col(f"l.{c}")
    scored = dots.alias("d").join(length.alias("l"), same).select("d.*", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("score"), "license"))
    return scored.withColumn("r", best).filter("r = 1").select("row", "t1", "license", F.col("line").alias("line_no"), (F.col("last") - F.col("line") + 1).alias("n_lines"), "score")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as (path, depth); the root is the empty path."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth")))


def scan(files: DataFrame, row_col: str, dir_col: str, text_col: str, licence_file: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """row, directory, license, origin, line_no, n_lines, score, from_dir for every row.

    ``origin`` is ``header`` where a unit of the file itself reaches the threshold (its
    best: score, then the first and shortest, then license), ``directory`` where the
    nearest of the file's directory and those above has a licence file (the licence that
    most of its licence files state, ties to the first by name), else ``none`` with
    nulls. ``licence_file`` says by place which files are licence files, whatever their
    size; null is no. A null directory is the root. Null and repeated row ids are fine.
    """
    directory = F.coalesce(F.array_join(F.filter(F.split(F.col(dir_col), "/"), lambda p: p != ""), "/"), F.lit(""))
    files = files.select(F.col(row_col).alias("row"), directory.alias("directory"), F.col(text_col).cast("string").alias("t"), F.coalesce(licence_file, F.lit(False)).alias("licence_file"))
    found = cut(headers(files, "row", "t", templates, threshold, window))
    order = F.struct("score", -F.col("line_no"), -F.col("n_lines"))
    own = found.groupBy(F.col("row").alias("own_row"), "t1").agg(F.max_by(F.struct("license", "line_no", "n_lines", "score"), order).alias("own"))
    placed = files.select("row", "directory", "licence_file", F.xxhash64("t").alias("t1")).join(own.withColumnRenamed("t1", "own_t1"), F.col("row").eqNullSafe(F.col("own_row")) & (F.col("t1") == F.col("own_t1")), "left").select("row", "directory", "licence_file", "own")
    stated = placed.filter("licence_file and own is not null").groupBy("directory", "own.license").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("n"), "license"))
    of_dir = stated.withColumn("r", first).filter("r = 1").select(F.col("directory").alias("path"), F.col("license").alias("dir_license"))
    # Directories, not files, are joined with those above them.
    above = placed.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.path", "a.depth")
    nearest = above.join(of_dir, "path").groupBy("directory").agg(F.max_by(F.struct("path", "dir_license"), "depth").alias("near"))
    return placed.join(nearest, "directory", "left").select(
        "row", "directory", F.coalesce("own.license", "near.dir_license").alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.col("own.line_no").alias("line_no"), F.col("own.n_lines").alias("n_lines"), F.col("own.score").alias("score"), F.when(F.col("own").isNull(), F.col("near.path")).alias("from_dir"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: ``source``, thousands and hundreds of the id. Of
    each ten documents the first is in the place of a licence file: at the source for whole
    thousands, a level below for whole hundreds, else beside the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    thousands, hundreds = (F.expr(f"cast(doc_id div {n} as string)") for n in (1000, 100))
    directory = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source")).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", thousands)).otherwise(F.concat_ws("/", "source", thousands, hundreds))
    out = scan(docs.withColumn("dir", directory), "doc_id", "dir", "text", F.col("doc_id") % 10 == 0)
    return out.withColumnRenamed("row", "doc_id")


_TEMPLATE_SQL = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
OP1_SQL = rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, text, source, CAST(doc_id // 1000 AS VARCHAR) AS thousands, CAST(doc_id // 100 AS VARCHAR) AS hundreds FROM documents),
d AS (
  SELECT r, doc_id, text, coalesce(doc_id % 10 = 0, false) AS licence_file,
    CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source) WHEN doc_id % 100 = 0 THEN concat_ws('/', source, thousands) ELSE concat_ws('/', source, thousands, hundreds) END AS directory FROM f),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
lt AS (SELECT r, i, term, count(*) AS tf FROM (SELECT r, i, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')) AS term FROM l) GROUP BY ALL),
n AS (SELECT count(DISTINCT r) AS n FROM lt),
df AS (SELECT term, count(DISTINCT r) AS df FROM lt GROUP BY term),
s AS (SELECT r, max(i) AS most FROM l GROUP BY r),
u AS (SELECT DISTINCT r, a, b FROM (SELECT l.r, l.i AS a, l.i + w - 1 AS b FROM l JOIN s ON l.r = s.r, range(1, {WINDOW} + 1) x(w) WHERE l.i + w - 1 <= s.most UNION ALL SELECT r, 0, most FROM s)),
m AS (SELECT * FROM (VALUES {_TEMPLATE_SQL}) AS m(template, license, text)),
mt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM m) GROUP BY ALL),
mw AS (SELECT template, license, mt.term, tf * (ln((1.0::DOUBLE + n.n) / (coalesce(df.df, 0) + 1.0::DOUBLE)) + 1.0) AS w FROM mt CROSS JOIN n LEFT JOIN df ON mt.term = df.term),
mn AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY template)) AS norm FROM mw),
v AS (
  SELECT u.r, a, b, lt.term, sum(tf) * (ln((1.0::DOUBLE + any_value(n.n)) / (any_value(df.df) + 1.0::DOUBLE)) + 1.0) AS v
  FROM u JOIN lt ON u.r = lt.r AND lt.i BETWEEN a AND b JOIN df ON lt.term = df.term CROSS JOIN n GROUP BY u.r, a, b, lt.term),
h AS (SELECT r, a, b, sqrt(sum(v * v)) AS length FROM v GROUP BY ALL),
c AS (
  SELECT v.r, v.a, v.b, license, round(sum(v.v * mn.w / mn.norm) / any_value(h.length), 6) AS score
  FROM v JOIN mn ON v.term = mn.term JOIN h ON v.r = h.r AND v.a = h.a AND v.b = h.b GROUP BY v.r, v.a, v.b, mn.template, license),
own AS (
  SELECT r, license, a AS line_no, b - a + 1 AS n_lines, score FROM c WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, a, b, license) = 1),
p AS (SELECT d.r, d.doc_id, d.directory, d.licence_file, own.license, own.line_no, own.n_lines, own.score FROM d LEFT JOIN own ON d.r = own.r),
g AS (
  SELECT directory, license FROM (SELECT directory, license, count(*) AS n FROM p WHERE licence_file AND license IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY n DESC, license) = 1),
i AS (
  SELECT p.directory, g.directory AS path, g.license FROM (SELECT DISTINCT directory FROM p) p JOIN g ON p.directory = g.directory OR starts_with(p.directory, g.directory || '/') OR g.directory = ''
  QUALIFY row_number() OVER (PARTITION BY p.directory ORDER BY length(g.directory) DESC) = 1)
SELECT p.doc_id, p.directory, coalesce(p.license, i.license) AS license,
  CASE WHEN p.license IS NOT NULL THEN 'header' WHEN i.license IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CAST(p.line_no AS INTEGER) AS line_no, CAST(p.n_lines AS INTEGER) AS n_lines, p.score, CASE WHEN p.license IS NULL THEN i.path END AS from_dir
FROM p LEFT JOIN i ON p.directory = i.directory
"""
