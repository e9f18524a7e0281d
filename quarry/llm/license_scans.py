"""License scans: lines of text compared with licence templates by the Dice coefficient of word bigrams.

Lines and templates are lower-cased and cut into runs of letters and digits; each has the
set of its distinct word bigrams.  A line matches a template when
2 * shared / (bigrams of the line + bigrams of the template) reaches the threshold.

Lines meet templates over equal bigrams (an inverted index of the templates), so a line
without a template's bigram costs nothing and no line is paired with every template.  Size
bounds prune what meets: a line must have between t / (2 - t) and (2 - t) / t times the
template's bigrams.  Bigrams are compared as text, so the counts of shared ones are exact.

Spans find what lines cannot: notices and licence bodies over several lines, and notices
inside longer lines.  A span is a run of words of the whole text, across lines, with at
most (2 - t) / t times as many bigrams as the template has, repeats counted.  Its size is
its distinct shared bigrams and every place of another bigram.  Only spans that begin and
end with a shared bigram can be best, so a text sends the places of known bigrams and all
such spans are scored.  Of spans that overlap, the best is kept, then the earliest, then
the shortest; a span that touches a line which matches the template alone is left out.  A
span's row has the line on which it begins.

Only DataFrame functions run on the executors.  Templates are given as rows; their index
is broadcast while it has at most INDEX_ROWS rows, counted first, and shuffled otherwise.
Up to FILTER_ROWS distinct bigrams, texts drop all others before anything is exploded.

Defined results: null texts have no lines.  Lines and templates of less than two words
match nothing.  A line that matches several templates gives a row for each.  Repeated
documents and lines match each for itself; templates that repeat an id give the best of
them.  Empty tables give an empty result.  Only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read

THRESHOLD = 0.8
INDEX_ROWS = 100_000  # some MB
FILTER_ROWS = 20_000
#: fixed values: common notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-2": "This project is licensed under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details.
You should have received a copy of the GNU {name}General Public License along with this {what}."""
#: fixed values: licence bodies and file headers, which stand on many lines
TEXTS = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause-text": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-header": _GNU.format(what="program", name="", n=2),
    "GPL-3.0-header": _GNU.format(what="program", name="", n=3),
    "LGPL-3.0-header": _GNU.format(what="library", name="Lesser ", n=3),
    "AGPL-3.0-header": _GNU.format(what="program", name="Affero ", n=3),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def texts(spark: SparkSession) -> DataFrame:
    """Licence bodies and headers, as templates."""
    return spark.createDataFrame(list(TEXTS.items()), "template string, text string")


def _words(text: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _bigrams_sql(words: str) -> str:
    return f"case when size({words}) < 2 then cast(array() as array<string>) else array_distinct(transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1]))) end"


def _bigrams(words: str) -> Column:
    return F.expr(_bigrams_sql(words))


def license_matches(docs: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, template, n_shared, n_line, n_template, dice) of lines of docs (doc_id, text) that match wanted (template, text)."""
    ratio = threshold / (2 - threshold)
    known = wanted.select("template", "text").distinct().withColumn("w", _words("text")).withColumn("bigrams", _bigrams("w"))
    index = known.select("template", F.xxhash64("template", "text").alias("uid"), F.size("bigrams").alias("n_template"), F.explode("bigrams").alias("b"))
    facts = index.agg(F.count("*").alias("rows"), F.min("n_template").alias("low"), F.max("n_template").alias("high")).first()
    if facts["rows"] <= INDEX_ROWS:
        index = F.broadcast(index)

    lines = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("w", _words("line")).withColumn("mine", _bigrams("w")).select("_row", "doc_id", "line_no", "mine", F.size("mine").alias("n_line"))
    # lines that are too short or too long for any template send nothing, the others their bigrams without the text
    sized = (F.col("n_line") >= (facts["low"] or 1) * ratio - 1e-9) & (F.col("n_line") * ratio <= (facts["high"] or 0) + 1e-9)
    pairs = lines.select("_row", "doc_id", "line_no", "n_line", F.explode_outer(F.when(sized, F.col("mine"))).alias("b"))
    hits = pairs.join(index, "b").filter((F.col("n_line") >= F.col("n_template") * ratio - 1e-9) & (F.col("n_line") * ratio <= F.col("n_template") + 1e-9))
    found = hits.groupBy("_row", "doc_id", "line_no", "n_line", "uid", "template", "n_template").agg(F.count("*").alias("n_shared"))
    found = found.withColumn("dice", F.lit(2.0) * F.col("n_shared") / (F.col("n_line") + F.col("n_template"))).filter(F.col("dice") >= threshold)
    best = found.groupBy("_row", "doc_id", "line_no", "template").agg(F.max(F.struct("dice", "n_shared", "n_line", "n_template")).alias("x"))
    return best.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "template", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("n_shared", "n_line", "n_template")], "x.dice")


# prev: where the bigram of a hit stood last, from its neighbour in the order of bigrams
_PREV = "array_sort(transform(_by_b, (x, i) -> named_struct('pos', x.pos, 'line', x.line, 'n', x.n, 'last', x.last, 'b', x.b, 'prev', case when i > 0 and _by_b[i - 1].b = x.b then _by_b[i - 1].pos else -1 end)))"
_NONE = "cast(array() as array<struct<worse: double, start: int, stop: int, line: int, last: int, n_shared: int, n_line: int>>)"


def _spans(threshold: float) -> str:
    """All spans between two hits that reach the threshold; acc counts hits and distinct shared bigrams."""
    shared = "(acc.s + case when y.prev < x.pos then 1 else 0 end)"
    size = f"({shared} + y.pos - x.pos - acc.n)"  # places less hits are the places of other bigrams
    dice = f"(2.0D * {shared} / ({size} + n_template))"
    one = f"named_struct('worse', -{dice}, 'start', x.pos, 'stop', y.pos, 'line', x.line, 'last', y.last, 'n_shared', {shared}, 'n_line', {size})"
    ends = f"""aggregate(slice(_hits, k + 1, places), named_struct('n', 0, 's', 0, 'out', {_NONE}), (acc, y) -> named_struct('n', acc.n + 1, 's', {shared},
        'out', case when y.pos - x.pos < places and {dice} >= {threshold}D then concat(acc.out, array({one})) else acc.out end), acc -> acc.out)"""
    return f"flatten(transform(_hits, (x, k) -> case when get(_hits, k + need - 1).pos - x.pos < places then {ends} else {_NONE} end))"


def license_spans(docs: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, last_line, template, n_shared, n_line, n_template, dice) of the best spans of docs (doc_id, text) that touch no line which matches alone."""
    ratio = threshold / (2 - threshold)
    known = wanted.select("template", "text").distinct().withColumn("w", _words("text")).withColumn("bigrams", _bigrams("w"))
    sizes = [F.size("bigrams").alias("n_template"), F.ceil(F.size("bigrams") * ratio - 1e-9).cast("int").alias("need"), F.floor((F.size("w") - 1) / ratio + 1e-9).cast("int").alias("places")]
    index = known.select("template", F.xxhash64("template", "text").alias("uid"), *sizes, F.explode("bigrams").alias("b"))
    facts = index.agg(F.count("*").alias("rows"), F.min("need").alias("need")).first()
    few = [r[0] for r in index.select("b").distinct().collect()] if facts["rows"] <= FILTER_ROWS else None
    if facts["rows"] <= INDEX_ROWS:
        index = F.broadcast(index)

    df = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.transform(F.split("text", "\n"), _words).alias("_lines"))
    df = df.withColumn("w", F.flatten("_lines"))
    bigram = lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1))
    every = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2))
    df = df.withColumn("_at", every if few is None else F.filter(every, lambda i: bigram(i).isin(few)))
    enough = f"size(_at) >= {facts['need'] or 1}"
    # the line of each word, and the distinct bigrams of that line
    df = df.withColumn("_of", F.expr(f"case when {enough} then flatten(transform(_lines, (x, l) -> array_repeat(named_struct('line', l, 'n', size({_bigrams_sql('x')})), size(x)))) end"))
    hit = "named_struct('pos', p, 'line', _of[p].line, 'n', _of[p].n, 'last', _of[p + 1].line, 'b', concat(w[p], ' ', w[p + 1]))"
    df = df.select("_row", "doc_id", F.explode(F.expr(f"case when {enough} then transform(_at, p -> {hit}) end")).alias("h")).withColumn("b", F.col("h.b"))

    hits = df.join(index, "b").select("_row", "doc_id", "template", "uid", "n_template", "need", "places", F.struct("h.b", "h.pos", "h.line", "h.n", "h.last").alias("h"))
    each = hits.repartition("_row", "template").groupBy("_row", "doc_id", "template", "uid", "n_template", "need", "places").agg(F.array_sort(F.collect_list("h")).alias("_by_b"))
    each = each.filter("size(_by_b) >= need").withColumn("_hits", F.expr(_PREV)).withColumn("_spans", F.expr(_spans(threshold))).filter("size(_spans) > 0")
    # lines that match alone, of those that spans touch
    own = "array_distinct(transform(filter(_hits, h -> h.line = l and h.last = l), h -> h.b))"
    size = "get(filter(_hits, h -> h.line = l), 0).n"
    alone = f"filter(array_distinct(flatten(transform(_spans, s -> sequence(s.line, s.last)))), l -> coalesce(2.0D * size({own}) / ({size} + n_template) >= {threshold}D, false))"
    each = each.select("_row", "doc_id", "template", F.expr("transform(_spans, s -> named_struct('worse', s.worse, 'start', s.start, 'stop', s.stop, 'line', s.line, 'last', s.last, 'n_shared', s.n_shared, 'n_line', s.n_line, 'n_template', n_template))").alias("_spans"), F.expr(alone).alias("_alone"))
    both = each.groupBy("_row", "doc_id", "template").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_alone")).alias("_alone"))
    both = both.withColumn("_spans", F.expr("array_sort(filter(_spans, s -> not exists(_alone, l -> l between s.line and s.last)))"))
    kept = "aggregate(_spans, slice(_spans, 1, 0), (kept, x) -> case when exists(kept, y -> x.start <= y.stop + 1 and y.start <= x.stop + 1) then kept else concat(kept, array(x)) end)"
    out = both.select("doc_id", "template", F.explode(F.expr(kept)).alias("s"))
    return out.select("doc_id", F.col("s.line").cast("long").alias("line_no"), F.col("s.last").cast("long").alias("last_line"), "template", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("n_shared", "n_line", "n_template")], (-F.col("s.worse")).alias("dice"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wanted = read(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark).unionByName(texts(spark))
    return license_matches(docs, wanted).unionByName(license_spans(docs, wanted).drop("last_line"))


_VALUES = ",\n    ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())


def _sql_bigrams(words: str) -> str:
    return f"list_distinct([{words}[i] || ' ' || {words}[i + 1] for i in range(1, len({words}))])"


SQL = f"""
WITH given(template, t) AS (VALUES
    {_VALUES}),
t_words AS (SELECT template, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM given),
known AS (SELECT template, {_sql_bigrams("w")} AS b FROM t_words WHERE len(w) > 1),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM parts),
l_words AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM lines),
l_grams AS (SELECT doc_id, line_no, {_sql_bigrams("w")} AS b FROM l_words WHERE len(w) > 1),
scored AS (SELECT doc_id, line_no, template, len(list_intersect(l.b, k.b)) AS n_shared, len(l.b) AS n_line, len(k.b) AS n_template FROM l_grams l, known k)
SELECT *, 2.0::DOUBLE * n_shared / (n_line + n_template) AS dice FROM scored WHERE 2.0::DOUBLE * n_shared / (n_line + n_template) >= {THRESHOLD}
"""
