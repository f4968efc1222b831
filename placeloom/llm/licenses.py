"""License scans (native): word-bigram Dice against license templates, with size bounds.

Lines, paragraphs and runs of lines of a document are normalised and turned into sets of word bigrams.
A set of m bigrams and a template of n can reach the Dice coefficient t only if m lies between
n t / (2 - t) and n (2 - t) / t, so a unit meets just the templates that its size admits; most meet none.
A run of lines grows only while its set stays below that bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = 0.8

# Short notices and the short public licence texts, as their stewards publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring "
        "rights to this work."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE "
        "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program; if not, write to the Free "
        "Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
        "the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You "
        "should have received a copy of the GNU Lesser General Public License along with this library; if "
        "not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA"
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should "
        "have received a copy of the GNU Affero General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public "
        "at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to "
        "<https://unlicense.org/>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works "
        "of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject "
        "to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies "
        "of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
        "or derivative works are solely in the form of machine-executable object code generated by a source "
        "language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "CC0-1.0-header": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide. This software is distributed "
        "without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with "
        "this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order.

    >>> template_bigrams("The MIT License, the MIT")
    ['the mit', 'mit license', 'license the']
    """
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:], strict=False)))


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach the Dice coefficient `least` with one of n elements."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def admitted(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    """(size, license, template): each template under every size that can match it.

    The number of rows depends on the templates alone, not on the documents.
    """
    rows = [(size, name, grams) for name, text in templates.items() if (grams := template_bigrams(text)) for lo, hi in [size_bounds(len(grams), least)] for size in range(max(lo, 1), hi + 1)]
    return spark.createDataFrame(rows, "size int, license string, template array<string>")


def telling_words(templates: dict[str, str]) -> list[str]:
    """Words of which a text that reaches LEAST with a template has at least one.

    Such a text shares two thirds of the template's bigrams or more (for 0.8), so it can't lack the words
    that lie in more than the rest of them. The longest words are taken, for few texts have those.
    """
    found: set[str] = set()
    for text in templates.values():
        grams = template_bigrams(text)
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (len(w), w), reverse=True)
        covered: set[str] = set()
        for w in words:
            if len(covered) > len(grams) * (1 - LEAST / (2 - LEAST)) + 1e-9:
                break
            covered |= {g for g in grams if w in g.split()}
            found.add(w)
    return sorted(found)


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _dice(grams: Column, template: Column) -> Column:
    return F.round(2.0 * F.size(F.array_intersect(grams, template)) / F.greatest(F.size(grams) + F.size(template), F.lit(1)), 6)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, which later uses don't work out again: a generator stops the optimizer from copying them."""
    rest = [c for c in df.columns if c not in columns]
    df = df.select(*rest, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("made"))
    return df.select(*rest, *[F.col(f"made.{k}").alias(k) for k in columns])


#: Where the pieces of a run's search end, in lines after its first one.
PIECES = (64, 1_024, 16_384, 1 << 30)


def line_runs(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """(doc_id, license, dice) of each row of docs (doc_id, text in lower case) in which a run of two or more lines matches.

    Lines without words are passed over, so a run may cross empty lines, whole paragraphs or parts of them.
    dice is the best of all runs. A run is as good without a first line that adds none of the template's
    bigrams to it, so those whose bigrams of the template the next line has too start no run. A row meets
    only templates of which it has bigrams enough for a match.
    """
    spark = docs.sparkSession
    table = [(name, grams, size_bounds(len(grams), least)[1]) for name, text in templates.items() if (grams := template_bigrams(text))]
    every = F.broadcast(spark.createDataFrame([(sorted({g for _, grams, _ in table for g in grams}),)], "every array<string>"))
    table = F.broadcast(spark.createDataFrame(table, "license string, template array<string>, most int"))
    words = lambda x: F.split(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " ")
    rows = docs.crossJoin(every)  # one row: all bigrams of the templates
    rows = _once(rows, common=F.array_intersect(bigrams(words(F.col("text"))), "every")).drop("every")
    rows = rows.join(table, F.size(F.array_intersect("common", "template")) >= F.size("template") * (least / (2 - least)) - 1e-9)
    lines = F.filter(F.transform(F.split("text", "\n"), words), lambda x: x[0] != "")
    rows = _once(rows, lines=lines).where(F.size("lines") > 1)
    none, hashed = F.array().cast("array<bigint>"), lambda g: F.xxhash64(g)

    def line(x: Column, k: Column) -> Column:
        link = F.xxhash64(F.concat(F.element_at(F.get("lines", k - 1), -1), F.lit(" "), x[0]))
        return F.struct(F.transform(bigrams(x), hashed).alias("grams"), F.when(k > 0, F.array(link)).otherwise(none).alias("link"))

    # from here on a bigram is its 64-bit hash, for sets of numbers are united several times faster
    rows = _once(rows, lines=F.transform("lines", line), template=F.transform("template", hashed))
    # where the same line, with the same link to the line before it, stands last above each line
    rows = _once(rows, marks=F.transform("lines", lambda x: F.xxhash64(x["link"], x["grams"])))
    above = lambda x, k: F.array_position(F.reverse(F.slice("marks", F.lit(1), k)), x)
    rows = _once(rows, before=F.transform("marks", lambda x, k: _let(above(x, k), lambda n: F.when(n > 0, k - n).otherwise(F.lit(-1)))))
    rows = _once(rows, lines=F.zip_with("lines", "before", lambda x, b: F.struct(x["grams"].alias("grams"), x["link"].alias("link"), b.alias("before"))))

    def starts(k: Column) -> Column:
        here, after = F.get("lines", k), F.get("lines", k + 1)
        return F.size(F.array_except(F.array_intersect(F.concat(here["grams"], after["link"]), F.col("template")), after["grams"])) > 0

    rows = _once(rows, first=F.filter(F.sequence(F.lit(0), F.size("lines") - 2), starts))

    def state(grams: Column, best: Column) -> Column:
        return F.struct(F.when(F.size(grams) <= F.col("most"), grams).alias("grams"), best.alias("best"))

    def step(run: Column, x: Column) -> Column:
        # once the set is too large, a step only passes the state on
        grown = lambda g: state(g, F.greatest(run["best"], F.when(F.size(g) <= F.col("most"), _dice(g, F.col("template"))).otherwise(0.0)))
        return F.when(run["grams"].isNotNull(), _let(F.array_union(run["grams"], F.concat(x["link"], x["grams"])), grown)).otherwise(run)

    def piece(k: Column, begin: int, end: int) -> Callable[[Column], Column]:
        fresh = F.filter(F.slice("lines", k + 2 + begin, F.lit(end - begin)), lambda x: x["before"] <= k)
        return lambda run: F.when(run["grams"].isNotNull() & (k + 1 + begin < F.size("lines")), F.aggregate(fresh, run, step)).otherwise(run)

    def best_from(k: Column) -> Column:
        # pieces of growing length, none of which is read once the set is too large; a line that stands in the
        # run already adds nothing, so a text that repeats itself costs no more than one turn of it
        run = state(F.get("lines", k)["grams"], F.lit(0.0))
        for begin, end in zip((0, *PIECES), PIECES):
            run = _let(run, piece(k, begin, end))
        return run["best"]

    rows = _once(rows, dice=F.array_max(F.transform("first", best_from))).where(F.col("dice") >= least)
    return rows.select("doc_id", "license", "dice")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Licences that a line, a paragraph or a run of lines of a document matches.

    Returns doc_id, license, dice (the best of the document, to six places) and hits (lines and paragraphs that
    match by themselves; 0 where only a run does). Units are all lines, all paragraphs (parted by an empty
    line) of more than one line, and runs of lines (`line_runs`), which may span several paragraphs or a part
    of one; documents and units without a telling word of any template are passed over. Normalised means
    lower case, with everything but letters and digits as space. Null and empty texts match nothing; texts of
    any length are scanned whole; repeated doc_ids count as one document, null ones too (as id null). An empty
    table gives an empty result. Other columns are ignored.
    """
    table = admitted(docs.sparkSession, templates, least)
    most = max([size_bounds(len(template_bigrams(t)), least)[1] for t in templates.values()], default=0)
    rows = docs.where("text is not null").select("doc_id", F.lower("text").alias("text"))
    telling = None
    if least >= LEAST:
        # begins a word where normalisation begins one
        telling = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, telling_words(templates)))})"
        rows = rows.where(F.col("text").rlike(telling))
    blocks = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda b: F.instr(F.trim(b), "\n") > 0)
    units = rows.select("doc_id", F.explode(F.concat(F.split("text", "\n"), blocks)).alias("unit"))
    if telling:
        units = units.where(F.col("unit").rlike(telling))
    clean = F.trim(F.regexp_replace("unit", r"[^\p{L}\p{N}]+", " "))
    # a set of bigrams holds fewer than there are words, but repeats may shrink a long unit's set
    words = units.select("doc_id", F.split(clean, " ").alias("words")).where(F.size("words") > 1)
    sets = words.select("doc_id", bigrams(F.col("words")).alias("grams")).select("doc_id", "grams", F.size("grams").alias("size")).where(F.col("size") <= most)
    pairs = sets.join(F.broadcast(table), "size")
    shared = F.size(F.array_intersect("grams", "template"))
    dice = F.round(2.0 * shared / (F.col("size") + F.size("template")), 6)
    matched = pairs.select("doc_id", "license", dice.alias("dice"), F.lit(1).cast("long").alias("hits")).where(F.col("dice") >= least)
    matched = matched.unionByName(line_runs(rows, templates, least).withColumn("hits", F.lit(0).cast("long")))
    return matched.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("hits").alias("hits"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(templates: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, template_bigrams(v)))}])" for k, v in templates.items())


def _grams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: ({words})[i] || ' ' || ({words})[i + 1]))"


# the same units over all rows and all templates, with neither telling words nor starts of runs; a text meets a
# template only if it has bigrams enough of it
SQL = rf"""
WITH RECURSIVE t(license, template) AS (VALUES {_values(TEMPLATES)}),
b AS (SELECT row_number() OVER () AS id, doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM b
 UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS unit FROM b)
 WHERE contains(trim(unit), chr(10))),
w AS (SELECT doc_id, string_split(trim(regexp_replace(unit, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
g AS (SELECT doc_id, {_grams("words")} AS grams FROM w WHERE len(words) > 1),
d AS (SELECT doc_id, license, round(2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)), 6) AS dice, 1 AS hit FROM g JOIN t
 ON len(grams) >= ceil(len(template) * {LEAST} / (2 - {LEAST}) - 1e-9) AND len(grams) <= floor(len(template) * (2 - {LEAST}) / {LEAST} + 1e-9)),
a AS (SELECT id, doc_id, text, string_split(trim(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM b),
c AS MATERIALIZED (SELECT id, doc_id, license, template, floor(len(template) * (2 - {LEAST}) / {LEAST} + 1e-9) AS most,
 list_filter(list_transform(string_split(text, chr(10)), lambda x: string_split(trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')), lambda x: x[1] <> '') AS lines
 FROM (SELECT *, {_grams("words")} AS own FROM a) JOIN t ON len(list_intersect(own, template)) >= len(template) * {LEAST} / (2 - {LEAST}) - 1e-9),
runs(id, doc_id, license, template, most, lines, start, ends, grams) AS (
 SELECT * FROM (SELECT id, doc_id, license, template, most, lines, k, k, {_grams("lines[k]")} AS grams
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM c)) WHERE len(grams) <= most
 UNION ALL SELECT * FROM (SELECT id, doc_id, license, template, most, lines, start, ends + 1,
  list_distinct(list_concat(list_append(grams, lines[ends][-1] || ' ' || lines[ends + 1][1]), {_grams("lines[ends + 1]")})) AS grams
  FROM runs WHERE ends < len(lines)) WHERE len(grams) <= most),
e AS (SELECT * FROM d UNION ALL SELECT doc_id, license, round(2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)), 6), 0 FROM runs WHERE ends > start)
SELECT doc_id, license, max(dice) AS dice, sum(hit)::BIGINT AS hits FROM e WHERE dice >= {LEAST} GROUP BY ALL
"""
