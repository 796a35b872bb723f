"""Licence scans in built-in functions only: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Texts are cut into units: every line, every run of neighbouring lines that may be licence text (a wrapped header), and the
whole text (a licence file). A unit is the sparse TF-IDF vector of its distinct lower-cased words [a-z0-9]+; it is compared with
every template by cosine. Document frequencies of the templates' words cover all texts; words that no template has weigh as
unseen words. No unit can reach `least` unless the templates' words are at least least squared of its distinct words, as words
that no template has weigh most; what falls short is dropped while the text is read, without loss. Everything is read in one
pass, into a scratch table of units. A text declares the template of its best unit at or above `least`. A text that mostly
consists of matching lines, or of one matching run, or declares one and is named LICENSE or COPYING, is a licence file; the
template most of a directory's licence files declare is the directory's. Texts that declare nothing inherit from the nearest ancestor directory
that has one: distinct directories are joined with their ancestors, texts by directory, hot directories dealt over many tasks.

Defined results: null text is empty and null path is the root directory; ids may repeat or be null (a row each); ties go to
lines before runs before whole texts, then the earlier unit, then the template's name; other columns are ignored; empty tables
give no rows; whole texts are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scratch, spread_join

# Public texts of common licences: (licence, text), as they stand in headers and licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution 4.0 International CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE, RUN, WHOLE = 0, 1, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def units(text: Column, vocabulary: list[str], least: float) -> Column:
    """own: the text's words that templates have; n_words: all its words; units: (kind, at, n distinct words, m words, known ones) of what may reach `least`."""
    empty = F.array().cast("array<string>")
    every = F.array(*(F.lit(w) for w in vocabulary)) if vocabulary else empty
    bar = least * least
    likely = lambda n, known: (n > 0) & (F.size(known) >= bar * n)
    def counted(rows: Column) -> Column:
        """rows (kind, at, t) with m and w, the words of t and the distinct ones."""
        said = F.transform(rows, lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["t"].alias("t"), words(x["t"]).alias("w")))
        return F.transform(said, lambda x: F.struct(x["kind"], x["at"], x["t"], F.size(x["w"]).alias("m"), F.array_distinct(x["w"]).alias("w")))

    lines = counted(F.transform(F.split(text, "\n", -1), lambda t, k: F.struct(F.lit(LINE).alias("kind"), k.alias("at"), t.alias("t"))))

    def met(z: Column) -> Column:
        total = F.aggregate(z, F.lit(0), lambda a, x: a + x["m"])
        return let(F.array_distinct(F.flatten(F.transform(z, lambda x: x["w"]))), lambda all_words: F.struct(z.alias("lines"), F.size(all_words).alias("n"), total.alias("m"), F.array_intersect(every, all_words).alias("own")))

    def cut(y: Column) -> Column:
        unit = lambda x: F.struct(x["kind"], x["at"], F.size(x["w"]).alias("n"), x["m"], F.array_intersect(x["w"], y["own"]).alias("known"))
        rows = F.transform(y["lines"], lambda x: F.struct(unit(x).alias("u"), x["t"].alias("t")))
        rows = F.transform(rows, lambda x: F.struct(x["u"].alias("u"), x["t"].alias("t"), (likely(x["u"]["n"], x["u"]["known"]) | (x["u"]["n"] == 0)).alias("stays")))

        def kept(r: Column) -> Column:
            single = F.transform(F.filter(r, lambda x: x["stays"] & (x["u"]["n"] > 0)), lambda x: x["u"])
            # the lines that can't be licence text part the others into runs
            parted = F.split(F.array_join(F.transform(r, lambda x: F.when(x["stays"], F.translate(x["t"], "\f", " ")).otherwise("\f")), "\n"), "[\n\f]*\f[\n\f]*", -1)
            runs = F.transform(parted, lambda t, k: F.struct(F.lit(RUN).alias("kind"), k.alias("at"), t.alias("t")))
            runs = F.filter(runs, lambda x: F.instr(F.regexp_replace(x["t"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), "\n") > 0)
            runs = F.transform(counted(runs), unit)
            whole = F.array(F.struct(F.lit(WHOLE).alias("kind"), F.lit(0).alias("at"), y["n"].alias("n"), y["m"].alias("m"), y["own"].alias("known")))
            return F.concat(single, F.filter(F.concat(runs, whole), lambda x: likely(x["n"], x["known"])))

        return F.struct(y["own"].alias("own"), y["m"].alias("n_words"), let(rows, kept).alias("units"))

    return let(let(lines, met), cut)


def declared(rows: DataFrame, templates: list[tuple[str, str]], vocabulary: list[str], least: float) -> DataFrame:
    """_row, kind, at, n, m, template, cosine: the best template of each unit that reaches `least`. rows: _row, own, units."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(k, name, body) for k, (name, body) in enumerate(templates)], "k int, template string, body string")
    each = listed.select("k", "template", F.explode(F.array_distinct(words(F.col("body")))).alias("word"))
    seen = {r["word"]: r["n"] for r in rows.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    total = rows.count()
    idf = spark.createDataFrame([(w, seen.get(w, 0)) for w in vocabulary], "word string, df long").select("word", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    unseen = F.log(F.lit(float(1 + total))) + 1
    known = each.join(F.broadcast(idf), "word")
    norms = known.groupBy("k").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("length"))
    known = known.join(F.broadcast(norms), "k").select("k", "template", "word", (F.col("idf") / F.col("length")).alias("weight"))
    said = rows.select("_row", F.explode("units").alias("u")).select("_row", "u.kind", "u.at", "u.n", "u.m", F.size("u.known").alias("in"), F.explode("u.known").alias("word")).join(F.broadcast(idf), "word")
    key = ["_row", "kind", "at", "n", "m"]
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")) + (F.col("n") - F.first("in")) * unseen * unseen)
    units = said.groupBy(*key).agg(norm.alias("norm"))
    dots = said.join(F.broadcast(known), "word").groupBy(*key, "k", "template").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")
    found = dots.join(units, key).select(*key, "template", cosine).where(F.col("cosine") >= least)
    best = found.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template")).alias("b"))
    return best.select(*key, F.col("b.template").alias("template"), (-F.col("b.c")).alias("cosine"))


def ancestors(directory: Column) -> Column:
    """A directory and all above it to the root (the empty string), nearest first."""
    parts = F.split(directory, "/", -1)
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scanned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", templates: list[tuple[str, str]] | None = None, least: float = 0.6, mostly: float = 0.5) -> DataFrame:
    """doc_id, path, licence, origin (own, inherited or none), cosine, n_lines, licence_file, from_directory of each row of df."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, body in templates for w in _python_words(body)})
    if len(templates) > 2000 or len(vocabulary) > 50_000:
        raise ValueError("templates go out with the tasks; more than 2000, or 50000 words, don't")
    met = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.monotonically_increasing_id().alias("_row"), units(F.coalesce(F.col(text), F.lit("")), vocabulary, least).alias("u"))
    rows = scratch(met.select("doc_id", "path", "_row", "u.own", "u.n_words", "u.units"), "licence-units")
    good = declared(rows.select("_row", "own", "units"), templates, vocabulary, least)
    of = lambda kind, how: F.coalesce(how(F.when(F.col("kind") == kind, F.col("m"))), F.lit(0))
    own = good.groupBy("_row").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "kind", "at", "template")).alias("b"), F.count_if(F.col("kind") == LINE).alias("n_lines"), F.greatest(of(LINE, F.sum), of(RUN, F.max)).alias("said")
    ).select("_row", F.col("b.template").alias("own"), (-F.col("b.c")).alias("cosine"), "n_lines", "said")
    directory = F.regexp_replace("path", "/?[^/]*$", "").alias("directory")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike("^(?i:licen[cs]e|copying)")
    light = rows.select("doc_id", "path", "_row", directory, named.alias("named"), "n_words").join(own, "_row", "left")
    light = scratch(light.withColumn("licence_file", F.col("own").isNotNull() & (F.col("named") | (F.col("said") >= mostly * F.col("n_words")))), "licences")
    votes = light.where("licence_file").groupBy("directory", "own").agg(F.count("*").alias("n"))
    of = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("b")).select(F.col("directory").alias("above"), F.col("b.own").alias("template"))
    sizes = light.groupBy("directory").agg(F.count("*").alias("n"))
    up = sizes.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("steps", "above"))
    nearest = up.join(of, "above").groupBy("directory").agg(F.min(F.struct("steps", "above", "template")).alias("b")).select("directory", F.col("b.above").alias("above"), F.col("b.template").alias("template"))
    out = spread_join(light, nearest, ["directory"], sizes, ["_row"], "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("template").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "template").alias("licence"), origin.alias("origin"), "cosine", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "licence_file", F.when(F.col("own").isNull(), F.col("above")).alias("from_directory"))


def _python_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate({ord(a): b for a, b in zip(UPPER, LOWER)}))


def oracle(path: str, least: float = 0.6, mostly: float = 0.5) -> str:
    """The same over `documents`, with `path` as an SQL expression."""
    rows = ", ".join(f"({k}, '{t}', '{b}')" for k, (t, b) in enumerate(TEMPLATES))
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    tokens = lambda x: f"regexp_extract_all({low.format(x)}, '[a-z0-9]+')"
    likely = f"n > 0 and k >= {least * least} * n"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce({path}, '') as path, coalesce(text, '') as t from documents),
    tf as (select k as tmpl, template, unnest(list_distinct({tokens('body')})) as word from (values {rows}) v(k, template, body)),
    vocab as (select list(distinct word) as v from tf),
    line as (select r, said, i, {tokens('said')} as w from (select r, unnest(string_split(t, chr(10))) as said, unnest(range(len(string_split(t, chr(10))))) as i from d)),
    lined as (select r, said, i, len(w) as m, list_distinct(w) as w, len(list_distinct(w)) as n, len(list_intersect(w, v)) as k from line, vocab),
    stays as (select *, ({likely}) or n = 0 as stays from lined),
    parted as (select r, string_split_regex(string_agg(case when stays then translate(said, chr(12), ' ') else chr(12) end, chr(10) order by i), '[\\n\\x0C]*\\x0C[\\n\\x0C]*') as p from stays group by r),
    run as (select r, i, {tokens('said')} as w from (select r, unnest(p) as said, unnest(range(len(p))) as i from parted) where contains(regexp_replace(said, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), chr(10))),
    unit as (select r, 0 as kind, i, w, n, m, k from stays where n > 0 union all select r, 1, i, list_distinct(w), len(list_distinct(w)), len(w), len(list_intersect(w, v)) from run, vocab
      union all select r, 2, 0, list_distinct(w), len(list_distinct(w)), len(w), len(list_intersect(w, v)) from (select r, {tokens('t')} as w from d), vocab),
    chosen as (select * from unit where {likely}),
    seen as (select word, count(*) as df from (select r, unnest(list_distinct({tokens('t')})) as word from d) where word in (select word from tf) group by 1),
    idf as (select word, ln((1 + (select count(*) from d))::double / (1 + coalesce(df, 0))) + 1 as idf from (select distinct word from tf) left join seen using (word)),
    known as (select tmpl, template, word, idf / sqrt(sum(idf * idf) over (partition by tmpl)) as weight from tf join idf using (word)),
    said as (select r, kind, i, n, m, k, word, idf from (select r, kind, i, n, m, k, unnest(w) as word from chosen) join idf using (word)),
    norm as (select r, kind, i, n, m, sqrt(sum(idf * idf) + (n - k) * pow(ln((1 + (select count(*) from d))::double) + 1, 2)) as norm from said group by r, kind, i, n, m, k),
    dots as (select r, kind, i, tmpl, template, sum(idf * weight) as dot from said join known using (word) group by all),
    cos as (select r, kind, i, m, template, round(dot / norm, 6) as cosine from dots join norm using (r, kind, i)),
    good as (select * from cos where cosine >= {least} qualify row_number() over (partition by r, kind, i order by cosine desc, template) = 1),
    own as (select r, arg_min(template, (-cosine, kind, i, template)) as own, max(cosine) as cosine, count(*) filter (kind = 0) as n_lines,
      greatest(coalesce(sum(m) filter (kind = 0), 0), coalesce(max(m) filter (kind = 1), 0)) as said from good group by 1),
    light as (select d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') as directory, own, cosine, n_lines,
      own is not null and (regexp_matches(regexp_extract(d.path, '[^/]*$'), '^(?i:licen[cs]e|copying)') or said >= {mostly} * len({tokens('t')})) as licence_file from d left join own using (r)),
    "of" as (select directory as above, own as template from (select directory, own, count(*) as n from light where licence_file group by 1, 2) qualify row_number() over (partition by directory order by n desc, own) = 1),
    up as (select directory, unnest(range(len(string_split(directory, '/')) + 1)) as steps from (select distinct directory from light)),
    above as (select directory, steps, array_to_string(string_split(directory, '/')[1:len(string_split(directory, '/')) - steps], '/') as above from up),
    nearest as (select directory, above.above, template from above join "of" using (above) qualify row_number() over (partition by directory order by steps) = 1)
    select doc_id, path, coalesce(own, template) as licence, case when own is not null then 'own' when template is not null then 'inherited' else 'none' end as origin, cosine,
      coalesce(n_lines, 0) as n_lines, licence_file, case when own is null then above end as from_directory from light left join nearest using (directory)"""
