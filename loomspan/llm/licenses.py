"""License scan: lines, blocks and whole texts against templates by sparse TF-IDF, then inheritance from the nearest directory above; DataFrame operations only."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dimension_join, staged, table

#: Paragraphs of public license texts (whole, or how they begin), by identifier.
TEXTS = (
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    *(
        (
            f"{name}-{version}.0",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        )
        for name, long, version in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser", 3))
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Usual notices of a line, by identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *((f"CC-{short.replace(' ', '-')}-4.0", text) for short, long in (("BY", ""), ("BY-NC", "-NonCommercial"), ("BY-SA", "-ShareAlike")) for text in (f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License.", f"Licensed under CC {short} 4.0.")),
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in (2, 3)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. No part may be reproduced without written permission."),
    ("proprietary", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0") for end in ("", "-only", "-or-later")),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "ISC", "MIT", "MPL-2.0")),
)
#: Each paragraph is a template, and the paragraphs of a text together.
TEMPLATES = tuple(dict.fromkeys([*NOTICES, *((t[0], p) for t in TEXTS for p in t[1:]), *((t[0], " ".join(t[1:])) for t in TEXTS)]))
TERM = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
#: Signs that begin a line of comment; names of license files; blocks that name a holder only.
LEAD, NAMED, HOLDER = r"^[ \t]*(?://+|/?\*+/?|#+|;+|--+|%+|<!--)[ \t]*", r"^(?:licen[cs]e|copying|notice|unlicense)[^/]*$", r"^(?:copyright|\(c\)|©)"
#: Least cosine of a match, least cosine of a whole text that is a license, and share of a block's terms that templates must know.
LEAST, WHOLE, KNOWN = 0.6, 0.85, 0.5
#: Share of a line's terms that templates must know for it to be in a run.
NEAR = 0.8
#: Kinds of units. Lines are held against all templates, blocks against those of at least so many different terms, whole texts against all, but by WHOLE.
LINE, BLOCK, TEXT = 0, 1, 2
LONG = 15


def _weights(templates: tuple[tuple[str, str], ...], seen: dict[str, int] | None = None, documents: int = 0) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, license, term, weight of unit length) rows, ln((1 + N) / (1 + df)) + 1 of each term over N documents, and that of any other term.

    seen: in how many documents each term of a template is. A weight is 1 + ln(count), times that.
    """
    counts = [Counter(x.lower() for x in regex.findall(TERM, text)) for _, text in templates]
    idf = {t: math.log((1 + documents) / (1 + (seen or {}).get(t, 0))) + 1 for t in sorted({t for c in counts for t in c})}
    rows = []
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, templates[i][0], t, x / norm) for t, x in w.items()]
    return rows, idf, math.log(1 + documents) + 1


def _long(rows: list[tuple[int, str, str, float]]) -> set[int]:
    return {i for i, n in Counter(r[0] for r in rows).items() if n >= LONG}


def cues(rows: list[tuple[int, str, str, float]], least: float, seen: dict[str, int] | None = None) -> set[str]:
    """Terms of which any text must have one to match a template.

    A text's cosine with a template is at most the length of the template's part that it shares. So terms are taken as
    cues until what is left of the template is shorter than least: those first that few documents have for their weight.
    """
    out: set[str] = set()
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        left = 1.0
        for _, _, term, w in sorted(group, key=lambda r: (-(r[3] ** 2) / (1 + (seen or {}).get(r[2], 0)), r[2])):
            if math.sqrt(max(0.0, left)) < least - 1e-6:
                break
            out.add(term)
            left -= w * w
    return out


def _any_of(found: set[str]) -> str:
    """A pattern for texts, lower-cased, that have one of the terms; common beginnings are tried once."""
    tree: dict = {}
    for t in sorted(found):
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        some = [re.escape(c) + pattern(x) for c, x in at.items() if c]
        if not some:
            return ""
        return f"(?:{'|'.join(some)}){'?' * ('' in at)}"

    return r"(?<![a-z0-9])" + pattern(tree) + r"(?![a-z0-9])"


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def score_units(units: DataFrame, weights: tuple[list[tuple[int, str, str, float]], dict[str, float], float], least: float = LEAST) -> DataFrame:
    """units (key, kind, unit) with each key once, to (key, license, cosine): the best template of least or more, that the kind allows.

    Weights are 1 + ln(count) times idf; a term that no template has weighs as one that no document has. A unit's terms meet
    the templates' by a join on the term; the templates are a constant, so that side is broadcast. Ties go to the first
    license by name.
    """
    rows, idf, rare = weights
    long = _long(rows)
    spark = units.sparkSession
    t = units.select("key", "kind", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "kind", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    w = F.col("tf") * F.coalesce("idf", F.lit(rare))
    t = t.join(known, "term", "left").withColumn("w", w)
    # what templates don't know counts for the length only: its squares are summed before they are written
    t = t.groupBy("key", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("known"))
    t = t.select("key", "kind", "len", F.explode("known").alias("k")).select("key", "kind", "len", "k.*")
    theirs = F.broadcast(spark.createDataFrame([(*r, r[0] in long) for r in rows], "tid int, license string, term string, wt double, long boolean"))
    dots = t.join(theirs, "term").filter((F.col("kind") != BLOCK) | F.col("long")).groupBy("key", "kind", "tid", "license").agg((F.sum(F.col("w") * F.col("wt")) / F.first("len")).alias("cosine"))
    found = dots.withColumn("cosine", F.round("cosine", 9)).filter(F.col("cosine") >= F.when(F.col("kind") == TEXT, F.lit(WHOLE)).otherwise(F.lit(least)))
    return found.groupBy("key").agg(F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), F.col("license"))).alias("m")).select("key", "m.*")


def _units(text: Column, known: list[str]) -> Column:
    """struct(units: array of (kind, unit), own: all blocks are of a license), for a text with a cue.

    Units are lines, blocks and the whole text, without signs of comments. A block ends at an empty line or with a comment;
    a run of lines whose terms templates know is one too, so that a notice in the middle of other lines is seen whole.
    """
    lines = F.split(text, "\n")
    is_note = lambda x: x.rlike(LEAD)
    bare = F.transform(
        F.array(lines),
        lambda l: F.transform(l, lambda x, i: F.concat(F.when((i > 0) & is_note(F.get(l, i - 1)) & ~is_note(x), F.lit("\n")).otherwise(F.lit("")), F.regexp_replace(F.regexp_replace(x, LEAD, ""), r"^\s+$", ""))),  # noqa: E741
    )[0]

    def of(b: Column) -> Column:
        whole = F.array_join(b, "\n")
        blocks = F.filter(F.split(whole, "\n\n+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))

        def share(x: Column, least: float) -> Column:
            return F.transform(F.array(terms(x)), lambda t: (F.size(t) > 0) & (F.size(F.filter(t, lambda y: y.isin(known))) >= least * F.size(t)))[0]

        def owned(x: Column) -> Column:
            return share(x, KNOWN) | F.lower(F.trim(x)).rlike(HOLDER)

        runs = F.filter(F.split(F.array_join(F.transform(b, lambda x: F.when(share(x, NEAR), x).otherwise(F.lit(""))), "\n"), "\n\n+"), lambda x: x != "")

        def kind(n: int, xs: Column) -> Column:
            return F.transform(F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")), lambda x: F.struct(F.lit(n).alias("kind"), x.alias("unit")))

        units = F.concat(kind(LINE, b), kind(BLOCK, F.concat(blocks, runs)), F.array(F.struct(F.lit(TEXT).alias("kind"), whole.alias("unit"))))
        return F.struct(units.alias("units"), F.forall(blocks, owned).alias("own"))

    return F.transform(F.array(bare), of)[0]


def scan(docs: DataFrame, least: float = LEAST, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """docs (doc_id, path, text): doc_id, path, license, cosine, how, from_dir; a row per row.

    Every line, block of lines and whole text is scored, unless it has none of the terms that any match must have; units that
    repeat are scored once. how: file, if the text has a notice and its name is that of a license file, or if it is a
    license as a whole and all of its blocks belong to it (it then licenses its directory); header, if it has a notice;
    inherited, if the nearest directory above that a license file licenses has one (from_dir says which); else null, as is
    license. Among several notices, and among several license files of a directory, the best cosine wins, then the first
    name; within a text a reservation of rights gives way to any license, as license texts often start with one. Null and
    empty texts have no notice; a null path lies in the top directory. Rows that repeat a doc_id are judged on their own
    text. Further columns are left out; an empty table gives an empty result.
    """
    _, idf, _ = _weights(templates)
    text, path = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("path"), F.lit(""))
    vocabulary = F.lit(sorted(idf))
    counted = docs.select(F.explode(F.array_intersect(terms(text), vocabulary)).alias("term")).groupBy("term").count()  # once a document
    seen = {r["term"]: r["count"] for r in counted.collect()}  # the templates' terms only
    weights = _weights(templates, seen, docs.count())
    rows, long = weights[0], _long(weights[0])
    some = {LINE: cues(rows, least, seen), BLOCK: cues([r for r in rows if r[0] in long], least, seen), TEXT: cues(rows, WHOLE, seen)}
    cue = {k: _any_of(x) for k, x in some.items()}

    def may(x: Column) -> Column:
        u = F.lower(x["unit"])
        return F.when(x["kind"] == LINE, u.rlike(cue[LINE])).when(x["kind"] == BLOCK, u.rlike(cue[BLOCK])).otherwise(u.rlike(cue[TEXT]))

    d = docs.select(
        "doc_id",
        "path",
        F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("").alias("dir"),
        F.lower(F.regexp_extract(path, "([^/]*)$", 1)).rlike(NAMED).alias("named"),
        F.when(F.lower(text).rlike(_any_of(set().union(*some.values()))), _units(text, sorted(idf))).alias("u"),
    )
    d = d.select("doc_id", "path", "dir", "named", F.col("u.own").alias("own"), F.filter("u.units", may).alias("units"))
    d = staged(d.withColumn("row", F.monotonically_increasing_id()), "units")
    key = F.unhex(F.md5(F.concat(F.col("u.kind").cast("string"), F.col("u.unit")).cast("binary")))
    each = d.select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.unit", key.alias("key"))
    kinds = each.groupBy("key").agg(F.first(F.struct("kind", "unit")).alias("u")).select("key", "u.*")
    best = staged(score_units(kinds, weights, least), "matches").withColumnRenamed("key", "_key")
    hit = dimension_join(each.drop("unit"), best, F.col("key") == F.col("_key"), "inner")
    m = hit.groupBy(F.col("row").alias("_row")).agg(
        F.min_by(F.struct("license", "cosine"), F.struct(F.col("license") == "proprietary", -F.col("cosine"), F.col("license"))).alias("m"),
        F.max(F.col("kind") == TEXT).alias("whole"),
    )
    d = d.drop("units").join(staged(m, "own"), F.col("row") == F.col("_row"), "left")
    d = d.withColumn("file", F.coalesce(F.col("m").isNotNull() & (F.col("named") | F.col("whole") & F.col("own")), F.lit(False)))
    files = d.filter("file").groupBy("dir").agg(F.min_by(F.struct("m.license", "m.cosine"), F.struct(-F.col("m.cosine"), F.col("m.license")))["license"].alias("theirs"))
    files = staged(files, "license_dirs", small=True)
    # all directories above, the nearest first, down to the top one, which is empty
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.array(F.lit("")))
    dirs = d.select("dir").distinct().select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above)).alias("up", "from_dir"))
    got = dimension_join(dirs, files.withColumnRenamed("dir", "_dir"), F.col("from_dir") == F.col("_dir"), "inner")
    nearest = staged(got.groupBy("dir").agg(F.min_by(F.struct("theirs", "from_dir"), "up").alias("i")).select(F.col("dir").alias("_dir"), "i.*"), "inherited")
    out = dimension_join(d, nearest, F.col("dir") == F.col("_dir"))
    has = F.col("m").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("m.license", "theirs").alias("license"),
        F.col("m.cosine").alias("cosine"),
        F.when(F.col("file"), "file").when(has, "header").when(F.col("theirs").isNotNull(), "inherited").alias("how"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return scan(docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text"))


def _sql() -> str:
    """The same result in DuckDB's SQL, where every line, block and text is scored, with a cue or without, and idf is worked out again."""
    quoted = [(name, text.replace("'", "''")) for name, text in TEMPLATES]
    templates = " union all ".join(f"select {i} as tid, '{name}' as license, '{text}' as text" for i, (name, text) in enumerate(quoted))
    note = lambda x: f"regexp_matches({x}, '{LEAD}')"

    def terms_of(column: str) -> str:
        return f"regexp_extract_all(lower({column}), '{TERM}')"

    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(cast(doc_id as varchar), '_') || '.txt' as path,
  coalesce(source, '_') || '/' || coalesce(lang, '_') as dir, string_split(coalesce(text, ''), chr(10)) as l from documents),
b as (select *, list_transform(l, lambda x, i: case when i > 1 and {note('l[i - 1]')} and not {note('x')} then chr(10) else '' end || regexp_replace(regexp_replace(x, '{LEAD}', ''), '^\\s+$', '')) as b from d),
w as (select *, array_to_string(b, chr(10)) as whole, list_filter(regexp_split_to_array(array_to_string(b, chr(10)), '\\n\\n+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as blocks from b),
tp as ({templates}), kn as (select tid, license, term, 1 + ln(count(*)) as tf from (select tid, license, unnest({terms_of('text')}) as term from tp) group by all),
n as (select count(*) as n from d), se as (select term, count(*) as df from (select distinct row, unnest({terms_of("array_to_string(l, chr(10))")}) as term from d) group by term),
idf as (select term, ln((1.0e0 + any_value(n)) / (1.0e0 + coalesce(any_value(df), 0))) + 1 as idf from (select distinct term from kn) left join se using (term), n group by term),
vo as (select list(term) as vo from idf),
runs as (select row, unnest(list_filter(regexp_split_to_array(array_to_string(list_transform(b, lambda x: case when len({terms_of('x')}) > 0 and len(list_filter({terms_of('x')}, lambda y: list_contains(vo, y))) >= {NEAR} * len({terms_of('x')}) then x else '' end), chr(10)), '\\n\\n+'), lambda x: x <> '')) as unit from w, vo),
u as (select row, {LINE} as kind, trim(unit, ' ') as unit from (select row, unnest(b) as unit from w) union select row, {BLOCK}, trim(unit, ' ') from (select row, unnest(blocks) as unit from w union all select row, unit from runs) union all select row, {TEXT}, whole from w),
k as (select distinct unit from u where unit <> ''), tf as (select unit, term, 1 + ln(count(*)) as tf from (select unit, unnest({terms_of('unit')}) as term from k) group by all),
kt as (select tid, license, term, tf * idf / sqrt(sum((tf * idf) ** 2) over (partition by tid)) as wt from kn join idf using (term)),
uw as (select unit, term, tf * coalesce(idf, 1 + ln(1.0e0 + n)) as w from tf left join idf using (term), n), len as (select unit, sqrt(sum(w * w)) as len from uw group by 1),
dots as (select unit, tid, license, sum(w * wt) as dot from uw join kt using (term) group by all),
lt as (select tid, count(*) >= {LONG} as long from kn group by tid), hit as (select unit, kind, license, round(dot / len, 9) as cosine from dots join len using (unit) join lt using (tid), (select unnest([{LINE}, {BLOCK}, {TEXT}]) as kind)
  where round(dot / len, 9) >= case when kind = {TEXT} then {WHOLE} else {LEAST} end and (kind <> {BLOCK} or long)),
best as (select unit, kind, license, cosine from hit qualify row_number() over (partition by unit, kind order by cosine desc, license) = 1),
own as (select row, arg_min(struct_pack(license, cosine), struct_pack(z := license = 'proprietary', a := -cosine, b := license)) as m, bool_or(kind = {TEXT}) as whole from u join best using (unit, kind) group by row),
bt as (select row, i, block, unnest(case when len({terms_of('block')}) > 0 then {terms_of('block')} else ['?'] end) as term from (select row, unnest(range(1, len(blocks) + 1)) as i, unnest(blocks) as block from w)),
bo as (select row, i, count(idf) >= {KNOWN} * count(*) or regexp_matches(lower(trim(any_value(block), ' ')), '{HOLDER}') as owned from bt left join idf using (term) group by row, i),
ow as (select row, bool_and(owned) as owned from bo group by row),
j as (select w.row, doc_id, path, dir, m, coalesce(m is not null and own.whole and coalesce(owned, true), false) as file from w left join own using (row) left join ow using (row)),
files as (select dir, arg_min(m.license, struct_pack(a := -m.cosine, b := m.license)) as theirs from j where file group by dir),
near as (select j.row, coalesce(f1.theirs, f2.theirs, f3.theirs) as theirs, case when f1.dir is not null then f1.dir when f2.dir is not null then f2.dir else f3.dir end as from_dir
  from j left join files f1 on f1.dir = j.dir left join files f2 on f2.dir = split_part(j.dir, '/', 1) left join files f3 on f3.dir = '')
select doc_id, path, coalesce(m.license, theirs) as license, m.cosine as cosine, case when file then 'file' when m is not null then 'header' when theirs is not null then 'inherited' end as how,
  case when m is null then from_dir end as from_dir from j join near using (row)
"""


OP4_SQL = _sql()
