"""License scans: texts against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text, where it has more than one line the whole text (line 0),
and word windows: runs of words, over line ends too, of as many bigrams as a template's
size allows the threshold. A window comes under the line of its first word; of windows
that overlap, the one with most of a template's bigrams stays (then the highest
coefficient), and none is given whose line or whole text reaches the threshold with the
same template. Windows start and end with a bigram of the template, as any other is
lower than its inner part, and are looked for only in texts with enough of a template's
bigrams in all. A unit is normalised (lower case, everything but letters and digits is one
space) and becomes its set of word bigrams. A template is compared only if the sizes
allow the threshold (2 min / (a + b) >= t) and the unit shares a bigram with any
template; texts and units without a telling word or bigram of any template are left out before
(those sizes allow so few missing bigrams that none of them can reach the threshold). All of it is a projection and a filter of the scan: no shuffle, no Python.

Edge cases: null and empty texts and units of one word match nothing; null ids and
repeated rows are carried through; equal windows of one line are given once; of templates with equal coefficients the first
by name is reported; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def _gnu(name: str, version: int, subject: str = "This program") -> str:
    """The notice that the GNU licences ask for, whole."""
    kind = "GNU " + name
    return (
        f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. "
        f"You should have received a copy of the {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Public licences: the texts of the short ones, the notices that the long ones ask for, and short forms.
TEMPLATES = {
    "agpl-3.0-notice": _gnu("Affero General Public License", 3),
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": " ".join(_BSD[:3] + _BSD[4:]),
    "bsd-3-clause": " ".join(_BSD),
    "gpl-3.0-notice": _gnu("General Public License", 3),
    "isc-text": _ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-3.0-notice": _gnu("Lesser General Public License", 3),
    "mit-text": _MIT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": _BSD[0],
    **{f"cc-{k}-4.0": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items() if k != "by"},
    **{f"cc-{k}-4.0-short": f"Licensed under CC {k.upper()} 4.0." for k in _CC},
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": _ISC,
    "mit": "Released under the MIT License.",
    "mit-grant": _MIT,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigram_set(text: str) -> list[str]:
    w = normalised_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def telling_parts(templates: dict[str, str], threshold: float) -> tuple[list[str], list[str]]:
    """(words, bigrams) without any of which a unit can't reach the threshold with any template: too many of each template's bigrams are among them or hold one of them.

    Words have six letters or more; those that serve another template already, then those in many bigrams, come first. Templates of short words are told by bigrams.
    """
    words: set[str] = set()
    told: set[str] = set()
    for text in sorted(templates.values(), key=len, reverse=True):
        w = normalised_words(text)
        pairs = list(dict.fromkeys(zip(w, w[1:], strict=False)))
        spare = len(pairs) - len(pairs) * threshold / (2 - threshold)  # so many bigrams may be missing at most

        def held(own: set[str], pairs=pairs) -> int:
            return sum(" ".join(p) in told or not own.isdisjoint(p) for p in pairs)

        long = {x for x in w if len(x) >= 6}
        for x in sorted(long, key=lambda x: (x not in words, -held({x}), -len(x), x)):
            if held(words) > spare + 1e-9:
                break
            words.add(x)
        for p in pairs:
            if held(words) > spare + 1e-9:
                break
            told.add(" ".join(p))
    return sorted(words), sorted(told)


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, license, dice) for each unit with a template at the threshold or above; line 0 is the whole text."""
    chosen = dict(sorted((templates or TEMPLATES).items()))
    sets = {name: bigram_set(t) for name, t in chosen.items()}
    least = min(len(s) for s in sets.values()) * threshold / (2 - threshold)
    telling, pairs = telling_parts(chosen, threshold)

    def may_hold(x: Column) -> Column:
        """x is lower case; its words are looked up all at once."""
        hold = F.arrays_overlap(F.split(x, r"[^\p{L}\p{N}]+", -1), F.array(*map(F.lit, telling))) if telling else F.lit(False)
        return hold | F.rlike(x, F.lit("|".join(p.replace(" ", r"[^\p{L}\p{N}]+") for p in pairs))) if pairs else hold

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).where(may_hold(F.lower("_t")))
    clean = rows.select(id_col, F.explode(F.array(F.regexp_replace(F.lower("_t"), r"[^\p{L}\p{N}\n]+", " "))).alias("clean"))
    lines = F.split("clean", "\n", -1)
    units = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("t")))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("clean").alias("t")))
    each = clean.select(id_col, "clean", F.explode(F.when(F.contains("clean", F.lit("\n")), F.concat(units, whole)).otherwise(units)).alias("u")).where(may_hold(F.col("u.t")))
    # explode(array(x)) computes x once however often it is used above
    all_of_it = (F.col("u.line") == 0) | (F.length("u.t") == F.length("clean"))  # the whole text, of one line or more
    worded = each.select(id_col, F.col("u.line").alias("line"), F.when(all_of_it, F.col("u.t")).alias("t"), F.explode(F.array(F.filter(F.split(F.translate(F.col("u.t"), "\n", " "), " ", -1), lambda w: w != ""))).alias("w")).where(F.size("w") > F.lit(max(1.0, least)))
    known = sorted({b for s in sets.values() for b in s})
    held = worded.select(id_col, "line", "t", F.explode(F.array(_bigrams(F.col("w")))).alias("b"))
    near = held.select(id_col, "line", "t", "b", F.explode(F.array(F.array_intersect("b", F.array(*map(F.lit, known))))).alias("shared")).where(F.size("shared") > 0)

    n = F.size("b").cast("double")

    def dice(name: str) -> Column:
        own = sets[name]
        m = float(len(own))
        value = F.lit(2.0) * F.size(F.array_intersect("shared", F.array(*map(F.lit, own)))) / (n + m)
        possible = F.lit(2.0) * F.least(n, F.lit(m)) >= F.lit(threshold) * (n + m)
        return F.when(possible, F.struct(value.alias("dice"), F.lit(name).alias("license")))

    best = F.reduce(F.array(*[dice(name) for name in sets]), F.lit(None).cast("struct<dice:double,license:string>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), F.coalesce(x, a)).otherwise(a))
    one = F.array(F.struct("line", best["license"].alias("license"), best["dice"].alias("dice")))
    told = _windows(near.withColumn("best", F.filter(one, lambda x: x["dice"] >= threshold)), sets, threshold)
    found = told.select(id_col, F.explode(F.concat("best", F.coalesce("windows", F.slice("best", 1, 0)))).alias("best"))
    return found.select(id_col, "best.line", "best.license", "best.dice")


def _windows(near: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """near(t, b, shared, ...) with the windows(line, license, dice) of the whole texts t; null where there can be none."""
    share = threshold / (2 - threshold)

    def kept(df: DataFrame, **columns: Column) -> DataFrame:
        for name, x in columns.items():  # explode(array(x)): computed once
            df = df.select("*", F.explode(F.array(x)).alias(name))
        return df

    def dice(own: Column, pairs: Column) -> Column:
        return F.lit(2.0) * F.size(F.array_intersect(own, pairs)) / (F.size(F.array_distinct(pairs)) + F.size(own))

    templates = F.array(*[F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, v)).alias("own"), F.lit(max(1, math.ceil(len(v) * share - 1e-9))).alias("least"), F.lit(math.floor(len(v) / share + 1e-9)).alias("most")) for k, v in sets.items()])
    possible = F.filter(templates, lambda x: F.size(F.array_intersect(x["own"], F.col("shared"))) >= x["least"])
    df = kept(near, _able=F.when(F.col("t").isNotNull() & (F.size("shared") >= min(math.ceil(len(v) * share - 1e-9) for v in sets.values())), possible))
    some = F.size("_able") > 0
    words = F.flatten(F.transform(F.split("t", "\n", -1), lambda x, i: F.transform(F.filter(F.split(x, " ", -1), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    df = kept(df, _words=F.when(some, words))
    ends = F.zip_with(F.slice("_words", 1, F.size("_words") - 1), F.slice("_words", 2, F.size("_words") - 1), lambda x, y: F.struct(F.concat_ws(" ", x["w"], y["w"]).alias("pair"), x["line"].alias("first"), y["line"].alias("last")))
    df = kept(df, _ends=ends)
    df = kept(df, _pairs=F.col("_ends.pair"))
    # places of each template's bigrams, then the best end for each start
    placed = F.transform("_able", lambda x: F.struct(*[x[k].alias(k) for k in ("license", "own", "least", "most")], F.filter(F.sequence(F.lit(1), F.size("_pairs")), lambda i: F.array_contains(x["own"], F.element_at("_pairs", i))).alias("at")))
    df = kept(df, _placed=placed)

    def from_start(x: Column, a: Column, i: Column) -> Column:
        last = F.filter(F.slice(x["at"], i + x["least"], x["most"]), lambda e: e - a < x["most"])
        each = F.transform(F.transform(last, lambda e: F.slice("_pairs", a, e - a + 1)), lambda p: F.struct(dice(x["own"], p).alias("dice"), (-F.size(p)).alias("n"), F.size(F.array_intersect(x["own"], p)).alias("held")))
        top = F.filter(F.array(F.array_max(each)), lambda y: y["dice"] >= threshold)
        return F.transform(top, lambda y: F.struct((-y["held"]).alias("held"), (-y["dice"]).alias("dice"), x["license"].alias("license"), a.alias("a"), (a - y["n"] - 1).alias("e"), x["own"].alias("own")))

    df = kept(df, _tried=F.sort_array(F.flatten(F.transform("_placed", lambda x: F.flatten(F.transform(x["at"], lambda a, i: from_start(x, a, i)))))))
    apart = F.aggregate("_tried", F.slice("_tried", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] <= x["e"]) & (x["a"] <= y["e"])), acc).otherwise(F.concat(acc, F.array(x))))

    def known(x: Column) -> Column:
        """Its line, or the whole text, reaches the threshold with the template."""
        a, e = F.element_at("_ends", x["a"])["first"], F.element_at("_ends", x["e"])["last"]
        line = F.transform(F.filter("_ends", lambda p: (p["first"] == a) & (p["last"] == a)), lambda p: p["pair"])
        return (dice(x["own"], F.col("b")) >= threshold) | ((a == e) & (dice(x["own"], line) >= threshold))

    found = F.transform(F.filter(apart, lambda x: ~known(x)), lambda x: F.struct(F.element_at("_ends", x["a"])["first"].alias("line"), x["license"].alias("license"), (-x["dice"]).alias("dice")))
    return df.select(*near.columns, F.array_distinct(found).alias("windows"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql(templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """The scan, windows included, in DuckDB's SQL."""
    share = threshold / (2 - threshold)
    sets = {name: bigram_set(t) for name, t in sorted((templates or TEMPLATES).items())}
    bounds = {k: (max(1, math.ceil(len(v) * share - 1e-9)), math.floor(len(v) / share + 1e-9)) for k, v in sets.items()}
    rows = ", ".join("('%s', [%s], %d, %d)" % (k, ", ".join(f"'{b}'" for b in v), *bounds[k]) for k, v in sets.items())

    def dice(own: str, pairs: str) -> str:
        return f"(2.0::double * len(list_intersect({own}, {pairs})) / (len(list_distinct({pairs})) + len({own})))"

    return rf"""
with t(license, b, least, most) as (values {rows}),
tb as (select license, least, unnest(b) as pair from t),
c as (select row_number() over () as doc, doc_id, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)) as lines from documents where text is not null),
u as (
  select doc, doc_id, cast(i as int) as line, lines[i] as s from (select doc, doc_id, lines, unnest(range(1, len(lines) + 1)) as i from c)
  union all select doc, doc_id, 0, array_to_string(lines, ' ') from c where len(lines) > 1
),
w as (select doc, doc_id, line, list_filter(string_split(s, ' '), lambda x: x <> '') as w from u),
g as materialized (select doc, doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
d as (select doc, doc_id, line, license, 2.0::double * len(list_intersect(g, b)) / (len(g) + len(b)) as dice from g cross join t where 2.0 * least(len(g), len(b)) >= {threshold} * (len(g) + len(b))),
units as (select doc, doc_id, line, license, dice from (select *, row_number() over (partition by doc, line order by dice desc, license) as k from d where dice >= {threshold}) where k = 1),
-- word windows: of whole texts, words with their lines
words as (select doc, doc_id, flatten(list_transform(lines, lambda x, i: list_transform(list_filter(string_split(x, ' '), lambda y: y <> ''), lambda y: {{'w': y, 'line': i}}))) as w from c),
pairs as materialized (select doc, doc_id, list_transform(range(1, len(w)), lambda i: {{'pair': w[i].w || ' ' || w[i + 1].w, 'first': w[i].line, 'last': w[i + 1].line}}) as p from words where len(w) > 1),
met as (select doc, license, i from (select doc, unnest(range(1, len(p) + 1)) as i, unnest(p).pair as pair from pairs) join tb using (pair)),
placed as (select m.doc, m.license, list(m.i order by m.i) as places from met m group by m.doc, m.license),
able as (
  select pairs.doc, pairs.doc_id, p, t.license, b, least, most, places, list_transform(p, lambda x: x.pair) as all_pairs from placed join pairs on pairs.doc = placed.doc join t on t.license = placed.license
  where len(list_distinct(list_transform(places, lambda i: p[i].pair))) >= least
),
starts as (select *, places[k] as a from (select *, unnest(range(1, len(places) + 1)) as k from able)),
ends as (select doc, doc_id, license, b, p, a, unnest(list_filter(places[k + least - 1 : ], lambda e: e - a < most)) as e, all_pairs from starts),
tried as (select doc, doc_id, license, b, a, e, {dice("b", "all_pairs[a : e]")} as dice, len(list_intersect(b, all_pairs[a : e])) as held from ends),
best as (select * from (select *, row_number() over (partition by doc, license, a order by dice desc, e) as k from tried where dice >= {threshold}) where k = 1),
listed as (select doc, list({{'a': a, 'e': e, 'license': license, 'dice': dice}} order by held desc, dice desc, license, a, e) as x from best group by doc),
apart as (
  select doc, unnest(list_reduce(list_concat([list_filter(x, lambda y: false)], list_transform(x, lambda y: [y])), lambda acc, y: case when len(list_filter(acc, lambda z: z.a <= y[1].e and y[1].a <= z.e)) > 0 then acc else list_concat(acc, y) end)) as y from listed
),
windows as (
  select distinct q.doc, q.doc_id, cast(q.p[y.a].first as int) as line, y.license as license, y.dice as dice
  from apart join pairs q on q.doc = apart.doc join t on t.license = y.license
  where {dice("t.b", "list_transform(q.p, lambda x: x.pair)")} < {threshold}
    and (q.p[y.a].first <> q.p[y.e].last or {dice("t.b", "list_transform(list_filter(q.p, lambda x: x.first = q.p[y.a].first and x.last = q.p[y.a].first), lambda x: x.pair)")} < {threshold})
)
select doc_id, line, license, dice from units union all select doc_id, line, license, dice from windows
"""
