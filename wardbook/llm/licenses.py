"""Licence scans: lines, paragraphs, windows and whole texts against templates, by the Dice coefficient of word bigrams.

Built from DataFrame functions only and within each row: nothing is shuffled. What is
compared are sets of bigrams. The size of a set bounds the coefficient, so that a template
is looked at only where both sizes allow ``THRESHOLD``; a unit whose number
of words or of distinct words rules out every template gets no bigrams at all.

Windows find a notice within a longer line and a licence text within a comment block or between other paragraphs: as
many words as a template has, placed so that one of its anchors lies where the template has it. Anchors
are the bigrams of a template that begin with one of ``MARKERS``, or all of them where none does. A copy
with words changed, left out or put in is met from its anchors before and behind the change.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Fixed: words that licences use and other texts use less.
MARKERS = (
    "agpl", "apache", "bsd", "cc", "commons", "copies", "copyright", "distribute", "distributed", "domain", "gnu", "gpl",
    "granted", "implied", "liability", "liable", "license", "licensed", "lgpl", "merchantability", "misrepresented", "mit",
    "mozilla", "mpl", "permission", "permitted", "redistribute", "redistributed", "redistribution", "redistributions",
    "software", "source", "warranties", "warranty")

# Fixed: short notices as licences ask for them or as their names are commonly given, and full texts of short licences.
TEMPLATES = {
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."),
    "bsd-3-clause": "Redistributed under the terms of the BSD 3-Clause License.",
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
}


def read_templates(folder: str) -> dict[str, str]:
    """Further templates, such as the texts of long licences: the files of a folder by their names."""
    return {f.name: f.read_text("utf-8", "replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


def words_in(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).lower().split()


def bigrams(text: str) -> list[str]:
    words = words_in(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(text: str) -> dict[str, int]:
    """The anchors of a template and the place of the first word of each, where it comes first."""
    words = words_in(text)
    pairs = list(enumerate(zip(words, words[1:])))
    chosen = [(i, p) for i, p in pairs if p[0] in MARKERS] or pairs
    return {" ".join(p): i for i, p in reversed(chosen)}


def needed_words(text: str, threshold: float) -> set[str]:
    """Words of a template of which any unit that reaches ``threshold`` against it has at least one.

    Such a unit shares the part threshold / (2 - threshold) of the template's bigrams; words are chosen, ``MARKERS`` and long
    ones first, until more bigrams than may be missing have one of them.
    """
    grams = [set(g.split()) for g in bigrams(text)]
    may_miss = len(grams) * (1 - threshold / (2 - threshold)) + 1e-9
    chosen: set[str] = set()
    for word in sorted(set().union(*grams), key=lambda w: (w not in MARKERS, -len(w), w)):
        if sum(not chosen.isdisjoint(g) for g in grams) > may_miss:
            break
        chosen.add(word)
    return chosen


def _bounds(size: Column | int, threshold: float) -> tuple:
    """Sizes of a set that may reach the threshold against one of ``size``."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; folded into one literal, however large."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, licenses of every row.

    license is the template with the highest coefficient of any unit (line, paragraph, window, whole text), of equal
    ones the larger one, then the first by name, and dice that coefficient; licenses has all templates that
    reach ``threshold``, comma-joined by name. Without any, null, 0 and the empty
    string. Null and empty texts, and units of fewer than two words, match
    nothing, nor does a template of fewer than two words. Rows are independent; other columns are not looked at.
    """
    sets = {name: grams for name, text in sorted(templates.items()) if (grams := bigrams(text))}
    if not sets:
        return docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"),
                           F.lit("").alias("licenses"))
    known = _literal([{"name": name, "grams": grams} for name, grams in sets.items()],
                     "array<struct<name: string, grams: array<string>>>")
    placed: dict[str, list] = {}
    for text in (templates[name] for name in sets):
        for gram, at in anchors(text).items():
            placed.setdefault(gram, []).append({"at": at, "n": len(words_in(text))})
    first_words = sorted({gram.split()[0] for gram in placed})
    marks = _literal(first_words, "array<string>")
    needed = _literal(sorted(set().union(*(needed_words(templates[name], threshold) for name in sets))), "array<string>")
    places = _literal(placed, "map<string, array<struct<at: int, n: int>>>")
    least = min(_bounds(len(g), threshold)[0] for g in sets.values())
    most = max(_bounds(len(g), threshold)[1] for g in sets.values())

    def words_of(unit: Column) -> Column:
        return F.split(F.trim(F.lower(F.regexp_replace(unit, "[^A-Za-z0-9]+", " "))), " ")

    def grams_of(words: Column) -> Column:
        n = F.size(words) - 1
        return F.array_distinct(F.zip_with(
            F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    def matches(grams: Column) -> Column:
        n = F.size(grams)
        low, high = _bounds(n, threshold)
        near = F.filter(known, lambda t: (F.size(t["grams"]) >= low) & (F.size(t["grams"]) <= high))
        scored = F.transform(near, lambda t: F.struct(
            (-2.0 * F.size(F.array_intersect(t["grams"], grams)) / (F.size(t["grams"]) + n)).alias("minus_dice"),
            (-F.size(t["grams"])).alias("minus_size"), t["name"].alias("name")))
        return F.filter(scored, lambda m: m["minus_dice"] <= -threshold)

    def windows(words: Column) -> Column:
        """Start (from 1) and number of words of each window, start * 2^20 + number."""
        n = F.size(words) - 1
        hits = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.when(
            a.isin(first_words), F.try_element_at(places, F.concat(a, F.lit(" "), b))))
        starts = F.transform(hits, lambda found, i: F.transform(
            found, lambda t: F.greatest(i - t["at"] + 1, F.lit(1)).cast("long") * (1 << 20) + t["n"]))
        return F.array_distinct(F.flatten(F.filter(starts, lambda found: found.isNotNull())))

    def in_windows(words: Column) -> Column:
        # Each window is judged before the next is cut out; grams are the variable of a lambda, so that they are made once.
        return F.flatten(F.transform(windows(words), lambda w: F.flatten(F.transform(F.transform(F.array(
            F.slice(words, F.shiftright(w, 20).cast("int"), (w % (1 << 20)).cast("int"))), grams_of), matches))))

    def in_units(units: Column) -> Column:
        # A set of bigrams has one less than the distinct words at least, and one less than the words at most.
        possible = F.filter(units, lambda w: (F.size(w) > 1) & (F.size(w) - 1 >= least) & F.arrays_overlap(w, needed) & (
            F.size(F.array_distinct(w)) - 1 <= most))
        return F.flatten(F.transform(F.transform(possible, grams_of), matches))

    def in_text(units: Column) -> Column:
        whole = units[0]
        return F.concat(in_units(units), F.when(F.arrays_overlap(whole, marks), in_windows(whole)).otherwise(
            F.array().cast("array<struct<minus_dice: double, minus_size: int, name: string>>")))

    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.array(text), F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")))
    # Words are the variable of a lambda, so that they are made once.
    found = docs.select("doc_id", F.flatten(F.transform(F.array(F.transform(units, words_of)), in_text)).alias("m"))
    best = F.array_min("m")
    return found.select(
        "doc_id", best["name"].alias("license"), F.coalesce(-best["minus_dice"], F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["name"]))), ",").alias("licenses"))


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    markers = ", ".join(f"'{m}'" for m in MARKERS)
    # Bigrams of a text as a list; units and templates are treated alike.
    grams = """list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"""
    words = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
                  string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text])) AS unit FROM d),
        uw AS (SELECT doc_id, {words.format('unit')} AS w FROM u),
        t AS (SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) AS v(name, body)),
        tg AS (SELECT name, {grams} AS g FROM t WHERE len(w) > 1),
        tp AS (SELECT name, len(w) AS n, i, w[i] || ' ' || w[i + 1] AS gram, w[i] IN ({markers}) AS marker
               FROM t, unnest(generate_series(1, len(w) - 1)) AS s(i)),
        anchor AS (SELECT name, n, gram, min(i) AS i
                   FROM (SELECT *, bool_or(marker) OVER (PARTITION BY name) AS marked FROM tp)
                   WHERE marker OR NOT marked GROUP BY name, n, gram),
        whole AS (SELECT doc_id, {words.format('text')} AS w FROM d),
        dp AS (SELECT doc_id, w, i, w[i] || ' ' || w[i + 1] AS gram
               FROM whole, unnest(generate_series(1, len(w) - 1)) AS s(i)),
        windows AS (SELECT DISTINCT doc_id, list_slice(w, s, s + n - 1) AS w
                    FROM (SELECT doc_id, w, greatest(dp.i - anchor.i + 1, 1) AS s, n
                          FROM dp JOIN anchor USING (gram))),
        ug AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, w FROM uw UNION ALL SELECT doc_id, w FROM windows)
               WHERE len(w) > 1),
        m AS (SELECT doc_id, name, len(tg.g) AS size, 2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice
              FROM ug, tg),
        k AS (SELECT doc_id, name, max(size) AS size, max(dice) AS dice FROM m WHERE dice >= {threshold}::DOUBLE GROUP BY doc_id, name),
        b AS (SELECT doc_id, first(name ORDER BY dice DESC, size DESC, name) AS license, max(dice) AS dice,
                     string_agg(name, ',' ORDER BY name) AS licenses FROM k GROUP BY doc_id)
        SELECT d.doc_id, b.license, coalesce(b.dice, 0.0::DOUBLE) AS dice, coalesce(b.licenses, '') AS licenses
        FROM d LEFT JOIN b USING (doc_id)
    """
