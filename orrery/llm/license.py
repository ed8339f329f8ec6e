"""License scans, in Spark expressions only.

A document's units are its whole text and each of its lines. Normalised (lower
case, everything but letters and digits a space), a unit is compared with each
licence template by the Dice coefficient of their sets of word bigrams:
2 * |A & B| / (|A| + |B|). Dice t or more needs |A| between |B| * t / (2 - t)
and |B| * (2 - t) / t, so that a unit's size rules out most templates before
any bigram is looked at; units that no template's bounds admit stop there.

A notice may also be wrapped over lines or stand within a longer line. So
passages, the runs of words anywhere in the text (of up to twice as many
bigrams as a template's bounds admit distinct ones), are compared with these
templates and with longer NOTICES. Only texts that hold as many of a
template's bigrams as a match needs are searched. The best passage for a start
is found exactly, as the distinct bigrams of its longer and longer runs are
prefixes of one list; starts are the places of the template's own bigrams, as
any other first bigram lowers Dice. The passage that shares most bigrams with
its template counts, then the one of greatest Dice, and only if its Dice is
greater than that of every whole text or line.

Templates are a short list, of this module or given, and are part of the plan
as literals. Nothing is shuffled: all units of a document are
looked at in its own row.

Defined results: null, empty and blank texts have no units and no licence;
texts of one word have no bigram and match nothing; a text of one line is one
unit (none without a letter or digit); ties go to the template that is listed first; repeated rows get equal
answers; other columns pass through unless they clash with results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import free_prefix

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Public licence names, notices and short texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. {}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, "
    "either version {2} of the License, or (at your option) any later version."
)
# Public licence texts and notices of many lines, compared with passages only.
NOTICES: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD.format("")),
    (
        "BSD-3-Clause",
        _BSD.format(
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission. "
        ),
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-2.0", _GNU.format("This program", "General Public License", 2)),
    ("LGPL-3.0", _GNU.format("This library", "Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", 3)),
)


def normal_words(text: str) -> list[str]:
    """What the column expressions do, for templates (ASCII)."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest bigram counts whose Dice with a template of this size
    can reach the threshold."""
    fits = [n for n in range(1, int(size * 2 / threshold) + 2) if 2 * min(n, size) >= threshold * (n + size)]
    return fits[0], fits[-1]


def prepared(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, list[str], int, int]]:
    """(name, bigrams, least and greatest size of a unit that can match)."""
    return [(name, grams, *bounds(len(grams), threshold)) for name, text in templates if (grams := bigrams(text))]


def _ranges(known: list[tuple[str, list[str], int, int]]) -> list[tuple[int, int]]:
    """The sizes that some template admits, as few ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((k[2], k[3]) for k in known):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _words(unit: Column) -> Column:
    """Normalised words: lower case, runs of letters and digits."""
    return F.split(F.btrim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(w: Column) -> Column:
    n = F.size(w) - 1
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.array_distinct(_pairs(w))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _passage(text: Column, grams: Column, known: list[tuple[str, list[str], int, int]], threshold: float) -> Column:
    """The passage of a text (with these distinct bigrams) that shares most
    bigrams with a template it matches: s, d (Dice) and t (minus the template's
    number); null if none."""
    templates = F.array(*[
        F.struct(F.lit(-k).alias("t"), F.array(*[F.lit(g) for g in own]).alias("g"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for k, (_, own, lo, hi) in enumerate(known)
    ])
    every = F.array(*[F.lit(g) for g in dict.fromkeys(g for k in known for g in k[1])])
    # a match shares at least as many bigrams as the least unit has
    met = _let(F.array_intersect(grams, every), lambda x: F.when(F.size(x) >= min(k[2] for k in known), F.filter(templates, lambda t: F.size(F.array_intersect(x, t["g"])) >= t["lo"])))

    def of_start(marked: Column, start: Column, t: Column) -> Column:
        run = F.slice(F.array_distinct(F.slice(marked, start, 2 * t["hi"])), F.lit(1), t["hi"])
        at = F.filter(F.transform(run, lambda g, j: F.when(F.startswith(g, F.lit("+")), j + 1)), lambda j: j.isNotNull())
        return F.array_max(F.transform(at, lambda j, i: F.struct((F.lit(2.0) * (i + 1) / (j + F.size(t["g"]))).alias("d"), (i + 1).alias("s"))))

    def of_template(pairs: Column, t: Column) -> Column:
        marks = F.transform(pairs, lambda g: F.concat(F.when(F.array_contains(t["g"], g), "+").otherwise("-"), g))

        def search(marked: Column) -> Column:
            hits = F.filter(F.transform(marked, lambda g, j: F.when(F.startswith(g, F.lit("+")), j + 1)), lambda j: j.isNotNull())

            def starts(at: Column) -> Column:
                # enough of the template's bigrams have to follow within a passage
                return F.filter(at, lambda j, i: F.get(at, i + t["lo"] - 1) - j < 2 * t["hi"])

            return F.array_max(F.transform(_let(hits, starts), lambda j: of_start(marked, j, t)))

        return _let(_let(marks, search), lambda x: F.struct(x["s"].alias("s"), x["d"].alias("d"), t["t"].alias("t")))

    def best(pairs: Column, found: Column) -> Column:
        return F.array_max(F.filter(F.transform(found, lambda t: of_template(pairs, t)), lambda x: x["d"] >= threshold))

    return _let(met, lambda found: F.when(F.size(found) > 0, _let(_let(_words(text), _pairs), lambda pairs: best(pairs, found))))


def scan(
    docs: DataFrame,
    text: str = "text",
    threshold: float = THRESHOLD,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
) -> DataFrame:
    """docs with n_units, n_candidates (units within some template's bounds),
    n_matches (units that match, and one for a passage that is better), license
    and dice (of the best match; null if none) and matched_unit (the unit's
    number: 0 the whole text, then lines; n_units for a passage). templates are
    compared with whole texts, lines and passages, notices with passages only;
    both are (name, text) and become literals of the plan, so that they are to
    be few: the licences that a corpus is asked for."""
    made = ("n_units", "n_candidates", "n_matches", "license", "dice", "matched_unit")
    step = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    prefix = free_prefix(step.columns)
    u, b, c, m, x, p = (prefix + name for name in ("u", "b", "c", "m", "x", "p"))
    known = prepared(threshold, templates)
    longer = known + prepared(threshold, notices)
    lines = F.split(F.col(text), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.col(text)), lines)).when(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) > 0, lines)
    step = step.withColumn(u, F.coalesce(units, F.array().cast("array<string>")))
    step = step.withColumn(b, F.transform(F.transform(u, _words), _bigrams))
    sized = F.transform(b, lambda g, i: F.struct(i.alias("i"), F.size(g).alias("n"), g.alias("b")))

    def admitted(x: Column) -> Column:
        found = F.lit(False)
        for lo, hi in _ranges(known):
            found = found | x["n"].between(lo, hi)
        return found

    step = step.withColumn(c, F.filter(sized, admitted))

    def best(x: Column) -> Column:
        scores = []
        for k, (_, grams, lo, hi) in enumerate(known):
            shared = F.size(F.array_intersect(x["b"], F.array(*[F.lit(g) for g in grams])))
            d = F.when(x["n"].between(lo, hi), F.lit(2.0) * shared / (x["n"] + len(grams)))
            scores.append(F.struct(d.alias("d"), F.lit(-k).alias("t"), (-x["i"]).alias("i")))
        return F.array_max(F.array(*scores))

    step = step.withColumn(m, F.filter(F.transform(c, best), lambda x: x["d"] >= threshold))
    step = step.withColumn(x, F.array_max(m))
    step = step.withColumn(p, _passage(F.col(text), F.get(b, F.lit(0)), longer, threshold))
    step = step.withColumn(p, F.when(F.col(x).isNull() | (F.col(p)["d"] > F.col(x)["d"]), F.col(p)))
    names = F.array(*[F.lit(k[0]) for k in longer])
    passage = F.col(p).isNotNull()
    return (
        step.withColumn("n_units", F.size(u).cast("long"))
        .withColumn("n_candidates", F.size(c).cast("long"))
        .withColumn("n_matches", (F.size(m) + passage.cast("int")).cast("long"))
        .withColumn("license", F.get(names, -F.when(passage, F.col(p)["t"]).otherwise(F.col(x)["t"])))
        .withColumn("dice", F.when(passage, F.col(p)["d"]).otherwise(F.col(x)["d"]))
        .withColumn("matched_unit", F.when(passage, F.size(u)).otherwise(-F.col(x)["i"]).cast("long"))
        .drop(u, b, c, m, x, p)
    )
