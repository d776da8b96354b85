"""License scan by sentence rules.

A text is cut into sentences, these are normalised (lower case, every run of other
characters one blank) and mapped to the identifiers of known license sentences. The
identifier sequence, in which a run of unknown sentences is one mark, is matched
against ordered rules: a rule takes its sentences out of the sequence, so a later,
more general rule cannot count them again. For the rules, sentences that are only a
list marker are left out, a marker in front of a sentence is passed over, and one run
of unknown sentences may lie between two sentences of a rule. Where sentences are
missing or changed, ``PARTIAL`` takes what is left.

Known by their grants or notices are MIT, BSD with 2, 3 and 4 clauses and 0BSD, Apache 1.1 and
2.0, GPL 2 and 3, LGPL 2.1 and 3, AGPL 3, MPL 2.0, EPL 1.0 and 2.0, Boost, zlib, ISC, Artistic
2.0, WTFPL, Unlicense, CC0 and Creative Commons BY, BY-SA and BY-NC 4.0, and by their tags
those of ``TAGS``. A text under another license has no result. BSD conditions that leave the
number of clauses open count as BSD.

Texts are cut twice, since licenses come wrapped over lines as well as in single lines
amid other text: once at line ends and once at paragraph ends. A license counts as
often as in the richer of both readings. Every known sentence holds one of ``SIGNS``,
so texts without any of them are not cut at all.

Everything is built-in expressions on one row: no shuffle, no join, no Python, and a
skewed source does not matter. Null and empty texts have no sentences. Rows that repeat
an id are reported each. Only the id and the text are read.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of public licenses and of notices that name them.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-only": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-short-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-short-2": "This work is licensed under the GNU General Public License, version 2",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mit-short": "Released under the MIT License",
    "mit-short-licensed": "Licensed under the MIT License",
    "bsd-short": "Released under the BSD License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
}
RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-only", "apache-copy"]),
    ("Apache-2.0", ["apache-grant", "apache-only"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl2-version"]),
    ("MPL-2.0", ["mpl-grant"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0-only", ["gpl-short-3"]),
    ("GPL-2.0-only", ["gpl-short-2"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("BSD", ["bsd-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-short"]),
]
# More wordings. They count for the rules alone, not in the sequence of the
# sentences as they stand.
MORE_SENTENCES = {
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following "
    "acknowledgement",
    "apache11-notice": "The end-user documentation included with the redistribution, if any, must include the following "
    "acknowledgment",
    "lgpl-free": "This library is free software",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
    "third-parties to whom the Software is furnished to do so, all subject to the following",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc0-waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and "
    "neighboring rights to this software to the public domain worldwide",
    "artistic2-notice": "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
    "changing it is allowed as long as the name is changed",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted",
}
# License identifiers that stand behind "SPDX-License-Identifier:".
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0",
    "Unlicense", "WTFPL", "Zlib",
]
MORE_SENTENCES |= {f"spdx-{tag.lower()}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
BEFORE = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("Apache-1.1", ["bsd-grant", "bsd-source", "bsd-binary", "apache11-notice"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms", "lgpl21-version"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl21-terms", "lgpl21-version"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
]
# Sentences that name a license by themselves and are in no other rule: one expression finds
# all of them, so that more of them cost no longer plan.
ALONE = {
    "boost-grant": "BSL-1.0",
    "boost-notice": "BSL-1.0",
    "zlib-grant": "Zlib",
    "epl2-notice": "EPL-2.0",
    "epl1-notice": "EPL-1.0",
    "cc0-waiver": "CC0-1.0",
    "artistic2-notice": "Artistic-2.0",
    "wtfpl-copy": "WTFPL",
    "0bsd-grant": "0BSD",
} | {f"spdx-{tag.lower()}": tag for tag in TAGS}
PARTIAL = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-names"]),
    ("BSD", ["bsd-grant", "bsd-source"]),
    ("BSD", ["bsd-grant", "bsd-binary"]),
    ("BSD", ["bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-grant"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant", "mit-as-is"]),
    ("MIT", ["mit-keep", "mit-as-is"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-or-later", ["gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl2-terms", "gpl2-version"]),
    ("LGPL-2.1-or-later", ["lgpl21-terms", "lgpl21-version"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["agpl3-terms"]),
]
SIGNS = r"licens|permission|redistribut|copyright|warrant|free software|public domain|apply|mpl"
LINES = r"[.!?;:]+(?:[ \t\r\n]+|$)|[\r\n]+"
PARAGRAPHS = r"[.!?;:]+(?:[ \t\r\n]+|$)|\n[ \t\r]*\n"
UNKNOWN = "~"
MARKER = r"(?:[0-9]{1,3}(?: [0-9]{1,3})*|[a-z]|x{0,3}(?:ix|iv|v?i{1,3}|v|x))"
# Holders are named in this sentence instead of "the copyright holder".
NAMES = r"^neither the names? of .{1,300} nor the names of (?:its|their|any|other) contributors "


def normalised(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).strip()


def _known(cut: str, sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier. Wordings are cut like texts, so an inner
    separator (as in a version number followed by a blank) makes several sentences."""
    out = {}
    for name, wording in sentences.items():
        pieces = [p for p in map(normalised, re.split(cut, wording)) if p]
        for k, piece in enumerate(pieces):
            out.setdefault(piece, name if len(pieces) == 1 else f"{name}.{k}")
    return out


def _expressions(cut: str) -> list[tuple[str, str]]:
    """All rules as regular expressions that pass over one run of unknown sentences."""
    every = SENTENCES | MORE_SENTENCES
    known = _known(cut, every)
    marks = lambda name: "".join(
        re.escape(f"<{known[p]}>") for p in map(normalised, re.split(cut, every[name])) if p
    )
    return [(license, f"{UNKNOWN}?".join(map(marks, names))) for license, names in BEFORE + RULES + PARTIAL]


def _alone(cut: str) -> dict[str, str]:
    """The marks of each sentence that names a license by itself, with that license."""
    known = _known(cut, SENTENCES | MORE_SENTENCES)
    marks = lambda name: "".join(
        f"<{known[p]}>" for p in map(normalised, re.split(cut, MORE_SENTENCES[name])) if p
    )
    return {marks(name): license for name, license in ALONE.items()}


def _any_of(marks: dict[str, str]) -> str:
    return "|".join(map(re.escape, sorted(marks, key=len, reverse=True)))


def _marks(text: Column, cut: str) -> Column:
    """The identifiers of the sentences, as ``<a>{b}~^<c>``: known as they stand, known but
    for a list marker or names, unknown, a list marker."""

    def named_in(known: dict[str, str], s: Column, left: str, right: str) -> Column:
        ids = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
        return F.concat(F.lit(left), F.try_element_at(ids, s), F.lit(right))

    def bare(s: Column) -> Column:
        names = "neither the name of the copyright holder nor the names of its contributors "
        return F.regexp_replace(F.regexp_replace(s, f"^{MARKER} ", ""), NAMES, names)

    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    plain = F.transform(F.split(low, cut), lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))
    longest = max(map(len, _known(cut, SENTENCES | MORE_SENTENCES))) + 400
    named = F.transform(
        F.filter(plain, lambda s: s != ""),
        lambda s: F.coalesce(
            named_in(_known(cut), s, "<", ">"),
            F.when(F.length(s) <= longest, named_in(_known(cut, SENTENCES | MORE_SENTENCES), bare(s), "{", "}")),
            F.when((F.length(s) <= 16) & F.regexp_like(s, F.lit(f"^{MARKER}$")), "^"),
            F.lit(UNKNOWN),
        ),
    )
    return F.when(F.regexp_like(low, F.lit(SIGNS)), F.array_join(named, "")).otherwise(F.lit(""))


def _as_they_stand(marks: Column) -> Column:
    # In two steps: Java's repeated groups recurse, and a long text has very many marks.
    return F.regexp_replace(F.regexp_replace(marks, r"\{[^}]*\}", UNKNOWN), r"[~^]+", UNKNOWN)


def _for_rules(marks: Column) -> Column:
    return F.regexp_replace(F.translate(marks, "{}^", "<>"), f"{UNKNOWN}+", UNKNOWN)


def sequence(text: Column, cut: str) -> Column:
    """The identifiers of the sentences, as ``<a><b>~<c>``."""
    return _as_they_stand(_marks(text, cut))


def _counts(marks: Column, cut: str) -> tuple[Column, Column]:
    """How often each license of the rules was found, as a map, and the licenses of sentences alone, repeated."""
    alone = _alone(cut)
    names = F.create_map(*(F.lit(x) for pair in alone.items() for x in pair))
    single = F.transform(F.regexp_extract_all(marks, F.lit(f"({_any_of(alone)})"), 1), lambda m: F.element_at(names, m))
    counts: dict[str, Column] = {}
    for license, pattern in _expressions(cut):
        taken = F.regexp_count(marks, F.lit(pattern))
        counts[license] = counts[license] + taken if license in counts else taken
        marks = F.regexp_replace(marks, pattern, "|")
    return F.create_map(*(x for name, n in counts.items() for x in (F.lit(name), n))), single


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, by_line and by_paragraph (identifier sequences of the sentences as
    they stand) and licenses: an array of (license, times), sorted by license."""
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(
        F.col(doc_id).alias("doc_id"),
        _marks(body, LINES).alias("_line"),
        _marks(body, PARAGRAPHS).alias("_paragraph"),
    ).select(
        "doc_id",
        _as_they_stand(F.col("_line")).alias("by_line"),
        _as_they_stand(F.col("_paragraph")).alias("by_paragraph"),
        _for_rules(F.col("_line")).alias("_line"),
        _for_rules(F.col("_paragraph")).alias("_paragraph"),
    )
    columns = {}
    for side, cut in (("line", LINES), ("paragraph", PARAGRAPHS)):
        columns[f"_{side}_rules"], columns[f"_{side}_alone"] = _counts(F.col(f"_{side}"), cut)
    counted = marked.withColumns(columns)

    def times(side: str, license: Column) -> Column:
        by_rule = F.coalesce(F.try_element_at(F.col(f"_{side}_rules"), license), F.lit(0))
        return by_rule + F.size(F.filter(f"_{side}_alone", lambda x: x == license))

    rules = sorted({license for license, _ in _expressions(LINES)})
    every = F.array_distinct(F.concat(F.array(*map(F.lit, rules)), "_line_alone", "_paragraph_alone"))
    found = F.transform(
        F.array_sort(every),
        lambda x: F.struct(x.alias("license"), F.greatest(times("line", x), times("paragraph", x)).cast("bigint").alias("times")),
    )
    found = F.filter(found, lambda x: x["times"] > 0)
    nothing = (~F.contains("_line", F.lit("<"))) & (~F.contains("_paragraph", F.lit("<")))
    none = F.array().cast("array<struct<license: string, times: bigint>>")
    return counted.select("doc_id", "by_line", "by_paragraph", F.when(nothing, none).otherwise(found).alias("licenses"))


def scan_sql(docs: str = "documents") -> str:
    """The scan in SQL, with flat result columns."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def looked_up(known: dict[str, str], s: str) -> str:
        return f"map([{', '.join(map(quoted, known))}], [{', '.join(map(quoted, known.values()))}])[{s}]"

    def marks(cut: str) -> str:
        every = _known(cut, SENTENCES | MORE_SENTENCES)
        names = "neither the name of the copyright holder nor the names of its contributors "
        bare = f"regexp_replace(regexp_replace(s, '^{MARKER} ', ''), {quoted(NAMES)}, {quoted(names)})"
        plain = f"list_transform(regexp_split_to_array(low, {quoted(cut)}), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        named = f"""list_transform(list_filter({plain}, lambda s: s <> ''), lambda s: coalesce(
          '<' || {looked_up(_known(cut), 's')} || '>',
          CASE WHEN length(s) <= {max(map(len, every)) + 400} THEN '{{' || {looked_up(every, bare)} || '}}' END,
          CASE WHEN length(s) <= 16 AND regexp_full_match(s, {quoted(MARKER)}) THEN '^' END, '{UNKNOWN}'))"""
        return f"CASE WHEN regexp_matches(low, {quoted(SIGNS)}) THEN array_to_string({named}, '') ELSE '' END"

    steps, counts = [], {}
    for column, cut in (("line", LINES), ("paragraph", PARAGRAPHS)):
        steps.append(f"regexp_replace(translate({column}_marks, '{{}}^', '<>'), '{UNKNOWN}+', '{UNKNOWN}', 'g') AS {column}_0")
        for k, (license, pattern) in enumerate(_expressions(cut)):
            steps.append(f"len(regexp_extract_all({column}_{k}, {quoted(pattern)})) AS {column}_n{k}")
            steps.append(f"regexp_replace({column}_{k}, {quoted(pattern)}, '|', 'g') AS {column}_{k + 1}")
            counts.setdefault(license, {}).setdefault(column, []).append(f"{column}_n{k}")
        steps.append(f"regexp_extract_all({column}_0, {quoted(_any_of(_alone(cut)))}) AS {column}_alone")
        for marks_, license in _alone(cut).items():
            held = f"len(list_filter({column}_alone, lambda x: x = {quoted(marks_)}))"
            counts.setdefault(license, {}).setdefault(column, []).append(held)
    found = ", ".join(
        f"{{'license': {quoted(x)}, 'times': CAST(greatest({' + '.join(counts[x]['line'])}, {' + '.join(counts[x]['paragraph'])}) AS BIGINT)}}"
        for x in sorted(counts)
    )
    stands = f"regexp_replace(regexp_replace(line_marks, '\\{{[^}}]*\\}}', '{UNKNOWN}', 'g'), '[~^]+', '{UNKNOWN}', 'g')"
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM {docs}),
marked AS MATERIALIZED (SELECT doc_id, {marks(LINES)} AS line_marks, {marks(PARAGRAPHS)} AS paragraph_marks FROM low),
taken AS (SELECT doc_id, line_marks, {', '.join(steps)} FROM marked),
found AS (SELECT doc_id, {stands} AS by_line, list_filter([{found}], lambda x: x.times > 0) AS licenses FROM taken)
SELECT doc_id, CAST(len(licenses) AS BIGINT) AS n_licenses,
       array_to_string(list_transform(licenses, lambda x: x.license || ':' || x.times), ',') AS licenses,
       sha256(by_line) AS sequence_sha256
FROM found
"""
