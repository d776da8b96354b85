import re

from hertzflow.llm import license_scan as L


def found(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    rows = {r.doc_id: [(x.license, x.times) for x in r.licenses] for r in L.scan(df).collect()}
    return [rows[i] for i in range(len(texts))]


def wrapped(name, width=60):
    words, lines = L.SENTENCES[name].split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += w + " "
    return "\n".join(x.strip() for x in lines)


def test_rules_in_order(spark):
    mit = "Copyright (c) A. Person\n\n" + ":\n\n".join(
        [wrapped("mit-grant"), wrapped("mit-keep") + ".\n\n" + wrapped("mit-as-is") + "."]
    )
    bsd = wrapped("bsd-grant") + ":\n\n" + ".\n\n".join(map(wrapped, ("bsd-source", "bsd-binary"))) + ".\n"
    apache = "// " + wrapped("apache-grant").replace("\n", "\n// ") + ";\n// " + L.SENTENCES["apache-only"] + ".\n"
    got = found(
        spark,
        mit,
        bsd,
        bsd + "\n" + wrapped("bsd-names") + ".",
        apache,
        "some prose\nReleased under the MIT License.\nMore prose",
        "x. LICENSED under CC BY-NC 4.0. y. Licensed under CC BY-NC 4.0.",
        None,
        "",
        "nothing here",
        "a license is mentioned, no sentence is known",
        ("word " * 40_000) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "x " * 9,
    )
    assert got == [
        [("MIT", 1)],
        [("BSD-2-Clause", 1)],
        [("BSD-3-Clause", 1)],
        [("Apache-2.0", 1)],
        [("MIT", 1)],
        [("CC-BY-NC-4.0", 2)],
        [],
        [],
        [],
        [],
        [("GPL-3.0-only", 1)],
    ]


def test_a_known_sentence_always_shows_a_sign():
    for cut in (L.LINES, L.PARAGRAPHS):
        for wording in L.SENTENCES.values():
            assert re.search(L.SIGNS, wording.lower())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(df).count() == 0


BSD_3 = """Copyright 2020 A. Person

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def test_published_numbered_bsd_texts(spark):
    head, names, tail = BSD_3.partition("3. Neither")[0], *re.split(r"(?=\n\nTHIS)", "3. Neither" + BSD_3.partition("3. Neither")[2])
    advert = "3. All advertising materials mentioning features or use of this software must display the following\nacknowledgement: This product includes software developed by X.\n\n4"
    comment = "/*\n" + "".join(f" * {x}\n" for x in BSD_3.split("\n")) + " */"
    texts = {
        BSD_3: "BSD-3-Clause",
        head + tail: "BSD-2-Clause",
        re.sub(r"(?m)^(\d)\. ", r"(\1) ", BSD_3): "BSD-3-Clause",
        re.sub(r"(?m)^(\d)\. ", r"    \1) ", BSD_3): "BSD-3-Clause",
        re.sub(r"(?m)^\d\. ", "iv. ", BSD_3): "BSD-3-Clause",
        re.sub(r"(?m)^\d\. ", "* ", BSD_3): "BSD-3-Clause",
        comment: "BSD-3-Clause",
        BSD_3.replace("the copyright holder nor", "Some Inc. nor").replace("Inc.", "Inc"): "BSD-3-Clause",
        head + advert + names[1:] + tail: "BSD-4-Clause",
    }
    assert found(spark, *texts) == [[(name, 1)] for name in texts.values()]


def test_partial_texts_count_once(spark):
    grant, keep, as_is = (L.SENTENCES[x] for x in ("mit-grant", "mit-keep", "mit-as-is"))
    other = "Something else about the software"
    texts = [". ".join(x) + "." for x in (
        (grant, other, as_is), (grant, as_is), (other, keep, as_is), (grant, keep, other), (grant, other, keep, other, as_is), (grant,),
    )]
    got = found(spark, *texts, L.SENTENCES["bsd-grant"] + ":\n1. Changed.\n", as_is + ".", " 1. a. ii.")
    assert got == [[("MIT", 1)]] * 6 + [[("BSD", 1)], [], []]


def test_reported_sequence_has_markers_as_unknown(spark):
    df = spark.createDataFrame([(1, "1. Released under the MIT License. 2) Released under the MIT License")], "doc_id long, text string")
    row = L.scan(df).first()
    assert row.by_line == "~<mit-short>~" and [tuple(x) for x in row.licenses] == [("MIT", 2)]


def test_very_many_sentences(spark):
    text = "One. 2. Three. " * 50_000 + "1 2 " * 100_000 + ".\n1. Released under the MIT License.\n"
    assert found(spark, text) == [[("MIT", 1)]]


def notices():
    s = L.SENTENCES | L.MORE_SENTENCES
    return {
        f"{s['lgpl-free']}; {s['lgpl21-terms']}; {s['lgpl21-version']}.": "LGPL-2.1-or-later",
        f"{s['lgpl-free']}: {s['lgpl3-terms']}.": "LGPL-3.0-or-later",
        f" * {s['gpl-free']}: {s['agpl3-terms']}.\n": "AGPL-3.0-or-later",
        f"{s['gpl-free']}; {s['gpl2-terms']}; {s['gpl2-version']}.": "GPL-2.0-or-later",
        f"Boost Software License\n\n{s['boost-grant']}:\n": "BSL-1.0",
        f"// {s['boost-notice']}. (See accompanying file LICENSE_1_0.txt)": "BSL-1.0",
        f"This software is provided 'as-is', without any express or implied warranty. In no event will the authors be liable.\n\n{s['zlib-grant']}:\n1. The origin.": "Zlib",
        f"{s['epl2-notice']}\n": "EPL-2.0",
        f"All rights reserved. {s['epl1-notice']}\n": "EPL-1.0",
        f"{s['cc0-waiver']}. ": "CC0-1.0",
        f"{s['artistic2-notice']}\n": "Artistic-2.0",
        f"{s['wtfpl-copy']}.\n\n0. You just do.": "WTFPL",
        f"{s['0bsd-grant']}.\n": "0BSD",
        **{f"x\n# SPDX-License-Identifier: {tag}\ny": tag for tag in L.TAGS},
    }


def test_more_licenses(spark):
    texts = notices()
    assert found(spark, *texts) == [[(name, 1)] for name in texts.values()]
    for wording in L.MORE_SENTENCES.values():
        assert re.search(L.SIGNS, wording.lower()) or wording in (L.MORE_SENTENCES["bsd-advert"], L.MORE_SENTENCES["apache11-notice"])


def test_sql_has_the_present_rules(spark):
    """Numbered, partial and changed texts have the same result in SQL."""
    import duckdb
    import pandas as pd
    from pyspark.sql import functions as F

    grant, keep, as_is = (L.SENTENCES[x] for x in ("mit-grant", "mit-keep", "mit-as-is"))
    texts = [BSD_3, re.sub(r"(?m)^(\d)\. ", r"(\1) ", BSD_3), BSD_3.replace("the copyright holder nor", "Some Inc nor"), None, ""]
    texts += [f"{grant}. Other. {as_is}.", f"{keep}. {as_is}.", "1. Released under the MIT License. 2) Released under the MIT License", *notices()]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(L.scan_sql()).df().sort_values("doc_id", ignore_index=True)
    rows = L.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["times"].cast("string")))
    got = rows.select("doc_id", F.array_join(each, ",").alias("licenses"), F.sha2(F.col("by_line").cast("binary"), 256).alias("sha")).orderBy("doc_id").toPandas()
    assert got["licenses"].tolist() == want["licenses"].tolist() and got["sha"].tolist() == want["sequence_sha256"].tolist()
    assert (got["licenses"] != "").sum() >= len(texts) - 2
