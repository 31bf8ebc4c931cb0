"""Licence scan by sentence rules, with DataFrame expressions only.

A text is cut into sentences (after `.`, `!`, `?` followed by white space, at blank lines, and after the colons and brackets inside
the sentences of MIT, BSD and Apache), each is normalised (lower case, anything but a-z and 0-9 one blank) and mapped to
the identifier of a known licence sentence. A sentence may be wrapped over lines and may begin at any of its lines;
where none does, each line that is a known sentence by itself counts, as do such lines before its beginning. The
identifiers, in the order of the text, are matched against an ordered list of rules, each a run of identifiers that
must follow one another (other sentences between known ones do not count); the first rule that fits decides.

Null and empty texts have no sentences and the verdict `none`. A sentence that is found twice counts twice.
Repeated rows are judged alike; ids may be null and other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences that notices name: identifier of the notice, licence, verdict, names as they stand in a notice, normalised. Fixed values.
NAMED: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("MIT_NOTICE", "MIT", "permissive", ("the mit license", "an mit license")),
    ("APACHE2_NOTICE", "Apache-2.0", "permissive", ("the apache license version 2 0", "the apache license 2 0")),
    ("BSD3_NOTICE", "BSD-3-Clause", "permissive", ("the bsd 3 clause license", "the 3 clause bsd license")),
    ("BSD2_NOTICE", "BSD-2-Clause", "permissive", ("the bsd 2 clause license", "the 2 clause bsd license")),
    ("ISC_NOTICE", "ISC", "permissive", ("the isc license",)),
    ("ZLIB_NOTICE", "Zlib", "permissive", ("the zlib license",)),
    ("BOOST_NOTICE", "BSL-1.0", "permissive", ("the boost software license version 1 0",)),
    ("UNLICENSE_NOTICE", "Unlicense", "permissive", ("the unlicense license",)),
    ("GPL3_NOTICE", "GPL-3.0", "copyleft", ("the gnu general public license version 3", "the gnu general public license v3 0")),
    ("GPL2_NOTICE", "GPL-2.0", "copyleft", ("the gnu general public license version 2", "the gnu general public license v2 0")),
    ("LGPL3_NOTICE", "LGPL-3.0", "copyleft", ("the gnu lesser general public license version 3",)),
    ("LGPL21_NOTICE", "LGPL-2.1", "copyleft", ("the gnu lesser general public license version 2 1",)),
    ("AGPL3_NOTICE", "AGPL-3.0", "copyleft", ("the gnu affero general public license version 3",)),
    ("MPL2_NOTICE", "MPL-2.0", "copyleft", ("the mozilla public license version 2 0",)),
    ("EPL2_NOTICE", "EPL-2.0", "copyleft", ("the eclipse public license version 2 0",)),
    ("ARTISTIC2_NOTICE", "Artistic-2.0", "permissive", ("the artistic license 2 0",)),
    ("CC_BY_NC_NOTICE", "CC-BY-NC-4.0", "noncommercial", ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license")),
    ("CC_BY_NC_SA_NOTICE", "CC-BY-NC-SA-4.0", "noncommercial", ("cc by nc sa 4 0",
        "a creative commons attribution noncommercial sharealike 4 0 international license")),
    ("CC_BY_NC_ND_NOTICE", "CC-BY-NC-ND-4.0", "noncommercial", ("cc by nc nd 4 0",
        "a creative commons attribution noncommercial noderivatives 4 0 international license")),
    ("CC_BY_ND_NOTICE", "CC-BY-ND-4.0", "restricted", ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license")),
    ("CC_BY_SA_NOTICE", "CC-BY-SA-4.0", "copyleft", ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license")),
    ("CC_BY_NOTICE", "CC-BY-4.0", "permissive", ("cc by 4 0", "a creative commons attribution 4 0 international license")),
)
#: How a notice begins, normalised. Fixed values.
LEADS = (
    "licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under",
        "this software is licensed under", "this file is licensed under",
    "this document is licensed under", "this text is licensed under", "this program is licensed under", "this library is licensed under",
        "the code is licensed under",
)
#: Known sentences: notices by rule (a lead and a name), and others. Fixed values.
SENTENCES: dict[str, str] = {
    f"{lead} {name}": notice for notice, _, _, names in NAMED for name in names for lead in LEADS
} | {
    "you may not use this file except in compliance with the license": "APACHE2_COMPLIANCE",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_CONDITION",
    "the software is provided as is without warranty of any kind express or implied": "MIT_WARRANTY",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPL_GRANT",
    "redistributions of source code must retain the above copyright notice": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD_BINARY",
    "this work is dedicated to the public domain": "PUBLIC_DOMAIN",
    "this is free and unencumbered software released into the public domain without notice": "PUBLIC_DOMAIN",
    "all rights reserved": "RESERVED",
}

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_MIT = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
_BSD = "this list of conditions and the following disclaimer"
#: Complete sentences of the customary licence texts, normalised; they are taken besides those above.
FULL_SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0 the license": "APACHE2_NOTICE",
    "the asf licenses this file to you under the apache license version 2 0 the license": "APACHE2_NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT_CONDITION",
    f"{_MIT} noninfringement": "MIT_WARRANTY",
    f"{_MIT} non infringement": "MIT_WARRANTY",
    f"{_GPL} as published by the free software foundation either version 3 of the license or at your option any later version": "GPL_GRANT",
    f"{_GPL} as published by the free software foundation either version 2 of the license or at your option any later version": "GPL_GRANT",
    f"{_GPL} as published by the free software foundation either version 2 or at your option any later version": "GPL_GRANT",
    f"{_GPL} as published by the free software foundation version 3 of the license": "GPL_GRANT",
    f"{_GPL} as published by the free software foundation version 2 of the license": "GPL_GRANT",
    f"{_GPL} version 3 as published by the free software foundation": "GPL_GRANT",
    f"{_GPL} version 2 as published by the free software foundation": "GPL_GRANT",
    f"redistributions of source code must retain the above copyright notice {_BSD}": "BSD_SOURCE",
    f"redistributions in binary form must reproduce the above copyright notice {_BSD} in the documentation and or other materials provided with the distribution": "BSD_BINARY",
}
KNOWN = SENTENCES | FULL_SENTENCES

#: A line without words, which ends a paragraph (comment marks may stand in it), and the end of a sentence.
BLANK, END = r"\n(?:[ \t\r*#/;-]*\n)+", r'([.!?]|\(the .{0,8}license.{0,8}\);|\b(?:met|conditions):)\s+'

#: Words, or words in a row, of every known sentence; a text without any of them has no known sentence.
ANCHORS = ("licensed", "license", "reserved", "notice", "warranty", "dedicated", "cc by")

#: (rule, identifiers that must follow one another, licence, verdict), tried in this order: notices that reserve all rights
#: after all, dual licences, licence texts, notices.
RULES: tuple[tuple[str, tuple[str, ...], str, str], ...] = (
    *((f"reserved-over-{lic.lower()}", (notice, "RESERVED"), lic, "conflict") for notice, lic, verdict, _ in NAMED if verdict == "permissive"),
    ("dual-mit-apache", ("MIT_NOTICE", "APACHE2_NOTICE"), "MIT OR Apache-2.0", "permissive"),
    ("dual-apache-mit", ("APACHE2_NOTICE", "MIT_NOTICE"), "MIT OR Apache-2.0", "permissive"),
    ("mit-full", ("MIT_CONDITION", "MIT_WARRANTY"), "MIT", "permissive"),
    ("bsd-full", ("BSD_SOURCE", "BSD_BINARY"), "BSD", "permissive"),
    ("apache-full", ("APACHE2_NOTICE", "APACHE2_COMPLIANCE"), "Apache-2.0", "permissive"),
    ("gpl-grant", ("GPL_GRANT",), "GPL", "copyleft"),
    *((f"notice-{lic.lower()}", (notice,), lic, verdict) for notice, lic, verdict,
        _ in sorted(NAMED, key=lambda x: ("copyleft", "noncommercial", "restricted", "permissive").index(x[2]))),
    ("public-domain", ("PUBLIC_DOMAIN",), "public-domain", "permissive"),
    ("reserved", ("RESERVED",), "proprietary", "restricted"),
)


def sentence_ids(text: Column, sentences: dict[str, str] = KNOWN, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """Identifiers of the known sentences of a text, in its order (array<string>)."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    most = max(len(s.split()) for s in sentences)  # lines of a sentence
    low = F.lower(text)

    def anchored(c: Column) -> Column:
        out = F.lit(False)
        for a in anchors:
            out = out | (c.rlike("[^a-z0-9]+".join(a.split())) if " " in a else c.contains(a))
        return out

    of = lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    none = F.expr("cast(array() as array<string>)")

    def found(unit: Column) -> Column:
        lines = F.split(unit, "\n")
        n = F.size(lines)
        alone = F.transform(lines, of)
        start = F.greatest(n - most, F.lit(0))
        tails = F.transform(F.slice(lines, start + 1, F.lit(most)), lambda _, i: of(F.array_join(F.slice(lines, start + i + 1, F.lit(most)), " ")))
        # the lines before the first line with which a sentence begins that goes to the end, and that sentence
        ended = F.aggregate(tails, F.struct(start.alias("at"), F.lit(None).cast("string").alias("id")),
                            lambda s, t: F.when(s["id"].isNotNull(), s).otherwise(F.struct((s["at"] + t.isNull().cast("int")).alias("at"),
                                t.alias("id"))),
                            lambda s: F.concat(F.slice(alone, F.lit(1), s["at"]), F.array(s["id"])))
        return F.when(n == 1, F.array(of(unit))).otherwise(ended)

    units = F.filter(F.split(F.regexp_replace(F.regexp_replace(low, BLANK, "\n\n"), END, "$1\n\n"), "\n\n"), anchored)
    ids = F.filter(F.flatten(F.transform(units, found)), lambda x: x.isNotNull())
    return F.when(anchored(low), ids).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sentences: dict[str, str] = KNOWN, anchors: tuple[str, ...] = ANCHORS, rules=RULES) -> DataFrame:
    """`id_col`, sentence_ids (array<string>), rule, license, verdict, for each row; no shuffle.

    rule and license are null, and the verdict is `none`, where no rule fits; `unknown` where known sentences
    stand in no rule.
    """
    for s in sentences:
        if not any(f" {a} " in f" {s} " for a in anchors):
            raise ValueError(f"no anchor word in known sentence: {s}")
    found = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit("")), sentences, anchors).alias("sentence_ids"))
    run = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hit = None
    for name, ids, license_, verdict in rules:
        value = F.struct(F.lit(name).alias("rule"), F.lit(license_).alias("license"), F.lit(verdict).alias("verdict"))
        cond = run.contains("," + ",".join(ids) + ",")
        hit = F.when(cond, value) if hit is None else hit.when(cond, value)
    return found.select(id_col, "sentence_ids", hit.alias("hit")).select(
        id_col, "sentence_ids", F.col("hit.rule").alias("rule"), F.col("hit.license").alias("license"),
        F.coalesce(F.col("hit.verdict"), F.when(F.size("sentence_ids") > 0, "unknown").otherwise("none")).alias("verdict"),
    )
