"""License scans by sentence rules.

A text is reduced to its words and the marks between them: ends of sentences, and weak ends (line
ends, brackets, the full stop of "v. 2") at which a sentence may end or go on, so that wrapped and
commented notices read like unwrapped ones. Known licence sentences are found from mark to mark; the
identifiers found, in the order of the text, are then matched against ordered licence rules. A
rule that matches takes its identifiers away, so that a general rule (an unversioned or unnamed
licence) only sees what the more exact rules before it left.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import as_payload, with_outputs

# Known licence sentences (normalised: lower case, other than letters and digits to
# single blanks) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef2",
    "licensed under the apache license version 2 0 the license": "ApacheRef2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "the mit license": "MitName",
    "mit license": "MitName",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdUse",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdName",
    "this work is licensed under the gnu general public license version 2": "GplRef2",
    "this work is licensed under the gnu general public license version 3": "GplRef3",
    "licensed under the gnu general public license version 2": "GplRef2",
    "licensed under the gnu general public license version 3": "GplRef3",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 2 of the license or at your option any later version": "Version2Later",
    "either version 3 of the license or at your option any later version": "Version3Later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "either version 2 1 of the license or at your option any later version": "Version21Later",
    "licensed under the gnu lesser general public license version 3": "LgplRef3",
    "licensed under the gnu affero general public license version 3": "AgplRef3",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MplRef2",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "licensed under cc by nc nd 4 0": "CcByNcNd4",
    "licensed under cc0 1 0": "Cc0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is in the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}

# Fixed values: (licence, identifiers that must follow each other, possibly with others between).
RULES = [
    ("LGPL-2.1-or-later", ["LgplTerms", "Version21Later"]),
    ("GPL-2.0-or-later", ["GplTerms", "Version2Later"]),
    ("GPL-3.0-or-later", ["GplTerms", "Version3Later"]),
    ("BSD-3-Clause", ["BsdUse", "BsdSource", "BsdBinary", "BsdName"]),
    ("BSD-2-Clause", ["BsdUse", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheRef2", "ApacheUse", "ApacheCopy", "ApacheAsIs"]),
    ("Apache-2.0", ["ApacheRef2"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["MitName"]),
    ("LGPL-3.0-only", ["LgplRef3"]),
    ("AGPL-3.0-only", ["AgplRef3"]),
    ("GPL-2.0-only", ["GplRef2"]),
    ("GPL-3.0-only", ["GplRef3"]),
    ("MPL-2.0", ["MplRef2"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd4"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-Domain", ["PublicDomain"]),
    ("GPL-unversioned", ["GplTerms"]),
    ("LGPL-unversioned", ["LgplTerms"]),
    ("Proprietary", ["AllRights"]),
]


_TERMS = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_ONLY = "you can redistribute it and or modify it under the terms of the gnu {0}general public license {1} as published by the free software foundation"

# Sentences as the licences' own notices have them, where they are longer than those above or
# stand in one sentence, and their identifiers. A semicolon within does not matter.
NOTICES = {
    **{f"{_TERMS.format('')} {_LATER.format(v)}": ["GplTerms", i] for v, i in (("2", "Version2Later"), ("3", "Version3Later"))},
    f"{_TERMS.format('lesser ')} {_LATER.format('2 1')}": ["LgplTerms", "Version21Later"],
    f"{_TERMS.format('lesser ')} {_LATER.format('3')}": ["Lgpl3Later"],
    f"{_TERMS.format('library ')} {_LATER.format('2')}": ["Lgpl2Later"],
    f"{_TERMS.format('affero ')} {_LATER.format('3')}": ["Agpl3Later"],
    **{_ONLY.format(kind, f"{word}{v}"): [i] for word in ("version ", "v") for kind, v, i in (("", "2", "GplRef2"), ("", "3", "GplRef3"), ("lesser ", "3", "LgplRef3"), ("affero ", "3", "AgplRef3"))},
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": ["AsIs"],
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": ["ApacheAsIs"],
    **{f"you may obtain a copy of the license at {web} www apache org licenses license 2 0": ["ApacheCopy"] for web in ("http", "https")},
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": ["BsdName"],
}

# Rules of the identifiers that only NOTICES gives, tried before the others.
NOTICE_RULES = [
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-2.0-or-later", ["Lgpl2Later"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
]

# SPDX identifiers that a tag or an expression may name (those ending in -only also without that ending).
SPDX = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Unicode-3.0 Unlicense
UPL-1.0 Vim W3C WTFPL Zlib
""".split()

# Names by which notices refer to licences (normalised, without the word license at their end).
NAMES = {
    "apache license version 2 0": "Apache-2.0",
    "apache license v 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "artistic license 2 0": "Artistic-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "boost software license 1 0": "BSL-1.0",
    "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "2 clause bsd": "BSD-2-Clause",
    "3 clause bsd": "BSD-3-Clause",
    "common development and distribution license version 1 0": "CDDL-1.0",
    "eclipse public license version 1 0": "EPL-1.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "european union public licence version 1 2": "EUPL-1.2",
    "gnu general public license v 2 0": "GPL-2.0-only",
    "gnu general public license v 3 0": "GPL-3.0-only",
    "gnu general public license version 2 0": "GPL-2.0-only",
    "gnu general public license version 3 0": "GPL-3.0-only",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only",
    "isc": "ISC",
    "mit": "MIT",
    "mozilla public license version 1 1": "MPL-1.1",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "postgresql": "PostgreSQL",
    "sil open font license version 1 1": "OFL-1.1",
    "university of illinois ncsa open source": "NCSA",
    "zlib": "Zlib",
    "zlib libpng": "Zlib",
    **{f"creative commons attribution{kind} {v}": f"CC-BY{short}-{v[0]}.0" for v in ("4 0 international", "4 0", "3 0 unported") for kind, short in (("", ""), (" sharealike", "-SA"), (" share alike", "-SA"), (" noncommercial", "-NC"), (" noncommercial sharealike", "-NC-SA"), (" noncommercial noderivatives", "-NC-ND"), (" noderivatives", "-ND"))},
    "creative commons zero v1 0 universal": "CC0-1.0",
    "cc0 1 0 universal": "CC0-1.0",
}

# Sentences of further licences that name them by themselves.
GRANTS = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlib",
    "you just do what the fuck you want to": "WTFPL",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "PostgreSQL",
}

#: What may stand before a licence's name in a sentence that refers to it.
LEAD = r"(?:(?:this|the)[ W]++(?:file|work|project|software|program|code|library|package|content|document|repository)[ W]++is[ W]++)?+(?:licensed|released|distributed|available|provided|published)[ W]++under[ W]++(?:the[ W]++)?+(?:terms[ W]++of[ W]++the[ W]++)?+"

# From raw lower-case text, led by a line end, to words and marks: P (end of a sentence or paragraph), S (semicolon), W (weak end).
MARKS = [
    # each licence of an SPDX expression is a line of its own
    (r"(?:spdx-license-identifier:[ \t(]*+|\G[ \t)]*+(?:or|and|with)[ \t(]++)([a-z0-9.+-]++)", "\nspdx id $1\n"),
    (r"(?<=\nspdx id )([a-z0-9.-]++)\+", "$1-or-later"),
    (r"\n[^a-z0-9\n]*+(?:(?:dnl|rem)(?![a-z0-9])[^a-z0-9\n]*+)?", "\n"),  # comment prefixes
    (r"\n\n+", "P"),
    (r"(?<![a-z0-9])(v|ver|vers)\.\s(?=[0-9])", "$1W"),
    (r"[.!?:]\s", "P"),
    (r";\s", "S"),
    (r"[\n()]", "W"),
    (r"[^a-z0-9PSW]+", " "),
    # the clause on names holds whatever names it has: its second half stands for it
    (r"(?<![a-z0-9])nor[ W]++the[ W]++names[ W]++of[ W]++(?:its[ W]++)?contributors(?![a-z0-9])", "Wnor the names of its contributors"),
]

#: Identifiers of each known sentence; a licence's name is led by "under".
KNOWN = {
    **{s: [i] for s, i in SENTENCES.items()},
    **NOTICES,
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": ["BsdName"],
    **{s: [f"Grant-{x}"] for s, x in GRANTS.items()},
    **{f"under {s}": [f"Ref-{x}"] for s, x in NAMES.items()},
    **{f"spdx id {re.sub('[^a-z0-9]+', ' ', form.lower())}": [f"Spdx-{x}"] for x in SPDX for form in {x, x.removesuffix("-only")}},
}

#: All rules in the order in which they are tried.
ALL_RULES = [*[(x, [f"Spdx-{x}"]) for x in SPDX], *NOTICE_RULES, *[(x, [f"{kind}-{x}"]) for kind, table in (("Grant", GRANTS), ("Ref", NAMES)) for x in dict.fromkeys(table.values())], *RULES]

#: Each identifier as one character (of the private use area), so that a list of them is a string.
CODES = {i: chr(0xE000 + n) for n, i in enumerate(dict.fromkeys(i for ids in KNOWN.values() for i in ids))}


def _words(sentence: str, gap: str) -> str:
    return gap.join(sentence.split())


def _known() -> str:
    """All known sentences from mark to mark, longer ones first, then references by name."""
    joined = {s: "[ WS]++" if s in NOTICES else "[ W]++" for s in KNOWN if not s.startswith("under ")}
    whole = "|".join(_words(s, joined[s]) for s in sorted(joined, key=lambda s: (-len(s), s)))
    names = sorted(NAMES, key=lambda s: (-len(s), s))
    every, long = ("|".join(_words(s, "[ W]++") for s in table) for table in (names, [s for s in names if len(s.split()) > 2]))
    suffix = "[ W]++licen[cs]e"
    named = f"{LEAD}(?:{every})(?:{suffix})?|(?:the[ W]++)?(?:(?:{every}){suffix}|{long})"
    return rf"(?<=[PSW] {{0,1}})(?:{whole}|{named})(?= ?[PSW])"


def _codes(text: Column) -> Column:
    """The identifiers of ``sentence_ids``, a character each."""
    known = F.from_json(F.lit(json.dumps({s: "".join(CODES[i] for i in ids) for s, ids in KNOWN.items()})), "map<string,string>")
    plain = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, mark in MARKS:
        plain = F.regexp_replace(plain, pattern, mark)
    found = F.regexp_extract_all(plain, F.lit(_known()), F.lit(0))

    def code(m: Column) -> Column:
        said = F.regexp_replace(m, "[ WS]+", " ")
        name = F.concat(F.lit("under "), F.regexp_replace(F.regexp_replace(said, f"^(?:{LEAD}|the )", ""), " licen[cs]e$", ""))
        return F.coalesce(F.try_element_at(known, said), F.try_element_at(known, name))

    return F.array_join(F.transform(found, code), "")


def _decoded(codes: Column) -> Column:
    names = F.from_json(F.lit(json.dumps({c: i for i, c in CODES.items()})), "map<string,string>")
    return F.transform(F.filter(F.split(codes, ""), lambda c: c != ""), lambda c: F.try_element_at(names, c))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in its order (null of a null text).

    Sentences end at . ! ? ; : before white space and at blank lines, and may end at line ends and
    brackets; commas do not end one, as licence names have them. Of several known sentences from one
    mark the longest counts. Each licence of an SPDX tag's expression is a sentence.
    """
    return _decoded(_codes(text))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (in the order of the text), ``licenses`` (in the order of the rules, each
    as often as found), ``license`` (the first of them, or null) and ``unresolved`` (identifiers that no rule took).

    A rule takes the first of its identifiers and then the next one of each that follows, again and again up to
    the end; those between stay. Time is linear in the text for each rule, however many identifiers it has.

    Null and empty texts have none; texts of any length are scanned whole; repeated rows are rows
    of their own; an empty table gives no rows; input columns named like an output give way.
    """

    def rule(name: str, ids: list[str]) -> dict:
        first, *others = (CODES[i] for i in ids)
        # to the next one of each; where one is missing, it is to all later beginnings too: the rest stays
        taken = first + "".join(f"([^{c}]*+){c}" for c in others)
        keep = "".join(f"${k}" for k in range(1, len(others) + 2))
        return {"name": name, "first": first, "ids": f"{taken}|({first}.*+)", "keep": keep, "n": len(ids)}

    rules = F.from_json(F.lit(json.dumps([rule(*r) for r in ALL_RULES])), "array<struct<name:string,first:string,ids:string,keep:string,n:int>>")
    rows = docs.select(as_payload(docs), _codes(F.coalesce(F.col(text), F.lit(""))).alias("_ids"))
    none = F.array().cast("array<string>")

    def step(state: Column, rule: Column) -> Column:
        left = F.regexp_replace(state["left"], rule["ids"], rule["keep"])
        times = ((F.length(state["left"]) - F.length(left)) / rule["n"]).cast("int")
        taken = F.struct(left.alias("left"), F.concat(state["found"], F.array_repeat(rule["name"], times)).alias("found"))
        return F.when(F.contains(state["left"], rule["first"]), taken).otherwise(state)

    # most texts have no licence sentence: no rule is tried on them
    start = F.struct(F.col("_ids").alias("left"), none.alias("found"))
    rows = rows.withColumn("_done", F.when(F.col("_ids") != "", F.aggregate(rules, start, step)).otherwise(start))
    return with_outputs(rows, docs.columns, {"sentence_ids": _decoded(F.col("_ids")), "licenses": F.col("_done.found"), "license": F.get(F.col("_done.found"), 0), "unresolved": _decoded(F.col("_done.left"))})
