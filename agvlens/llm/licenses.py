"""Licence recognition by sentences.

A text is cut into sentences, each is normalised and looked up among the known licence sentences; the identifiers
found, in order, make a sequence. Ordered rules then take runs of identifiers out of the sequence, the most specific
first, and name the licence; what is left of licence-like sentences is reported as unknown. The knowledge is fixed
and small, so both steps are expressions over one row: no shuffle, no join.

A sentence may be wrapped over lines: it is looked up whole, within its paragraph, and only if it is not known so are its lines
looked up one by one. ``KNOWN`` and ``ALL_RULES`` are all there is to know; the registered SQL is made from them and the same patterns.

Defined cases: a null or empty text has no sentences and no licences; repeated sentences count each; an empty table gives
an empty table; other columns are left out; a very long text is one row's work, in time that grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised (lower case, single spaces, no punctuation but dots within numbers), by identifier.
SENTENCES = {
    "apache2": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"),
    "apacheuse": ("you may not use this file except in compliance with the license",),
    "apachecopy": ("you may obtain a copy of the license at",),
    "asis": ("the software is provided as is without warranty of any kind express or implied",
             "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    "mit": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mitgrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",),
    "mitkeep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "gpl3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl2": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "orlater": ("either version 2 of the license or at your option any later version", "either version 3 of the license or at your option any later version"),
    "gplfree": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "bsdgrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsdname": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "ccbync4": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"),
    "ccby4": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0"),
    "ccbysa4": ("licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"),
    "reserved": ("all rights reserved",),
}

# The rules in order; each is a sequence of identifiers and the licence it means.
RULES = (
    ("Apache-2.0", ("apache2", "apacheuse", "apachecopy", "asis")),
    ("Apache-2.0", ("apache2", "apacheuse", "apachecopy")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mitgrant", "mitkeep", "asis")),
    ("MIT", ("mitgrant", "mitkeep")),
    ("MIT", ("mit",)),
    ("GPL-2.0-or-later", ("gplfree", "orlater")),
    ("GPL-3.0-or-later", ("gpl3", "orlater")),
    ("GPL-2.0-or-later", ("gpl2", "orlater")),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("BSD-3-Clause", ("bsdgrant", "bsdname", "asis")),
    ("BSD-3-Clause", ("bsdgrant", "bsdname")),
    ("BSD-2-Clause", ("bsdgrant",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("Proprietary", ("reserved",)),
)

_GPL = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_BSD = {
    "bsdsource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsdbinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsdname": SENTENCES["bsdname"][0],
}

# Sentences of the standard texts in full, normalised likewise.
WHOLE_SENTENCES = {
    "apachesee": ("see the license for the specific language governing permissions and limitations under the license",),
    "mittitle": ("mit license", "the mit license", "the mit license mit"),
    "mitgrant": (f"{SENTENCES['mitgrant'][0]} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "asis": (f"{SENTENCES['asis'][0]} including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "noliability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
                    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    "gplprogram": ("this program is free software",),
    "gplterms": (_GPL,),
    "gplnotice2": tuple(f"{start}{_GPL} {_LATER.format(2)}" for start in ("this program is free software ", "")),
    "gplnotice3": tuple(f"{start}{_GPL} {_LATER.format(3)}" for start in ("this program is free software ", "")),
    "orlater3": (_LATER.format(3),),
    "gplhope": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "gplimplied": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gplsee": ("see the gnu general public license for more details",),
    "gplcopy": ("you should have received a copy of the gnu general public license along with this program",),
    "bsdtitle": ("bsd 3 clause license", "bsd 2 clause license", "the 3 clause bsd license", "the 2 clause bsd license"),
    "bsdgrant": (f"{SENTENCES['bsdgrant'][0]} 1",),  # the number of the first condition, on the next line
    **{name: (form, *(f"{i} {form}" for i in (1, 2, 3))) for name, form in _BSD.items()},
    "bsdasis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
}

_BSD2, _BSD3 = ("bsdgrant", "bsdsource", "bsdbinary"), ("bsdgrant", "bsdsource", "bsdbinary", "bsdname")

# Rules that go before RULES.
WHOLE_RULES = (
    *(("BSD-3-Clause", (*before, *_BSD3, *after)) for before in (("reserved",), ()) for after in (("bsdasis",), ())),
    *(("BSD-2-Clause", (*before, *_BSD2, *after)) for before in (("reserved",), ()) for after in (("bsdasis",), ())),
    ("GPL-2.0-or-later", ("gplprogram", "gplterms", "orlater")),
    ("GPL-3.0-or-later", ("gplprogram", "gplterms", "orlater3")),
    ("GPL-2.0-or-later", ("gplprogram", "gplnotice2")),
    ("GPL-3.0-or-later", ("gplprogram", "gplnotice3")),
    ("GPL-2.0-or-later", ("gplnotice2",)),
    ("GPL-3.0-or-later", ("gplnotice3",)),
    ("GPL-3.0-or-later", ("gplfree", "orlater3")),
    ("GPL-3.0-or-later", ("gpl3", "orlater3")),
)

# Further licences by the sentences of their notices, normalised likewise.
MORE_SENTENCES = {
    "iscgrant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
                 "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "iscasis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "iscliability": ("in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "mplsubject": ("this source code form is subject to the terms of the mozilla public license v",),
    "unlicensefree": ("this is free and unencumbered software released into the public domain",),
    "unlicenseuse": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "lgpllibrary": ("this library is free software",),
    "lgplterms": (_GPL.replace("gnu general", "gnu lesser general"),),
    "orlater21": (_LATER.format(2.1),),
    "lgplnotice3": tuple(f"this {what} is free software {_GPL.replace('gnu general', 'gnu lesser general')} {_LATER.format(3)}" for what in ("program", "library")),
    "agplnotice3": (f"this program is free software {_GPL.replace('gnu general', 'gnu affero general')} {_LATER.format(3)}",),
    "epl2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
             "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution and is available at https www.eclipse.org legal epl 2.0"),
    "cc0waiver": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "cc0": ("licensed under cc0 1.0", "this work is licensed under cc0 1.0"),
    "ccbynd4": ("licensed under cc by nd 4.0", "this work is licensed under cc by nd 4.0"),
    "ccbyncsa4": ("licensed under cc by nc sa 4.0", "this work is licensed under cc by nc sa 4.0"),
}

# The rules of these, longest first.
MORE_RULES = (
    ("ISC", ("iscgrant", "iscasis", "iscliability")),
    ("ISC", ("iscgrant", "iscasis")),
    ("ISC", ("iscgrant",)),
    ("MPL-2.0", ("mplsubject",)),
    ("Unlicense", ("unlicensefree", "unlicenseuse")),
    ("Unlicense", ("unlicensefree",)),
    ("LGPL-2.1-or-later", ("lgpllibrary", "lgplterms", "orlater21")),
    ("LGPL-3.0-or-later", ("lgpllibrary", "lgplterms", "orlater3")),
    ("LGPL-3.0-or-later", ("gplprogram", "lgplterms", "orlater3")),
    ("LGPL-3.0-or-later", ("lgplnotice3",)),
    ("AGPL-3.0-or-later", ("agplnotice3",)),
    ("EPL-2.0", ("epl2",)),
    ("CC0-1.0", ("cc0waiver",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-ND-4.0", ("ccbynd4",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4",)),
)

NAMES = tuple(dict.fromkeys(n for n, _ in (*RULES, *MORE_RULES)))
#: A tag that names a licence by its identifier, as "SPDX-License-Identifier: MIT".
TAGS = {f"spdx:{n}": (f"spdx license identifier {n.lower().replace('-', ' ')}",) for n in NAMES if n != "Proprietary"}

#: Every known sentence and the identifier it stands for, and every rule in its order.
KNOWN = {form: name for part in (SENTENCES, WHOLE_SENTENCES, MORE_SENTENCES, TAGS) for name, forms in part.items() for form in forms}
ALL_RULES = (*WHOLE_RULES, *MORE_RULES, *RULES, *((name.removeprefix("spdx:"), (name,)) for name in TAGS))

HINTS = r"(^| )(licensed?|licence|copyright|warrant(y|ies))( |$)"  # a sentence that is not known but speaks of licences
BREAKS = r"(?:[.!?;]+\s+|\n+)"
PARAGRAPHS = r"\n[^\p{L}\p{N}]*\n"  # empty lines, or with comment marks only
STOPS = r"[.!?;]+\s+"
WORTH = "(?i)licen|copyright|warrant|permi|software|rights reserved"  # only sentences with one of these need normalising
NORMAL = ((r"[^\p{L}\p{N}.]+", " "), (r"\.+( |$)", " "), (" +", " "))  # replaced in this order, after lower-casing


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's sentences in order; "unknown" for licence-like ones that are not listed."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def normal(s: Column) -> Column:
        s = F.lower(s)
        for pattern, by in NORMAL:
            s = F.regexp_replace(s, pattern, by)
        return F.trim(s)

    def name(s: Column) -> Column:
        n = normal(s)
        return F.coalesce(known[n], F.when(n.rlike(HINTS), F.lit("unknown")))

    def names(s: Column) -> Column:
        whole = known[normal(s)]
        lines = F.transform(F.filter(F.split(s, "\n+"), lambda x: x.rlike(WORTH)), name)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    parts = F.flatten(F.transform(F.split(text, PARAGRAPHS), lambda x: F.split(x, STOPS)))
    parts = F.filter(parts, lambda s: s.rlike(WORTH))
    return F.filter(F.flatten(F.transform(parts, names)), lambda s: s.isNotNull())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids, licences (with how often) and n_unknown of each text."""
    t = F.col(f"`{text}`")
    ids = F.when(t.rlike(WORTH), sentence_ids(t)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    rest = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))  # every identifier between two spaces
    for i, (_, sequence) in enumerate(ALL_RULES):
        pattern = "  ".join(sequence)
        rows = rows.withColumn(f"r{i}", rest).withColumn(f"q{i}", F.replace(F.col(f"r{i}"), F.lit(f" {pattern} "), F.lit(" | ")))
        rest = F.col(f"q{i}")
    # a match of a sequence of length L leaves a bar in place of it
    bars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    count = {n: sum((bars(F.col(f"q{i}")) - bars(F.col(f"r{i}")) for i, (m, _) in enumerate(ALL_RULES) if m == n), F.lit(0)) for n in NAMES}
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("licence"), count[n].cast("long").alias("n")) for n in NAMES]), lambda s: s["n"] > 0)
    unknown = F.size(F.filter("ids", lambda s: s == "unknown"))
    return rows.select(F.col("__id").alias(key), F.col("ids").alias("sentence_ids"), found.alias("licences"), unknown.cast("long").alias("n_unknown"))
