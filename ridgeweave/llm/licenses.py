r"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut at sentence ends, blank lines and around title lines; a single
line feed is white space, as licence texts are wrapped. Texts and sentences
without any of the words that known sentences share are passed over. Each other
sentence is normalised to lower-case letters, digits and single blanks, and
looked up in the map of known sentences. Where it is none of them as a whole,
known sentences are found anywhere in it, unless "not" stands before them;
titles have to be the whole of it.
The known identifiers, in the text's order, are then matched against ordered
rules: at each place the first rule wins whose identifiers follow one another
there, and the scan goes on behind it. Longer rules stand before the shorter
ones that they contain, so three clauses of BSD don't count as two.

Known sentences and rules are literals of fixed number, so no row is shuffled.

Defined results: a null or empty text has no sentences and no licences; null
ids and repeated rows are kept as they are; an empty table gives no rows;
further columns pass through ``scan``. Texts of any length are read whole. Of
known sentences that begin at one place the longest counts, and of rules that
fit there the first.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeweave.llm import text as T

P = "__license_"
_TITLE = r"(?:[Tt][Hh][Ee] )?[Mm][Ii][Tt] [Ll][Ii][Cc][Ee][Nn][Ss][Ee](?: \([Mm][Ii][Tt]\))?"
_BLANK = r"[\x20\x09\x0D]"
SENTENCE_END = rf"(?<![Ii]dentifier)(?<![\x20\x09-\x0D][Vv])[.;:!?]+[\x20\x09-\x0D]+|\n{_BLANK}*\n|\n(?={_BLANK}*{_TITLE}{_BLANK}*(?:\n|$))|(?<={_TITLE}){_BLANK}*\n"

#: Sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-title": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-title": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-title": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-title": "this work is dedicated to the public domain under cc0 1 0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "v2-or-later": "either version 2 of the license or at your option any later version",
    "v21-or-later": "either version 2 1 of the license or at your option any later version",
    "v3-or-later": "either version 3 of the license or at your option any later version",
    "gpl2-head": "gnu general public license version 2 june 1991",
    "gpl3-head": "gnu general public license version 3 29 june 2007",
    "lgpl21-head": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-head": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-head": "gnu affero general public license version 3 19 november 2007",
    "apache-head": "apache license version 2 0 january 2004",
    "mpl-head": "mozilla public license version 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "bsl-grant": "boost software license version 1 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Identifiers that stand behind "SPDX-License-Identifier:".
SPDX = (
    "MIT ISC 0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later"
    " LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 Unlicense Zlib"
).split()
SENTENCES |= {f"spdx-{x}": "spdx license identifier " + " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()) for x in SPDX}
#: Each known sentence has one of these in some word.
WORDS = ("licens", "permi", "redistribut", "copyright", "warrant", "reserved", "software", "either", "domain")

#: Titles, which count as whole sentences only.
TITLES = {"the mit license": "mit-title", "the mit license mit": "mit-title", "mit license": "mit-title", "mit license mit": "mit-title"}

#: Ordered rules: a licence and the identifiers that state it.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache-the", "apache-comply", "apache-copy", "apache-unless")),
    ("Apache-2.0", ("apache-the", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-or-later",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-the",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-title",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-title",)),
    ("CC0-1.0", ("cc0-title",)),
    ("MPL-2.0", ("mpl-form",)),
    ("all-rights-reserved", ("reserved",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute", "v2-or-later")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "v2-or-later")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "v3-or-later")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute", "v21-or-later")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute", "v3-or-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-redistribute", "v3-or-later")),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "v3-or-later")),
    ("GPL-2.0", ("gpl2-head",)),
    ("GPL-3.0", ("gpl3-head",)),
    ("LGPL-2.1", ("lgpl21-head",)),
    ("LGPL-3.0", ("lgpl3-head",)),
    ("AGPL-3.0", ("agpl3-head",)),
    ("Apache-2.0", ("apache-head",)),
    ("MPL-2.0", ("mpl-head",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant",)),
    *((x, (f"spdx-{x}",)) for x in SPDX),
)


def normal(sentence: Column) -> Column:
    """Lower-case letters and digits with single blanks between; bullets and numbers in front go."""
    plain = F.trim(F.regexp_replace(T.lower_ascii(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, r"^(?:[0-9]{1,2} |[a-z] )(?=redistributions |neither )", "")


def worth_reading(text: Column) -> Column:
    """Whether a text of lower-case letters has one of the words that known sentences share."""
    return text.rlike("|".join(WORDS))


def known_sentences(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """(at, id) of the known sentences of a text, in order."""
    inside = sorted((x for x in sentences.values() if x not in TITLES), key=len, reverse=True)
    pattern = rf"(?<![a-z0-9])(?<!\bnot )(?:{'|'.join(inside)})(?![a-z0-9])"
    ids = F.create_map(*chain.from_iterable((F.lit(s), F.lit(k)) for s, k in ({s: k for k, s in sentences.items()} | TITLES).items()))

    def within(s: Column, i: Column) -> Column:
        at = lambda k: F.struct(i.alias("at"), k.alias("id"))
        whole = F.try_element_at(ids, s)
        return T.let(whole, lambda k: F.when(k.isNotNull(), F.array(at(k))).when(worth_reading(s), F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda x: at(F.try_element_at(ids, x)))).otherwise(F.array().cast("array<struct<at:int,id:string>>")))

    found = F.flatten(F.transform(F.split(text, SENTENCE_END), lambda x, i: T.let(normal(x), lambda s: within(s, i))))
    return F.when(worth_reading(T.lower_ascii(text)), found).otherwise(F.array().cast("array<struct<at:int,id:string>>"))


def match_rules(ids: Column, rules: tuple = RULES) -> Column:
    """Licences of a sequence of identifiers, by the first rule at each place."""
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, seq)).alias("ids")) for name, seq in rules])

    def step(a: Column, k: Column) -> Column:
        first = F.get(F.filter(table, lambda r: F.slice(ids, k, F.size(r["ids"])) == r["ids"]), F.lit(0))
        return F.when(k < a["next"], a).otherwise(T.let(first, lambda r: F.struct((k + F.coalesce(F.size(r["ids"]), F.lit(1))).alias("next"), F.when(r.isNotNull(), F.array_append(a["out"], r["license"])).otherwise(a["out"]).alias("out"))))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("next"), none.alias("out"))
    return F.when(F.size(ids) > 0, F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, step, lambda a: a["out"])).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__license_known`` (array of (at, id)) and ``__license_found`` (licences in order)."""
    df = docs.withColumn(P + "known", known_sentences(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return df.withColumn(P + "found", T.let(F.transform(P + "known", lambda x: x["id"]), lambda ids: match_rules(ids)))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    known, found = F.col(P + "known"), F.col(P + "found")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size(known).cast("long").alias("n_known"),
        F.array_join(F.transform(known, lambda x: F.concat_ws("@", x["id"], x["at"].cast("string"))), ",").alias("known"),
        F.size(found).cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("licenses"),
    )
