"""Licence scans by sentences and rules, in DataFrame operations only.

A text is cut into sentences three times: with line ends as ends, for notices
that stand on a line; with line ends as spaces, for wrapped prose; and as such
prose whose paragraphs end sentences, too, for licence files.
Normalised sentences, with a holder's name replaced, map to identifiers, and the
sequence of identifiers is searched for licence rules: identifiers that follow
each other in this order among the known sentences. The map is a literal hash
table, so a sentence is compared with the few that share its bucket only.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence names and the SPDX identifiers they stand for.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl v2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl v3", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "Artistic-2.0": ["artistic license 2 0"],
    "PostgreSQL": ["postgresql license"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "EUPL-1.2": ["eupl 1 2", "european union public licence version 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "WTFPL": ["wtfpl"],
    "MIT-0": ["mit no attribution license"],
}
# Ways to say that something is under a licence.
NOTICES = [
    "licensed under {}",
    "licensed under the {}",
    "released under {}",
    "released under the {}",
    "distributed under the {}",
    "available under the {}",
    "this work is licensed under {}",
    "this work is licensed under the {}",
    "this work is licensed under a {}",
    "this project is licensed under the {}",
    "this software is licensed under the {}",
    "this file is licensed under the {}",
    "spdx license identifier {}",
    "license {}",
]
# Sentences of public licence texts.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd0-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl2-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "cc0-dedication": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-warranty": "this software is distributed without any warranty",
    "wtfpl-terms": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "gpl2-only-grant": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
}
# Licence rules, identifiers in order.
RULES = {
    "MIT": [["mit-grant", "mit-notice"]],
    "ISC": [["isc-grant", "isc-warranty"]],
    "0BSD": [["bsd0-grant", "isc-warranty"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "as-is"], ["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "Apache-2.0": [["apache-grant", "apache-use", "apache-warranty"], ["apache-grant", "apache-use"], ["apache-title"]],
    "GPL-2.0-or-later": [["gpl2-grant"]],
    "GPL-3.0-or-later": [["gpl3-grant"]],
    "MPL-2.0": [["mpl-notice"]],
    "Unlicense": [["unlicense-grant"]],
    "MIT-0": [["mit0-grant", "as-is"], ["mit0-grant"]],
    "BSL-1.0": [["bsl-grant"]],
    "Zlib": [["zlib-warranty", "zlib-grant"]],
    "PostgreSQL": [["postgresql-grant"]],
    "OFL-1.1": [["ofl-notice"]],
    "CC0-1.0": [["cc0-dedication", "cc0-warranty"], ["cc0-dedication"]],
    "WTFPL": [["wtfpl-terms"]],
    "EPL-2.0": [["epl2-notice"]],
    "GPL-2.0": [["gpl2-only-grant"], ["gpl2-title"]],
    "GPL-3.0": [["gpl3-title"]],
    "LGPL-2.1": [["lgpl21-title"]],
    "LGPL-3.0": [["lgpl3-title"]],
    "AGPL-3.0": [["agpl3-title"]],
    "LGPL-2.1-or-later": [["lgpl21-grant"]],
    "LGPL-3.0-or-later": [["lgpl3-grant"]],
    "AGPL-3.0-or-later": [["agpl3-grant"]],
}
# Pieces that the cuts yield of sentences with a ';' inside, which stand as a whole above.
PIECES = {
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "lgpl21-or-later": "either version 2 1 of the license or at your option any later version",
    "gpl2-or-later": "either version 2 of the license or at your option any later version",
    "gpl3-or-later": "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-no-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
}
# Licence rules over those pieces.
PIECE_RULES = {
    "GPL-2.0-or-later": [["gpl-terms", "gpl2-or-later"]],
    "GPL-3.0-or-later": [["gpl-terms", "gpl3-or-later"]],
    "LGPL-2.1-or-later": [["lgpl-terms", "lgpl21-or-later"]],
    "LGPL-3.0-or-later": [["lgpl-terms", "gpl3-or-later"]],
    "AGPL-3.0-or-later": [["agpl-terms", "gpl3-or-later"]],
}
#: SPDX identifiers of families with -only, which means the plain identifier, and -or-later.
FAMILIES = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: The older way to write -or-later in an SPDX notice.
PLUS = r"(?i)(spdx-license-identifier:[ \t]*[al]?gpl-[0-9.]+)\+"
#: Every known sentence holds one of these, so texts and sentences without any are passed over. They are
#: sought before normalising: between two words may stand whatever that makes a space.
TRIGGER = "(?i)licen[cs]e|copyright|permission|redistribut|warrant|public[^a-zA-Z0-9]+domain|(?:released|distributed|available)[^a-zA-Z0-9]+under"
#: A line end and a line without a letter or digit, once all line ends are one character.
BLANK = r"\n[^\p{L}\p{N}\n]*\n"
#: A "v." before a number, which ends no sentence.
VERSION = r"(^|[^a-zA-Z0-9])([vV])\.[ \t\r\n\f\x0B]+([0-9])"
#: What a normalised sentence says of a named holder, and what it says of any.
HOLDER = ("^neither the name of .+ nor the names of (its|any|the) contributors ", "neither the name of the copyright holder nor the names of its contributors ")
#: Buckets of the literal hash table of known sentences.
BUCKETS = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier: licence texts, and notices x names by rule."""
    out = {text: name for name, text in SENTENCES.items()}
    for spdx, names in NAMES.items():
        for notice in NOTICES:
            for name in names:
                out.setdefault(notice.format(name), f"notice-{spdx}")
    return out


def rule_table() -> list[tuple[str, str]]:
    """(licence, identifiers with a comma at either end), notices being rules of one."""
    out = [(spdx, f",{','.join(ids)},") for spdx, rules in RULES.items() for ids in rules]
    return out + [(spdx, f",notice-{spdx},") for spdx in NAMES]


def spdx_table() -> dict[str, str]:
    """Normalised SPDX notice -> licence, for every SPDX identifier among the licences."""
    out = {x: x for x in (*NAMES, *RULES)}
    for x in FAMILIES:
        out |= {f"{x}-only": x, f"{x}-or-later": f"{x}-or-later"}
    return {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', k.lower())}": v for k, v in out.items()}


def known_sentences() -> dict[str, str]:
    """sentence_table, the pieces, and all SPDX notices."""
    return {k: f"notice-{v}" for k, v in spdx_table().items()} | {v: k for k, v in PIECES.items()} | sentence_table()


def known_rules() -> list[tuple[str, str]]:
    """rule_table, the rules over pieces, and those of SPDX notices that have no other names."""
    more = [(spdx, f",{','.join(ids)},") for spdx, rules in PIECE_RULES.items() for ids in rules]
    return rule_table() + more + [(x, f",notice-{x},") for x in sorted(set(spdx_table().values()) - set(NAMES))]


def _sentences(text: Column, line_ends: bool) -> Column:
    cut = F.regexp_replace(text, r"([.!?;])[ \t\r\n\f\x0B]+", "$1\n")
    return F.split(cut, "\n") if line_ends else F.split(F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), r"([.!?;:])[ \t\f\x0B]+", "$1\n"), "\n")


def _paragraphs(text: Column) -> Column:
    """The text with a mark that ends a sentence for each blank line, and no end between "v." and a number."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, BLANK, "! "), VERSION, "$1$2 $3")


def _table() -> tuple[Column, Column]:
    """Known sentences and their identifiers as literal arrays, a pair of lists for each bucket of CRC-32."""
    buckets: list[list[tuple[str, str]]] = [[] for _ in range(BUCKETS)]
    for sentence, name in sorted(known_sentences().items()):
        buckets[zlib.crc32(sentence.encode()) % BUCKETS].append((sentence, name))
    # as SQL text, which Spark reads at once and folds into one literal; neither holds a quote
    lists = lambda k: F.expr(f"array({', '.join('cast(array(' + ', '.join(repr(x[k]) for x in b) + ') as array<string>)' for b in buckets)})")
    return lists(0), lists(1)


def _identifier(sentence: Column, table: tuple[Column, Column]) -> Column:
    at = (F.crc32(sentence.cast("binary")) % BUCKETS).cast("int")
    place = F.array_position(F.get(table[0], at), sentence)
    return F.when(place > 0, F.get(F.get(table[1], at), (place - 1).cast("int")))


def _identified(text: Column, table: tuple[Column, Column], line_ends: bool) -> Column:
    """Identifiers of the known sentences, in order."""
    hot = F.filter(_sentences(text, line_ends), lambda s: s.rlike(TRIGGER))
    plain = F.transform(hot, lambda s: F.trim(F.regexp_replace(F.translate(F.regexp_replace(s, PLUS, "$1-or-later"), _UPPER, _LOWER), "[^a-z0-9]+", " ")))
    named = F.transform(plain, lambda s: F.regexp_replace(s, *HOLDER))
    return F.filter(F.transform(named, lambda s: _identifier(s, table)), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, n_known, licenses, licensed) of docs (doc_id, text).

    sentence_ids are the identifiers in order, comma-joined, of the sentences
    that end with their lines; licenses the sorted comma-joined licences whose
    rule any way of cutting fulfils. Null and empty texts have none, and texts
    of any length are read whole. Repeated rows are each scanned; an empty table
    gives no rows.
    """
    known = _table()
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    hot = text.rlike(TRIGGER)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(hot, _identified(text, known, True)).otherwise(none).alias("by_line"),
        F.when(hot, _identified(text, known, False)).otherwise(none).alias("by_prose"),
        F.when(hot, _identified(_paragraphs(text), known, False)).otherwise(none).alias("by_paragraph"),
    )
    chain_of = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    rules = F.expr(f"array({', '.join(f'named_struct({chr(39)}license{chr(39)}, {a!r}, {chr(39)}ids{chr(39)}, {b!r})' for a, b in known_rules())})")
    ways = ("by_line", "by_prose", "by_paragraph")
    met = F.transform(F.filter(rules, lambda r: reduce(or_, (F.contains(chain_of(w), r["ids"]) for w in ways))), lambda r: r["license"])
    some = reduce(or_, (F.size(w) > 0 for w in ways))
    licenses = F.when(some, F.array_join(F.array_sort(F.array_distinct(met)), ",")).otherwise(F.lit(""))
    return found.select("doc_id", F.array_join("by_line", ",").alias("sentence_ids"), F.size("by_line").cast("long").alias("n_known"), licenses.alias("licenses")).withColumn(
        "licensed", F.col("licenses") != ""
    )


def duckdb_sql() -> str:
    """The same scan of a view `documents`, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(known_sentences().items()))
    rules = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_rules())
    plain = f"trim(regexp_replace(translate(regexp_replace(s, {quote(PLUS)}, '\\1-or-later', 'g'), '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(license, ids) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT r, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{BLANK}', '! ', 'g'), '{VERSION}', '\1\2 \3', 'g') AS text FROM d
), cut AS (
  SELECT r, 1 AS way, string_split(regexp_replace(text, '([.!?;])[ \t\r\n\f\x0B]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d
  UNION ALL
  SELECT r, 2, string_split(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '([.!?;:])[ \t\f\x0B]+', '\1' || chr(10), 'g'), chr(10)) FROM d
  UNION ALL
  SELECT r, 3, string_split(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '([.!?;:])[ \t\f\x0B]+', '\1' || chr(10), 'g'), chr(10)) FROM p
), sentences AS (
  SELECT r, way, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM cut
), ids AS (
  SELECT r, way, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n
  FROM (SELECT r, way, i, regexp_replace({plain}, '{HOLDER[0]}', '{HOLDER[1]}') AS plain FROM sentences) JOIN known ON sentence = plain GROUP BY r, way
), met AS (
  SELECT r, string_agg(license, ',' ORDER BY license) AS licenses
  FROM (SELECT DISTINCT r, license FROM ids JOIN rules ON contains(',' || ids.ids || ',', rules.ids)) GROUP BY r
)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0)::BIGINT AS n_known, coalesce(licenses, '') AS licenses, coalesce(licenses, '') <> '' AS licensed
FROM d LEFT JOIN (SELECT * FROM ids WHERE way = 1) USING (r) LEFT JOIN met USING (r)
"""
