"""Licence recognition by known sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "epl-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "zero-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "boost-header": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "This work has been marked as dedicated to the public domain.",
    "reserved": "All rights reserved.",
}
#: Licence, and the sentence identifiers that must follow each other.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-warranty"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("GPL-2.0", ["gpl2-title", "gpl-verbatim"]),
    ("GPL-3.0", ["gpl3-title", "gpl-verbatim"]),
    ("LGPL-2.1", ["lgpl21-title", "gpl-verbatim"]),
    ("LGPL-3.0", ["lgpl3-title", "gpl-verbatim"]),
    ("AGPL-3.0", ["agpl3-title", "gpl-verbatim"]),
    ("EPL-2.0", ["epl-header"]),
    ("BSL-1.0", ["boost-header"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant", "zlib-altered"]),
    ("0BSD", ["zero-grant"]),
    ("MPL-2.0", ["mpl-title"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-header"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-short"]),
    ("CC0-1.0", ["cc0"]),
    ("LicenseRef-AllRightsReserved", ["reserved"]),
]
#: Every known piece holds one of these, so a text without them is passed over.
STEMS = ("licen", "warrant", "permission", "permitted", "redistribut", "copyright", "rights reserved", "public domain", "free software", "terms and conditions", "misrepresented")
#: A piece of so many words counts wherever it stands; a shorter one must be a whole sentence or whole lines.
LONG_PIECE = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(kept.split())


def _pieces(sentence: str) -> list[str]:
    """A known sentence cut where ``normal_lines`` would end it."""
    import re

    sentence = re.sub(r"(?i)\bv\. ", "v ", sentence)
    return [normalise(x) for x in re.sub(r"([.!?;:])[ \t\r\n]+", "\\1\n", sentence).split("\n")]


def known_pieces() -> dict[str, str]:
    """Normalised piece -> identifier; a sentence of several pieces has several identifiers."""
    table: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        pieces = _pieces(sentence)
        for k, piece in enumerate(pieces):
            table.setdefault(piece, name if len(pieces) == 1 else f"{name}.{k}")
    return table


def rule_paths() -> list[tuple[str, str]]:
    """Licence, and its identifiers joined as ``|a|b|``."""
    table = known_pieces()
    return [(licence, "|" + "|".join(table[p] for n in names for p in _pieces(SENTENCES[n])) + "|") for licence, names in RULES]


#: What turns a text into the words of its lines, in order: patterns and what stands in their place.
#: The first and second run on the text as it is, the others in lower case. Spelled so that Java and RE2 agree.
_BEFORE = [(r"(?m)^[ \t]*(?:@?REM|dnl)([ \t\r\n])", r" \1"), (r"\r?\n[ \t]*([a-z(])", r" \1")]
_AFTER = [(r"(^|[^a-z0-9])v\.[ \t\r\n]+", r"\1v "), (r"([.!?;:])[ \t\r\n]+", "\\1\n\n"), (r"[^a-z0-9\n]+", " "), (r" ?\n ?", "\n")]


def normal_lines(text: Column) -> Column:
    """The words of a text in lower case: an empty line where a sentence or paragraph ends, a new line where the text has one.

    Lines are joined where the next goes on in lower case; "v." before a number
    ends no sentence. Comment marks are no words; a line of nothing else is empty.
    """
    for pattern, by in _BEFORE:
        text = F.regexp_replace(text, pattern.replace("(?m)", "(?dm)"), by.replace("\\", "$"))
    text = F.translate(text, UPPER, LOWER)
    for pattern, by in _AFTER:
        text = F.regexp_replace(text, pattern, by.replace("\\", "$"))
    return text


def known_pattern() -> str:
    """Any known piece, whatever lines it is wrapped into; of several the longest. Short ones begin and end with a line."""
    pieces = sorted(known_pieces(), key=lambda x: (-len(x), x))
    long, short = ("|".join(x.replace(" ", "[ \\n]") for x in pieces if (x.count(" ") + 1 >= LONG_PIECE) == k) for k in (True, False))
    return rf"(?m)\b(?:{long})\b|^ ?(?:{short}) ?$"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every document that holds a known sentence.

    Known sentences become identifiers, in order, other sentences being passed
    over; a sentence may be wrapped into lines, with comment marks before them, and
    one of ``LONG_PIECE`` words or more may stand behind others on its line. A rule
    matches where its identifiers follow each other. Returns
    ``id_col``, ``sentence_ids`` (joined by ``|``) and ``licences`` (distinct,
    in the order of the rules, joined by a comma; empty if no rule matches).
    Null, empty and other texts give no row, repeated rows a row each; other
    columns are ignored. Runs within the scan: no shuffle, no Python.
    """
    table = known_pieces()
    lower = F.translate(text_col, UPPER, LOWER)
    likely = F.lit(False)
    for stem in STEMS:
        likely = likely | F.contains(lower, F.lit(stem))
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    pieces = F.regexp_extract_all(normal_lines(F.col(text_col)), F.lit(known_pattern()), F.lit(0))
    ids = F.transform(pieces, lambda s: F.try_element_at(names, F.trim(F.translate(s, "\n", " "))))
    found = docs.select(id_col, text_col).where(likely).select(id_col, F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("path"))
    found = found.where("path <> '||'")
    matched = F.array(*[F.when(F.contains("path", F.lit(path)), F.lit(licence)) for licence, path in rule_paths()])
    licences = F.array_join(F.array_distinct(F.filter(matched, lambda x: x.isNotNull())), ",")
    return found.select(id_col, F.expr("substring(path, 2, length(path) - 2)").alias("sentence_ids"), licences.alias("licences"))


def licence_sql(table: str = "documents") -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    lines = "text"
    for k, (pattern, by) in enumerate([*_BEFORE, *_AFTER]):
        lines = f"translate({lines}, '{UPPER}', '{LOWER}')" if k == len(_BEFORE) else lines
        lines = f"regexp_replace({lines}, {quote(pattern)}, {quote(by)}, 'g')"
    known = "MAP {" + ", ".join(f"{quote(p)}: {quote(i)}" for p, i in known_pieces().items()) + "}"
    tests = ", ".join(f"CASE WHEN contains(path, {quote(p)}) THEN {quote(n)} END" for n, p in rule_paths())
    order = list(dict.fromkeys(n for n, _ in rule_paths()))
    ranked = "[" + ", ".join(quote(n) for n in order) + "]"
    return f"""
WITH likely AS (SELECT doc_id, text FROM {table} WHERE {' OR '.join(f"contains({low}, {quote(s)})" for s in STEMS)}),
cut AS (SELECT doc_id, regexp_extract_all({lines}, {quote(known_pattern())}, 0) AS parts FROM likely),
named AS (SELECT doc_id, list_transform(parts, lambda s: {known}[trim(replace(s, chr(10), ' '))]) AS ids FROM cut),
paths AS (SELECT doc_id, '|' || array_to_string(ids, '|') || '|' AS path FROM named WHERE len(ids) > 0),
hits AS (SELECT doc_id, path, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM paths)
SELECT doc_id, substring(path, 2, length(path) - 2) AS sentence_ids,
  coalesce(array_to_string(list_filter({ranked}, lambda n: list_contains(found, n)), ','), '') AS licences
FROM hits"""
