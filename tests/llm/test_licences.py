import duckdb
import pytest

from notemill.llm.licences import RULES, SENTENCES, STEMS, known_pieces, licence_scan, licence_sql, normalise

MIT = "\n\n".join(SENTENCES[n] for n in ("mit-grant", "mit-notice", "mit-warranty"))
CASES = [
    (0, "Prose here. Licensed under CC BY-NC 4.0.\nMore prose.", "CC-BY-NC-4.0"),
    (1, "LICENSED UNDER THE MIT LICENSE.", "MIT"),
    (2, f"Copyright (c) X\n{MIT}\nend", "MIT"),
    (3, SENTENCES["mit-warranty"], ""),
    (4, "A licence is mentioned here, but no known sentence.", None),
    (5, None, None),
    (6, "", None),
    (7, "This work is licensed under\n  the GNU General Public License, version 3.\nAll rights reserved.", "GPL-3.0-only,LicenseRef-AllRightsReserved"),
    (8, "\n".join(SENTENCES[n] for n in ("gpl-free", "gpl-warranty")), "GPL-3.0-or-later"),
    (9, "\n".join(SENTENCES[n] for n in ("bsd-binary", "bsd-grant", "bsd-source")), ""),
    (10, "word " * 50_000 + "\nReleased under the MIT License.", "MIT"),
    (11, "All rights reserved. All rights reserved.", "LicenseRef-AllRightsReserved"),
    (11, "All rights reserved. All rights reserved.", "LicenseRef-AllRightsReserved"),
]


def test_tables():
    assert {n for _, names in RULES for n in names} <= set(SENTENCES)
    assert all(any(s in normalise(t) for s in STEMS) for t in SENTENCES.values())
    assert len(set(known_pieces().values())) == len(known_pieces())
    assert len(SENTENCES) >= 50 and all(any(s in p for s in STEMS) for p in known_pieces()) and min(p.count(" ") for p in known_pieces()) >= 2


def test_scan_and_sql(spark, tmp_path):
    rows = [(i, t, "c", "d") for i, t, _ in CASES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string, path string")
    got = licence_scan(docs)
    assert sorted((r.doc_id, r.licences) for r in got.collect()) == sorted((i, w) for i, _, w in CASES if w is not None)
    assert licence_scan(docs.limit(0)).collect() == []
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(licence_sql(f"read_parquet('{tmp_path}/d/*.parquet')")).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.sentence_ids, r.licences) for r in got.collect())


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licence_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3.0": """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "REM ", "-- "])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_wrapped_texts(spark, mark, newline):
    texts = {name: newline.join(mark + line for line in f"A title\nCopyright (c) X\n\n{x}\n\nend".split("\n")) for name, x in WRAPPED.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licence_scan(docs).collect()} == {name: name for name in WRAPPED}


def test_paragraphs_and_stops_end_sentences(spark):
    rows = [(0, "Released under the\n\nMIT License."), (1, "Released under. The MIT License."), (2, "All rights reserved\nby nobody"), (3, "A title\nReleased under the\nMIT\nLicense\nMore")]
    got = licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licences) for r in got] == [(3, "MIT")]


def test_one_line_copies_version_numbers_and_sql(spark, tmp_path):
    one_line = " ".join(("Copyright (c) 2020 A. Person " + WRAPPED["MIT"]).split())
    rows = [(0, one_line, "MIT"), (1, "See the licence. 2.0 is out.\n2.0.", None), (2, "x " + WRAPPED["MPL-2.0"], "MPL-2.0"), (3, "REM\nREM Released under\nREM the MIT License.", "MIT")]
    rows += [(10 + i, mark.join(["", *x.splitlines(True)]), name) for i, (name, x) in enumerate(WRAPPED.items()) for mark in ("# ",)]
    rows += [(40 + i, x.replace("\n", "\r\n"), name) for i, (name, x) in enumerate(WRAPPED.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = licence_scan(docs).collect()
    assert {r.doc_id: r.licences for r in got} == {i: w for i, _, w in rows if w}
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(licence_sql(f"read_parquet('{tmp_path}/d/*.parquet')")).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.sentence_ids, r.licences) for r in got)
