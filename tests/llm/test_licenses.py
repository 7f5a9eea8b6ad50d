import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from smelter.llm import licenses
from smelter.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, con, sf_dir):
    df = QUERIES["op8_license_scan"](spark, sf_dir)
    result = con.execute(ORACLES["op8_license_scan"])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected
    assert any(r[2] for r in expected)


def test_canonical_forms_and_odd_rows(make_docs):
    mit = licenses.KNOWN[0][1]
    changed = "(c) 2020 Some Body\nCopyright 1999, another\n\n" + mit.upper().replace(",", " ;").replace("\n", "\n\n   ")
    spelled = licenses.KNOWN[6][1].replace("software", "Software").replace("OTHER TORTIOUS", "other tortious")
    docs = make_docs([(1, mit), (2, changed), (3, spelled), (4, mit + " And more."), (5, None), (6, ""), (7, "Copyright 2020 me"),
                      (8, "Text.\nReleased under the M.I.T. license\nRELEASED UNDER THE MIT LICENCE!\nlicensed under cc by nc 4 0"),
                      (9, "word " * 300000 + "\nLicensed under the Apache License, Version 2.0."), (1, mit), (None, mit)])
    docs = docs.withColumns({"license": F.lit("x"), "digest": F.lit("y"), "notices": F.lit("z")})
    got = sorted(((r["doc_id"], r["license"], tuple(r["notices"]), r["n_notices"], r["digest"])
                  for r in licenses.scan_licenses(docs).collect()), key=repr)
    want = [(1, "MIT", (), 0), (1, "MIT", (), 0), (2, "MIT", (), 0), (3, "ISC", (), 0), (4, None, (), 0), (5, None, (), 0),
            (6, None, (), 0), (7, None, (), 0), (8, None, ("CC-BY-NC-4.0", "MIT"), 2), (9, None, ("Apache-2.0",), 1),
            (None, "MIT", (), 0)]
    assert got == sorted(((*w, "y") for w in want), key=repr)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def wrapped(text, width):
    """The text with its paragraphs broken at another width."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in re.split(r"\n\s*\n", text))


def test_line_breaks_do_not_change_the_match(make_docs):
    full = [(name, body) for name, body in licenses.KNOWN if "\n" in body and not re.search(licenses._MARKED, body.lower())]
    want, docs = [], []
    for name, body in full:
        for text in [body, *[wrapped(body, w) for w in (20, 33, 60, 72, 76, 79, 80, 100, 120, 10 ** 6)]]:
            docs.append((len(docs), "Copyright (c) 2021 Some Body\n\n" + text))
            want.append(name)
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(make_docs(docs).repartition(8)).collect()}
    assert [(i, got[i]) for i in range(len(docs))] == list(enumerate(want))


PUBLISHED_MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.
"""


def test_the_published_mit_file(make_docs):
    """As its publisher wraps it."""
    rows = licenses.scan_licenses(make_docs([(1, PUBLISHED_MIT)])).collect()
    assert [r["license"] for r in rows] == ["MIT"]


@pytest.mark.parametrize("line,notice", [
    ("Copyright (c) 2020 A", True), ("copyright 1999, B", True), ("# Copyright Acme Inc.", True), ("(c) 2020 Some Body", True),
    ("© Some Body", True), ("Copyright [yyyy] [name]", True), ("Copyright \u00a9 A", True), ("Copyright Nota Bene", True),
    ("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", False), ("copyright notice and this permission notice", False),
    ("copyright owner", False), ("copyright", False), ("(c) You must retain", False), ("copyrighted work", False)])
def test_what_is_a_notice(spark, line, notice):
    got = spark.range(1).select(licenses.canonical(F.lit("before\n" + line + "\nafter"))).first()[0]
    assert (got == "before after") == notice


PUBLISHED = {f: n for n, f in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1",
                               "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items()}
BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""


def test_full_texts_of_common_licences(make_docs):
    texts = [(PUBLISHED[f], p.read_text()) for f in PUBLISHED if (p := Path("/usr/share/common-licenses") / f).is_file()]
    texts += [("BSD-2-Clause", BSD % ""), ("BSD-3-Clause", BSD % THIRD), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD % THIRD)]
    texts += [(name, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))) for name, text in texts[:-3]]
    docs = make_docs([(i, text) for i, (_, text) in enumerate(texts)] + [(100, texts[0][1] + "\nAnd more.")])
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts] and got[100] is None


def test_spdx_lines_and_a_list_of_ones_own(spark, make_docs, tmp_path):
    own = str(tmp_path / "known")
    spark.createDataFrame([("House-1", "The house licence.\nDo as you like."), (None, "x")], "license string, text string").write.parquet(own)
    docs = make_docs([(1, "// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MPL-2.0\n"),
                      (2, "THE HOUSE LICENSE. do as you like!"), (3, "a\nThis work is licensed under CC BY-SA 4.0.")])
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan_licenses(docs, licenses.load_known(spark, own)).collect()}
    assert got == {1: (None, ["GPL-2.0", "MPL-2.0"]), 2: ("House-1", ["House-1"]), 3: (None, ["CC-BY-SA-4.0"])}
