"""Licence scan by canonical digest: texts that differ only in case, punctuation, copyright lines or spelling share one.

A text is canonical after five steps: lower case, copyright notices dropped (lines with a mark, a year or a name), every run of other characters than letters
and digits made one blank, equivalent spellings made one, blanks trimmed. Whole texts are hash-joined to the digests
of known licences; the table of known digests is the library's own list, so its size is bounded. Lines of a document
are texts too: a line that is a known notice as a whole is reported beside the document's own match.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words with several accepted spellings, each with the one that digests use.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense",
    "sub license": "sublicense", "authorise": "authorize", "authorised": "authorized", "merchantibility": "merchantability",
    "non infringement": "noninfringement", "organisation": "organization", "per cent": "percent", "https": "http",
    "copyright holder": "copyright owner", "favour": "favor", "whilst": "while", "fulfil": "fulfill",
}

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

# Fixed values: (licence, text). Full texts and notices as their publishers word them.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + "\n\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_DISCLAIMER),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT.split(", provided")[0] + ".\n\n" + _ISC_DISCLAIMER),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

_TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
           "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License")}
#: Licences named by a notice of one line, as "Licensed under the ... ."
_NAMES = {
    "MIT": ("the MIT License",), "ISC": ("the ISC License",), "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",), "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2",), "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"), "Unlicense": ("the Unlicense",),
    **{f"CC-{code.upper().replace(' ', '-')}-4.0": (f"CC {code} 4.0", f"a Creative Commons {words} 4.0 International License")
       for code, words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
                           "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
                           "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()},
}
_SPDX = {**{name: (name,) for name in ("0BSD", "BSL-1.0", "Zlib", "CC0-1.0", "EPL-2.0", "Artistic-2.0", *_NAMES)},
         **{name: (name, f"{name}-only", f"{name}-or-later", f"{name}+")
            for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}}


def _full_texts() -> list[tuple[str, str]]:
    """The published files beside this module; those with an appendix on how to apply them also without it, each as
    published and with one line a paragraph (then a notice's line is its paragraph)."""
    bsd = (Path(__file__).parent / "license_texts" / "BSD-3-Clause.txt").read_text()
    texts = []
    for body, name in ((bsd, "BSD-3-Clause"), (re.sub(r"(?ms)^3\..*?\n\n", "", bsd), "BSD-2-Clause")):
        for marked in (body, re.sub(r"(?m)^[0-9]\.", "*", body)):
            for rights in ("", "All rights reserved.\n\n"):
                texts += [(name, head + rights + marked) for head in ("", *[t + "\n\n" for t in _TITLES[name]])]
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, body = file.stem, file.read_text()
        if name == "BSD-3-Clause":
            continue
        ends = re.search(r"END OF TERMS AND CONDITIONS", body)
        for text in (body, *([body[:ends.end()]] if ends else [])):
            flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
            texts += [(name, text), (name, flat)]
    return texts


KNOWN += (*_full_texts(),
          *((name, f"{verb} under {words}.") for name, forms in _NAMES.items() for words in forms
            for verb in ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed")
            if "licens" in f"{verb} {words}".lower()),
          *((name, f"SPDX-License-Identifier: {spelled}") for name, forms in _SPDX.items() for spelled in forms))

#: A line that can be a notice holds one of these. Checked against the list when notices are looked up.
STEMS = ("licens", "licenc")
_MARKED = r"\(c\)|©|[12][0-9]{3}|[\[<{]y"
_AFTER_COPYRIGHT = rf"copyright[^\w\n]*(?:{_MARKED})|copyright[\W_]+([^\W\d_]+)"


def _body_words(known) -> set[str]:
    """Words that follow 'copyright' in the licences themselves: a line that starts so is no notice."""
    found = {m.group(1) for _, text in known for m in re.finditer(_AFTER_COPYRIGHT, text.lower()) if m.group(1)}
    return found | {f"{w}{s}" for w in ("holder", "owner", "notice", "law", "license", "licence") for s in ("", "s")}


def _other_word(words: set[str], inside: bool = False) -> str:
    """A pattern for the start of any word that is not one of ``words``, without look-ahead: DuckDB's engine has none."""
    heads = sorted({w[0] for w in words if w})
    ways = [h + _other_word({w[1:] for w in words if w[:1] == h}, True) for h in heads]
    ways.append(f"[^{''.join(heads)}\\P{{L}}]")
    if inside and "" not in words:
        ways.append(r"(?:[^\p{L}\n]|$)")
    return f"(?:{'|'.join(ways)})"


#: A line that is a notice: a mark, a year or a name follows. A body line that happens to start with 'copyright' stays.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:" + _MARKED + r")|copyright[^\p{L}\p{N}\n]+"
                  + _other_word(_body_words(KNOWN)) + r"|\(c\)[^\p{L}\p{N}\n]*(?:copyright|[12][0-9]{3})|©)[^\n]*$")
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; NULL becomes empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, _OTHER, " "), F.lit(" "))
    for other, word in SPELLINGS.items():
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): one row per different canonical text; of licences that share one the first by name."""
    texts = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    rows = spark.range(1).select(F.inline(texts))
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def load_known(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """The library's list and the rows of a Parquet table (license, text) that says what else is to be known."""
    rows = spark.read.parquet(path).select("license", "text").where("license is not null and text is not null").collect()
    return KNOWN + tuple((r["license"], r["text"]) for r in rows)


def scan_licenses(docs: DataFrame, known=KNOWN, text: str = "text") -> DataFrame:
    """``docs`` with ``license`` (of the whole text, else NULL), ``notices`` (licences of lines that are known notices,
    sorted, each once) and ``n_notices`` (such lines). Columns of these names are replaced.

    NULL and empty texts match nothing. Texts of any length are read whole; repeated rows stay; an empty table gives
    an empty table. Canonical forms that are empty (a text of copyright lines only) match nothing.
    """
    spark = docs.sparkSession
    if not all(any(stem in body.lower() for stem in STEMS) for _, body in known if "\n" not in body):
        raise ValueError("a known notice of one line lacks the stem that lines are told by")
    pairs = [(r["digest"], r["license"]) for r in known_digests(spark, known).collect()]  # as many as the list has texts
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(n).alias("license"))
                                                     for d, n in pairs])))  # digests: the plan need not hold the texts
    literal = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                     lambda line: F.rlike(F.lower(line), F.lit("|".join(STEMS))))
    hits = F.array_compact(F.transform(lines, lambda line: F.try_element_at(literal, digest(line))))
    whole = F.broadcast(table.withColumnsRenamed({"digest": "__digest__", "license": "__license__"}))
    joined = (docs.drop("license", "notices", "n_notices").withColumn("__digest_of_text__", digest(F.col(text)))
              .join(whole, F.col("__digest_of_text__") == F.col("__digest__"), "left"))
    return (joined.withColumn("__hits__", hits)
            .withColumns({"license": F.col("__license__"), "notices": F.array_sort(F.array_distinct("__hits__")),
                          "n_notices": F.size("__hits__").cast("long")})
            .drop("__digest_of_text__", "__digest__", "__license__", "__hits__"))
