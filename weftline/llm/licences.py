"""Licence scans by canonical digest lookup (operator 4), in DataFrame functions only.

A text's canonical form is lower case, without copyright lines, with punctuation and white space as single spaces and with
variant spellings unified; its SHA-256 is the digest. The licence is looked up by the SHA-256 of that form with all EQUIVALENT words
unified too, among those of the known licences, which go through the same form; titled and untitled forms are known texts of their own.
The whole text counts: one text, one digest. The digest table is counted; up to BROADCAST_ROWS rows are broadcast and documents
aren't shuffled, beyond that the join is shuffled and AQE splits a digest that many copies share.

Defined cases: a null, empty or wordless text has the digest of the empty form and no licence, since such known texts are dropped.
If known texts share a canonical form, the smallest licence id is given. Repeated rows are looked up row by row; extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize

BROADCAST_ROWS = 100_000

#: Variant spelling -> the one it is read as. Fixed values, after the public SPDX matching guidelines on equivalent words.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}

#: Further equivalents of the same guidelines for the lookup, in order, on the words of the canonical form. The digest given out leaves them as they are.
EQUIVALENT = (
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("wilfull", "willful"), ("https", "http"),
    ("artefact", "artifact"), ("artefacts", "artifacts"), ("analyse", "analyze"), ("analysed", "analyzed"), ("licences", "licenses"),
    *((f"sub licen{x}{end}", f"sublicens{end}") for x in "sc" for end in ("e", "es", "ed", "ing", "able")), *((f"sublicenc{end}", f"sublicens{end}") for end in ("es", "ed", "ing", "able")),
)

#: A line that names a copyright holder or reserves rights, in lower case.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form's words."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def unified(words: Column) -> Column:
    """The words with unified spellings, as one text."""
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")


def lookup_key(text: Column) -> Column:
    """SHA-256 of a unified() text with all equivalents; each word gets borders of its own, so that plain replacement finds whole words."""
    out = as_is = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for found, put in EQUIVALENT:
        out = F.replace(out, F.lit(f" {found} ".replace(" ", "  ")[1:-1]), F.lit(f" {put} ".replace(" ", "  ")[1:-1]))
    words = F.array(*[F.lit(x) for x in sorted({found.split(" ")[0] for found, _ in EQUIVALENT})])
    return F.sha2(F.when(F.arrays_overlap(F.split(text, " "), words), out).otherwise(as_is), 256)  # without a phrase's first word nothing is replaced


def licence_matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest, licence_id (null if the text isn't a known licence). known: licence_id, text."""
    table = known.select("licence_id", canonical(F.col("text")).alias("w")).where(F.size("w") > 0).select("licence_id", lookup_key(unified(F.col("w"))).alias("_key"))
    table = materialize(table.groupBy("_key").agg(F.min("licence_id").alias("licence_id")), "licences")
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    own = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("w")).select(id_col, unified(F.col("w")).alias("_text"))
    own = own.select(id_col, F.sha2("_text", 256).alias("digest"), lookup_key(F.col("_text")).alias("_key"))
    return own.join(side, "_key", "left").select(id_col, "digest", "licence_id")


def known_licences(spark: SparkSession) -> DataFrame:
    """The known texts of the registered query, in all forms."""
    return spark.createDataFrame(known_forms(), "licence_id string, text string")


def known_forms() -> list[tuple[str, str]]:
    """(licence, text): the short texts without and with their usual titles; the full texts with and without title, and with and without what follows their terms."""
    out = [(k, f"{title}\n\n{text}") for k, text in KNOWN.items() for title in ("", *TITLES.get(k, ()))]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        terms = re.split(r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", whole)[0]
        for text in {whole, terms, terms + "END OF TERMS AND CONDITIONS"} if terms != whole else {whole}:
            out += [(path.stem, text), (path.stem, re.sub(r"\A\s*(?:\S[^\n]*\n)+", "", text))]
    return out


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(docs: str = "documents") -> str:
    """licence_matches() over a table as DuckDB SQL, with all known texts and equivalent words."""
    same = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    values = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in known_forms())
    form = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '" + COPYRIGHT_LINE + r"', ' ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    unify = f"array_to_string(list_transform(w, lambda x: coalesce({same}[x], x)), ' ')"
    key = "(' ' || replace(t, ' ', '  ') || ' ')"
    for found, put in EQUIVALENT:
        key = "replace({}, ' {} ', ' {} ')".format(key, found.replace(" ", "  "), put.replace(" ", "  "))
    return f"""
WITH known(licence_id, text) AS (VALUES {values}),
forms AS (SELECT licence_id, {unify} AS t FROM (SELECT licence_id, {form} AS w FROM known) WHERE len(w) > 0),
keys AS (SELECT sha256({key}) AS key, min(licence_id) AS licence_id FROM forms GROUP BY 1),
own AS (SELECT doc_id, {unify} AS t FROM (SELECT doc_id, {form} AS w FROM {docs}))
SELECT doc_id, sha256(t) AS digest, licence_id FROM own LEFT JOIN keys ON key = sha256({key})"""


def variants(docs: DataFrame) -> DataFrame:
    """A stand-in table: two of three documents are a short known licence in capitals, under another year's copyright line and with other spellings; the third is as it is. Columns: doc_id, text."""
    texts = F.array(*[F.lit(t) for t in KNOWN.values()])
    known = F.element_at(texts, (F.col("doc_id") % len(KNOWN) + 1).cast("int"))
    changed = F.concat(F.lit("Copyright (c) 19"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(" "), F.col("source"), F.lit("\n\n"), F.upper(F.replace(known, F.lit("sublicense"), F.lit("sub-license"))))
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(changed).alias("text"))


def variants_sql() -> str:
    """variants() of documents as an SQL query."""
    texts = "[" + ", ".join(map(_sql_text, KNOWN.values())) + "]"
    return f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Copyright (c) 19' || (doc_id % 90 + 10) || ' ' || source || chr(10) || chr(10) || upper(replace({texts}[doc_id % {len(KNOWN)} + 1], 'sublicense', 'sub-license')) END AS text FROM documents"


_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known licence texts, fixed values from the public licences of these names.
KNOWN = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL '
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    + _BSD_TAIL,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n'
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License."
    ),
}
#: Usual titles of the short texts; punctuation and case don't count.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
