"""Licence scans by canonical digest, by DataFrame functions only.

Method: a text is brought to a canonical form and its SHA-256 is looked up among the digests of known
licences. The form, in this order: lower case; copyright lines (a line that opens with a copyright sign or
word and a year, holder or mark, and "all rights reserved" lines) and list marks at line starts go;
equivalent spellings become one; everything but letters and digits becomes single spaces. So two texts
have one digest only if they are the same words, whatever their case, punctuation, layout, years or
holders. Whole texts only: a licence inside a longer text is not this operator's match.

Known are the texts of short licences and the digests of the longer ones (``DIGESTS``).

Plan: one projection and an equi-join of digests. The built-in list is two dozen rows and is broadcast; a
caller's list is counted and broadcast only up to ``BROADCAST_ROWS``, beyond it Spark joins by shuffle.

Nulls and edge cases: a null text counts as empty, whose form is the empty string, which no licence has; a
null doc_id is kept; repeated rows get equal results; an empty table gives no rows; other columns are
ignored. Of known licences with one digest the least name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import bounded, documents

BROADCAST_ROWS = 10_000

# fixed values: spellings that licence matching takes as equal
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_COPYRIGHT = r"(?m)^[^\w\n]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|\[|<|by )|\(c\)|©)[^\n]*$|^[^\w\n]*all rights reserved[^\w\n]*$"
_MARKS = r"(?m)^[ \t]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\)|[*+•–-])[ \t]+"

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_NO_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

# fixed values: the texts of short public licences, and the notice lines by which longer ones are granted
KNOWN = {
    "MIT": _MIT,
    "MIT (titled)": f"MIT License\n\n{_MIT}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}


# fixed values: the digests of the canonical forms of longer public licences, whole texts as their stewards publish them
DIGESTS = {
    "Apache-2.0": "04c0200ac913382ffdb30ce8bd4ec57d7ecf6d04ed721c6327bb20a185a3dde0",
    "Artistic-1.0-Perl": "0ce87c1a2f9de8bd07685d372028374149e71fffb4eab93598a4cdc00ed86780",
    "CC0-1.0": "2106cd4f7c9f6d4a9e5f54c911e4ff372736db5467794e4b89bcea996afde21c",
    "GFDL-1.2": "e396324b384c02674e370310bc6d5ef7993c34dbbd6389b0abb509a030044de9",
    "GFDL-1.3": "eb288aa9ed0e1ffcf7aea7f1d383f212ec56781a96232d0754e5e7582b990c21",
    "GPL-1.0": "8006d6938e45108c7c95d49b6d84aa0a345eedc8566395dd2bc121b8e6ba4ae9",
    "GPL-2.0": "5ca608bb2eb79eb10b1a80b55bb0a99df497ce228143b9d233b5df274e85643a",
    "GPL-3.0": "cabccb86e314285bd22384eff6a86b75c37bea20224092b87b3ae4e63a2c437d",
    "LGPL-2.0": "ec44c766883b869bef6a328cf51aafbe256ee10744ba67af3472eda9d0446def",
    "LGPL-2.1": "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9",
    "LGPL-3.0": "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525",
    "MPL-1.1": "509a1897231e372560289dcfd5bd17feeb10e60a812325f2987e72e90d5fba2b",
    "MPL-2.0": "fc6db10715dd3f8d6886221817f28e3572f579a7a350ecd43e7cdc6607bf6ba7",
}


def canonical(text: Column) -> Column:
    """The canonical form of a string column."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), _MARKS, "")
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    # one scan tells whether any spelling occurs; the replacements run only there
    spelt = words
    for old, new in SPELLINGS.items():
        spelt = F.regexp_replace(spelt, rf"\b{old}(?=s?\b)", new)
    return F.when(words.rlike(rf"\b(?:{'|'.join(SPELLINGS)})s?\b"), spelt).otherwise(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(F.coalesce(text, F.lit(""))), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "licence string, text string")


def digests(known: DataFrame) -> DataFrame:
    """digest and licence of each text that has words."""
    return known.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "licence")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The operator: doc_id, digest and licence (null: not known) of every row."""
    spark = docs.sparkSession
    if known is None:
        table = digests(known_licences(spark)).unionByName(spark.createDataFrame(list(DIGESTS.items()), "licence string, digest string"))
    else:
        table = digests(known)
    table = bounded(table.groupBy("digest").agg(F.min("licence").alias("licence")), BROADCAST_ROWS)
    return docs.select(F.col("doc_id").cast("long"), digest(F.col("text").cast("string")).alias("digest")).join(table, "digest", "left").select("doc_id", "digest", "licence")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op8_licences": op8_licences}


def _sql() -> str:
    """The scan in SQL. Its expressions have no lookahead, so a spelling's plural is kept by a group."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(lower(t), {quoted(_COPYRIGHT)}, '', 'g'), {quoted(_MARKS)}, '', 'g')"
    form = f"trim(regexp_replace({form}, {quoted('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g'), ' ')"
    for old, new in SPELLINGS.items():
        form = f"regexp_replace({form}, {quoted(rf'\b{old}(s?)\b')}, {quoted(rf'{new}\1')}, 'g')"
    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in KNOWN.items())
    longer = ", ".join(f"({quoted(k)}, {quoted(x)})" for k, x in DIGESTS.items())
    return (
        f"with k as (select digest, min(licence) as licence from (select sha256({form}) as digest, licence from (values {known}) v(licence, t) union all select digest, licence from (values {longer}) w(licence, digest)) group by 1), "
        f"d as (select doc_id, sha256({form}) as digest from (select doc_id, coalesce(text, '') as t from documents)) select doc_id, d.digest as digest, licence from d left join k on d.digest = k.digest"
    )


ORACLES = {"op8_licences": _sql()}
