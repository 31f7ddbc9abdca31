"""Licence scan by canonical digests.

A text is put into a canonical form (case, punctuation, copyright lines, equivalent spellings), and the SHA-256 of that
form is looked up among the digests of known licences: for the entire text, and for each of its lines as a notice of its
own. All steps are SQL functions; the catalogue is a small table that is broadcast for the hash join.

Long licences are known by the digest of their canonical form alone (``LONG_DIGESTS``), short ones and notices by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import table

#: Spellings that mean the same in licences (fixed values), replaced in this order after lower-casing.
EQUIVALENT = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("https://", "http://"), ("whilst", "while"),
    ("favour", "favor"), ("organisation", "organization"), ("&", " and "), ("v. ", "version "),
)
#: Digests of a catalogue, at most: some 20 MB where they are broadcast.
MOST_KNOWN = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©)"
#: A statement of copyright at the start of a line, to the end of its sentence: not "copyright notice", nor a list's "(c)"; initials and
#: abbreviations end none, but before a licence's first word. The SQL drops whole lines (COPYRIGHT_LINE).
COPYRIGHT_STATEMENT = (
    r"^[^a-z0-9]*(?:(?:copyright|©)(?![a-z])(?![ \t]+(?:notices?|holders?|owners?|statements?|laws?|licen[cs]es?|and|or|is|in|to|of)(?![a-z]))|\(c\)(?![ \t]*(?:you|the|any|all|if|in|to|an?|or|and|each|every|no|must|may|shall|under|for|with|on|that|this|from|when|where)(?![a-z])))"
    r"[^\n]*?(?:(?<![^a-z][a-z])(?<![^a-z](?:inc|ltd|co|corp|jr|sr|dr|st|mr|ms|mrs|prof|bros|llc|gmbh))[.!?](?=[ \t\r])(?:[ \t]*all rights reserved[.!]?)?|[.!?](?=[ \t]+(?:released|licen[cs]ed|permission|redistribution|distributed|spdx)(?![a-z]))|\z)"
)
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f‘’“”–—©]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Known licences and notices (fixed values): identifier and text.
CATALOGUE = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("0BSD", _ZERO_BSD),
    ("BSD-2-Clause", f"{_BSD_START}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD_START}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
)


#: SHA-256 of the canonical forms of long licences' published texts (fixed values, as ``canonical`` gives them).
LONG_DIGESTS = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"), ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("CC0-1.0", "0fab61e77a1329b72c004c935feefa0a6b96c3de7d1d7e4a025cfb23e8b45b42"), ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"), ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"), ("GPL-3.0", "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329"),
    ("GPL-3.0", "ad4a8c0f86b40eeaec03087f95684ff7965ffea480d1a58d4d7d9cb5ea929725"), ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"), ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"), ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "0b93918765bfa96471883549916c4ce7b68df4d9bc72806c09441a4f5e89e12a"), ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"), ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)


def canonical(text: Column) -> Column:
    """The canonical form: statements of copyright at a line's start go; case, punctuation and spellings are made equal; null is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    kept = F.array_join(F.transform(F.split(low, "\n", -1), lambda line: F.regexp_replace(line, COPYRIGHT_STATEMENT, "")), "\n")
    for a, b in EQUIVALENT:
        kept = F.replace(kept, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(kept, PUNCTUATION, " "))


def catalogue(spark: SparkSession) -> DataFrame:
    """(digest, license): one row for each canonical digest; a fixed number of rows."""
    rows = spark.createDataFrame(list(CATALOGUE), "license string, body string")
    short = rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license")
    return short.unionByName(spark.createDataFrame(list(LONG_DIGESTS), "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_digest, license, notices, n_notices) of every row of ``docs``.

    ``license`` is that of the entire text, null if it is no known licence; ``notices`` are the distinct licences of single
    lines, sorted and joined by a comma ('' if there are none), ``n_notices`` counts such lines. Null and empty texts have the
    digest of the empty form and no licence. Repeated rows stay; other columns are ignored.
    ``known`` (digest, license) replaces the catalogue: up to ``MOST_KNOWN`` rows, as it is broadcast; of a repeated digest the
    smallest name counts.
    """
    spark = docs.sparkSession
    if known is None:
        known = catalogue(spark)
    else:
        known = known.where("digest is not null and license is not null").groupBy("digest").agg(F.min("license").alias("license"))
        if known.count() > MOST_KNOWN:
            raise ValueError(f"a catalogue of over {MOST_KNOWN} digests is too large to broadcast")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the catalogue as one row's map, for the lines: they are looked up where they are, and nothing is shuffled
    lookup = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("known"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.length(line) > 0)
    found = F.filter(F.transform(lines, lambda line: F.try_element_at("known", F.sha2(canonical(line), 256))), lambda x: x.isNotNull())
    whole = rows.withColumn("canonical_digest", F.sha2(canonical(F.col("text")), 256)).join(F.broadcast(lookup))
    whole = whole.select("doc_id", "canonical_digest", found.alias("found"))
    return whole.join(F.broadcast(known.withColumnRenamed("digest", "canonical_digest")), "canonical_digest", "left").select(
        "doc_id", "canonical_digest", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").alias("n_notices")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as entire texts and as notice lines."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    kept = f"array_to_string([s FOR s IN string_split(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), chr(10)) IF NOT regexp_matches(s, '{COPYRIGHT_LINE}')], chr(10))"
    for a, b in EQUIVALENT:
        kept = f"replace({kept}, '{a}', '{b}')"
    return f"trim(regexp_replace({kept}, '{PUNCTUATION}', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP3_SQL = f"""
WITH bodies(license, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in CATALOGUE)}
), digests(license, digest) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LONG_DIGESTS)}
), known AS (
  SELECT digest, min(license) AS license FROM (SELECT sha256({_sql_canonical("body")}) AS digest, license FROM bodies UNION ALL SELECT digest, license FROM digests) GROUP BY 1
), whole AS (
  SELECT doc_id, sha256({_sql_canonical("text")}) AS canonical_digest FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), notices AS (
  SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(*) AS n
  FROM (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM lines WHERE length(line) > 0) l JOIN known k USING (digest) GROUP BY l.doc_id
)
SELECT w.doc_id, w.canonical_digest, k.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS INTEGER) AS n_notices
FROM whole w LEFT JOIN known k ON k.digest = w.canonical_digest LEFT JOIN notices n ON n.doc_id = w.doc_id
"""
