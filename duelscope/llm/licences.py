"""Licence scans by digests of canonical texts.

A text is brought to a canonical form: lower case, without copyright lines,
with one spelling for equivalent words and single spaces for punctuation.  The
digest of an entire text is looked up among the digests of known licences; so
are the digests of its lines that speak of a licence, which finds notices
within a longer text.

Defined cases: null and empty texts and those that have no letters or digits
match nothing; a text of copyright lines alone is empty in canonical form;
rows that share a doc_id or have none are scanned each by its own text; of known
texts with one canonical form the first id by order counts; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keyed, row_key, sent, stash

#: Lines that are left out: they name holders, and differ between copies of a
#: licence.  The word alone does not make one: texts wrap before "copyright notice".
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright[^\p{L}\p{N}\n]{0,4})?(?:\(c\)|©)|copyright[^\p{L}\p{N}\n]+(?:[0-9]{4}|by |year|yyyy|the [^\n]*(?:authors|contributors))|all rights reserved)[^\n]*$"
#: Spellings taken as one (fixed values): what is written, what it becomes.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
)
#: A line without one of these is no notice; every known text has one.
MARK = r"(?i)licen[cs]e|spdx|permission|redistribut|public domain|provided"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Known texts (fixed values): licence id and text.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    *((i, f"{head}{text}") for i, text in (("BSD-2-Clause", f"{BSD_TWO}\n\n{BSD_REST}"), ("BSD-3-Clause", f"{BSD_TWO}\n\n{BSD_THIRD}\n\n{BSD_REST}"))
      for head in ("", f"BSD {i[4]}-Clause License\n\n") for text in (text, text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))),
)
#: Digests of the canonical forms of long licences as they are published, with
#: and without appendix or heading where both are found (fixed values).
DIGESTS = (
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("Apache-2.0", "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3"),
    ("Apache-2.0", "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "5adcaa62809e9b279e9f2890fd53678f0bcb496ca9ee6ed9371ba26b3967e0a4"),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for written, becomes in SPELLINGS:
        for _ in range(2):  # neighbours share a space
            out = F.replace(out, F.lit(f" {written} "), F.lit(f" {becomes} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(digest, license_id) of the known texts, a digest once."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    rows = rows.where(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")) > 0)
    rows = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id (of the entire text, else null), n_notices and notices (ids of its lines' licences, sorted, comma-joined)."""
    known = stash(known if known is not None else known_digests(docs.sparkSession), "licences")
    docs = docs.select("doc_id", row_key(docs, "text").alias("key"), "text")
    own = docs.select("doc_id", "key", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    whole = keyed(own, known, ["digest"], "left").select("doc_id", "key", "license_id")
    lines = docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.col("line").rlike(MARK))
    notices = keyed(lines.select("doc_id", "key", "place", F.sha2(canonical(F.col("line")), 256).alias("digest")), known, ["digest"], "inner")
    # the lines of equal rows count once, and a licence once for all of its lines
    counted = notices.groupBy("doc_id", "key", "license_id").agg(F.countDistinct("place").alias("count"))
    counted = counted.groupBy("doc_id", "key").agg(F.sum("count").alias("n_notices"), F.array_join(F.sort_array(F.collect_list("license_id")), ",").alias("notices"))
    found = sent(stash(counted, "notices")).withColumnsRenamed({"doc_id": "__doc", "key": "__key"})
    out = whole.join(found, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    return out.select("doc_id", "license_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _sql() -> str:
    """The scan in DuckDB's SQL, from the same fixed values."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    def form(c: str) -> str:
        out = f"' ' || regexp_replace(regexp_replace(lower({c}), {quoted(COPYRIGHT)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for written, becomes in SPELLINGS:
            for _ in range(2):
                out = f"replace({out}, ' {written} ', ' {becomes} ')"
        return f"sha256(trim({out}))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    digests = "".join(f" union all select {quoted(i)}, {quoted(d)}" for i, d in DIGESTS)
    return f"""
with given(license_id, text) as (values {values}),
known as (select form, min(license_id) as license_id from (select license_id, {form('text')} as form from given{digests}) group by 1),
whole as (select d.doc_id, k.license_id from (select doc_id, {form('text')} as form from documents) d left join known k on d.form = k.form),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
notices as (
  select doc_id, license_id, count(*) as n from (select doc_id, {form('line')} as form from lines where regexp_matches(line, {quoted(MARK)})) l
  join known k on l.form = k.form group by 1, 2),
found as (select doc_id, sum(n)::bigint as n_notices, string_agg(license_id, ',' order by license_id) as notices from notices group by 1)
select w.doc_id, w.license_id, coalesce(f.n_notices, 0) as n_notices, coalesce(f.notices, '') as notices
from whole w left join found f on w.doc_id = f.doc_id
"""


SQL = _sql()
