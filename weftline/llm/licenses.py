"""Licence scans: texts and lines are brought to one canonical form, digested, and looked up by a hash join with known digests.

All of it is built-in expressions; the known licences are a table of fixed size.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings taken as one, longest first; both are in lower case without punctuation.
EQUIVALENT = (
    ("sub licence", "sublicense"), ("sub license", "sublicense"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licence", "license"),
    ("merchantability", "merchantability"), ("merchantibility", "merchantability"), ("noninfringement", "noninfringement"), ("non infringement", "noninfringement"),
    ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("copyright holders", "copyright holder"), ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("behaviour", "behavior"),
)
#: A line that says who holds the copyright (with a sign, a year or a blank for it), or only that all rights are reserved, isn't part of a licence.
#: Lines that go on a sentence with "copyright notice" or "copyright holders", or number a clause "(c)", are.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©\n]*(copyright\b[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|by\b|[<\[{])|copyright\b.*\b(19|20)[0-9]{2}\b|\(c\)\s*(copyright\b|(19|20)[0-9]{2}\b)|©|all rights reserved[^\p{L}\p{N}\n]*$).*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = """
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Licence ids and the texts and notices they are known by. Ids may repeat, texts may not.
KNOWN = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_NAMES + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END.replace("https", "http")),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("MIT-0", _MIT.replace(""", subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", ".")),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC + _NO_WARRANTY),
    ("ISC", "ISC License\n" + _ISC + _NO_WARRANTY),
    ("0BSD", _0BSD + _NO_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD + _NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)


#: Digests of the canonical form of long licences as their publishers print them, whole files. They match whole texts only.
DIGESTS = {
    "c8d2aa544a47107a1313326d08631799d7732b4ea61f56a31a3092142a95dd37": "Apache-2.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "85eb162263f8a78710deb4bbae55bf2a4bab495e911f61c1cbd849f269d18d84": "GFDL-1.2-only",
    "ead55d6494dad76798fb2c7709adb6233ff1f7d79a62a25910d5817048b9d81b": "GFDL-1.3-only",
    "b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f": "GPL-1.0-only",
    "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123": "GPL-2.0-only",
    "63e47b0d36c6ec8a022fb16572dc77ab3497ebf34ade01c220bac7c71a157102": "GPL-3.0-only",
    "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769": "LGPL-2.0-only",
    "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "22c9324e5634aa07c32060365e6191d4f9ec61fafc6091ce7394333c6d7db95e": "MPL-2.0",
}


def canonical(text: Column) -> Column:
    """Without copyright lines, in lower case, anything but letters and digits as one space, equivalent spellings as one. Null for null."""
    return _equal(F.trim(F.regexp_replace(_lines(text), r"[ \n]+", " ")))


def _lines(text: Column) -> Column:
    """The lines, folded, copyright lines left empty: lower case, anything but letters, digits and line feeds as one space."""
    s = F.regexp_replace(F.regexp_replace(text, r"\r", ""), "(?im)" + COPYRIGHT_LINE, "")
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\n]+", " ")


def _equal(s: Column) -> Column:
    for a, b in EQUIVALENT:
        if a != b:
            s = F.replace(s, F.lit(a), F.lit(b))
    return s


def canonical_text(text: str) -> str:
    """The same form in Python, for the fixed table (ASCII texts)."""
    copyright_line = COPYRIGHT_LINE.replace(r"\p{L}\p{N}", "A-Za-z0-9")
    s = re.sub("(?im)" + copyright_line, "", text.replace("\r", ""))
    s = re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    for a, b in EQUIVALENT:
        s = s.replace(a, b)
    return s


def digests(known=KNOWN) -> dict[str, str]:
    """Digest of each known text: its licence."""
    return {sha256(canonical_text(t).encode()).hexdigest(): name for name, t in known}


def known_table(spark: SparkSession, known=KNOWN, more: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted(((more or {}) | digests(known)).items()), "digest string, license string")


def scan(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", known=KNOWN, more: dict[str, str] = DIGESTS) -> DataFrame:
    """One row per input row: id, ``digest`` of the whole canonical text, ``license`` if that is a known text, ``notices`` (licences of lines that are a known text, in order), ``n_notices``.

    ``known``: licences and texts; ``more``: digests of further whole texts. Both lookups are hash joins of digests with a table of the caller's size: whole texts by
    a broadcast join, lines inside their row (the map literal is the hash table, so no row is exploded or shuffled). Every line is looked up whose canonical length is
    that of a known text. Null and empty texts match nothing and have the digest of the empty text; repeated rows, repeated and null ids stay apart; other columns play no part.
    """
    spark = docs.sparkSession
    table = digests(known)
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text)).alias("whole"), _equal(_lines(F.col(text))).alias("lines"))
    notices = F.array().cast("array<string>")
    if table:
        lookup = F.create_map(*(F.lit(x) for item in sorted(table.items()) for x in item))
        lengths = F.array(*map(F.lit, sorted({len(canonical_text(t)) for _, t in known})))
        trimmed = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
        lines = F.filter(trimmed, lambda x: F.array_contains(lengths, F.length(x)) & (x != ""))
        found = F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
        notices = F.coalesce(found, notices)
    rows = rows.select("id", F.sha2(F.coalesce("whole", F.lit("")), 256).alias("digest"), notices.alias("notices"))
    out = rows.join(F.broadcast(known_table(spark, known, more)), "digest", "left")
    return out.select(F.col("id").alias(id_col), "digest", F.when(F.col("digest") != sha256(b"").hexdigest(), F.col("license")).alias("license"), F.array_join("notices", ",").alias("notices"), F.size("notices").alias("n_notices"))
