"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines away, variant spellings of
licence terms made one, everything but letters and digits one space. The SHA-256 of the form
is joined by hash with the digests of known licences, so that a text that is a licence as
a whole is found however it is wrapped, punctuated or attributed. Each line is looked up in the
same way among the known notices, of which there are a fixed number.

Short licences are known by their text, long ones by the digest alone: Apache-2.0 (also its
header by itself), GPL 1 to 3, LGPL 2 to 3, MPL 1.1 and 2.0, CC0-1.0, GFDL 1.2 and 1.3, Artistic
1.0, MIT, ISC, 0BSD, BSD with 2 and 3 clauses, Unlicense and Zlib. The known side is a table of
literals, a row of under 100 bytes for each text, and is broadcast. Other licences can be
given as texts or digests.

Null and empty texts and texts of copyright lines alone have the empty form and match nothing.
Repeated rows are told one by one. Rows whose doc_id is null are kept. An empty table gives
an empty result. Texts are read whole, however long. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import text_or_empty

# Public licence texts and the one-line notices that name a licence.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _AS_IS.format(holders="OR COPYRIGHT HOLDERS ")
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

""" + _AS_IS.format(holders="") + "\n\nFor more information, please refer to <https://unlicense.org>"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0-header", _APACHE_HEADER),
)
# Digests of the canonical forms of long licences, as a whole, and without the
# appendix, before and behind the line that ends their terms.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "3f3112fe3656909b8bf79c7ec7988f83a43b47aeadf2b7d62205aaf449d9f1be"),
    ("Apache-2.0", "a59acb355ce555a1fa4343147138e7cf6fa02a8efa49c4b10b8a5b9e9ace8911"),
    ("Apache-2.0", "93c166a0858ad5fc8ee860a087818d84b9afe007ed085d189dd32c12f841d3c6"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("GPL-3.0", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("LGPL-2.0", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135"),
    ("LGPL-2.0", "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a"),
    ("LGPL-2.0", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513"),
    ("LGPL-2.1", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-2.1", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a"),
    ("LGPL-2.1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
)
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Variant spellings and the one they count as.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("recognise", "recognize"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
    ("http:", "https:"),
)
COPYRIGHT_LINE = r"(?m)^[ \t\x0b\f/*#;-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\r\n]*$"


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for variant, one in SPELLINGS:
        text = F.replace(text, F.lit(variant), F.lit(one))
    text = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession, texts=TEXTS, digests=DIGESTS) -> DataFrame:
    """(digest, licence) of texts and digests, both as (licence, value); one row per digest, the least name of several."""
    rows = [F.struct(digest(F.lit(t)).alias("digest"), F.lit(name).alias("licence")) for name, t in texts]
    rows += [F.struct(F.lit(d).alias("digest"), F.lit(name).alias("licence")) for name, d in digests]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return table.groupBy("digest").agg(F.min("licence").alias("licence"))


def tell_tales(notices) -> str:
    """A pattern that every line holds that is one of the notices: of each a long word, in all its spellings."""
    chosen: list[str] = []
    for _, text in notices:
        text = text.lower()
        for variant, one in SPELLINGS:
            text = text.replace(variant, one)
        words = re.findall(r"\w+", text)
        if words and not set(words) & set(chosen):
            chosen.append(max(words, key=len))
    parts = []
    for word in chosen:
        part = re.escape(word)
        for variant, one in SPELLINGS:
            part = part.replace(re.escape(one), f"(?:{re.escape(one)}|{re.escape(variant)})")
        parts.append(part)
    return "(?iu)" + "|".join(parts) if parts else "(?!)"


def licence_scan(docs: DataFrame, known: DataFrame | None = None, notices=NOTICES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, digest, licence (of the whole text, or null) and notices (licences named by lines, sorted).

    known: (digest, licence), one row per digest; it is broadcast only if Spark finds it small.
    """
    known = F.broadcast(known_licences(docs.sparkSession)) if known is None else known
    body = text_or_empty(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(tell_tales(notices)))
    table = F.map_from_entries(F.array(*(F.struct(digest(F.lit(t)), F.lit(name)) for name, t in dict((canonical_text(t), (n, t)) for n, t in sorted(notices, reverse=True)).values())))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.transform(lines, digest), lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())))
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(body).alias("digest"), (found if notices else F.array().cast("array<string>")).alias("notices"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def canonical_text(text: str) -> str:
    """The canonical form of a line without a copyright notice, to tell equal notices apart on the driver."""
    text = text.lower()
    for variant, one in SPELLINGS:
        text = text.replace(variant, one)
    return " ".join(re.findall(r"[^\W_]+", text))
