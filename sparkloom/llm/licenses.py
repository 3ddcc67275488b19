"""License texts by canonical digest lookup.

A text is put into a canonical form - lower case, one space for every run of signs, copyright lines dropped, equivalent
spellings made the same - and the SHA-256 of the whole form is looked up in a table of known ones by a hash join. Units
looked up are the whole document, without title lines and "all rights reserved" on a line of its own, every line of it,
as notices stand on lines of their own, and every run of lines, as licenses stand in longer files. Only units as long as
some known text are hashed, which loses nothing: a run ends where it begins plus that length, so the runs of a length are
the places where a line ends that far behind where one begins, found by one search of sorted sums a length. Canonical
lines are made by column expressions; units are cut from them in Arrow batches, and joined by digest.

The table of known texts is a fixed list (a few kilobytes), so it is broadcast. Long licenses are in it by the digests of
their published texts. Within a run, title lines and "all rights reserved" are part of the text, as nothing says which file they belong to.

Defined results: null and empty texts match nothing; a run is no single line and not the whole document, which have units of
their own; of equal runs each counts; a document that repeats a notice has a row for each line; repeated
rows and null doc_ids are reported like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, text_or_empty

# Spellings that mean the same in a license, after lower case and without signs.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "organisation": "organization", "acknowledgement": "acknowledgment", "copyright owner": "copyright holder",
    "favour": "favor", "fulfil ": "fulfill ", "judgement": "judgment", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense",
    "programme": "program", "artefact": "artifact", "http ": "https ",
}
# Licenses that grant in a few sentences, and the notices that name longer ones.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense (notice)": "This is free and unencumbered software released into the public domain.",
    "MIT (notice)": "Released under the MIT License.",
    "MIT (notice, licensed)": "Licensed under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
    "BSD (notice)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause (SPDX)": "SPDX-License-Identifier: BSD-3-Clause",
    "MIT (SPDX)": "SPDX-License-Identifier: MIT",
    "Apache-2.0 (SPDX)": "SPDX-License-Identifier: Apache-2.0",
    "All rights reserved": "All rights reserved.",
}
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace(
    "\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE"
)
KNOWN["BSD-3-Clause (Regents)"] = (
    KNOWN["BSD-3-Clause"].replace("the copyright holder nor the names of its contributors", "the University nor the names of its contributors")
    .replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")
)
# Fixed value: the dedication, as published.
KNOWN["Unlicense"] = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
# Lines that may stand over a license and change nothing in it, in canonical form.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "isc license", "the isc license", "bsd 2 clause license", "the 2 clause bsd license", "simplified bsd license",
    "bsd 3 clause license", "the 3 clause bsd license", "new bsd license", "bsd zero clause license", "zero clause bsd", "zlib license", "the zlib license", "all rights reserved", "the unlicense",
)
# Whole published texts, by the length and the SHA-256 of their canonical form.
PUBLISHED = {
    "Apache-2.0": (9769, "1e0cd83bae9cf8d1f02f5e8e3671f8102f442d3bad2a80a52de80073922ad61a"),
    "Artistic-1.0-Perl": (5653, "f273930184a9b8de03336e9ae5d74bef291165524044f55455ee5117f494811a"),
    "CC0-1.0": (6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    "GFDL-1.2": (19510, "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    "GFDL-1.3": (21879, "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    "GPL-1.0": (11700, "ecffd792bbe30a8f068c26179a7995c53247219322c9fdd6010c935476aec4fd"),
    "GPL-2.0": (17051, "ceb13cdc7143ca5f58fb64136b9b542b00470d4db4dbcee1328c6250bf845b08"),
    "GPL-3.0": (33205, "c533bbdba9f85c1594f3e5dce97ce23acc39c96fd1cf30473b35d0d9aa7b562e"),
    "LGPL-2.0": (23934, "a04887a2e97819694b2be205fa65f330398118bc5fbc14141f2b447de4518f04"),
    "LGPL-2.1": (25021, "acc395acbeb6beb07eb27e79961050220424a8555e86d51af0156340a30b4f77"),
    "LGPL-3.0": (7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "MPL-1.1": (22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    "MPL-2.0": (14343, "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
}
SIGNS = r"[^a-z0-9\n]+"
RIGHTS = r"^ ?(copyright|c copyright|c [0-9]{4}|spdx filecopyrighttext)( |$)"


def canonical_lines(text: str) -> list[str]:
    """The canonical form of a text, line by line, in plain Python: how the known texts are entered."""
    flat = re.sub(SIGNS, " ", "".join(c.lower() if c.isascii() else c for c in text))
    for a, b in SPELLINGS.items():
        flat = flat.replace(a, b)
    return [x.strip(" ") for x in flat.split("\n") if x.strip(" ") and not re.search(RIGHTS, x)]


def whole_form(lines: list[str]) -> str:
    """The form of a whole text: its lines without titles, or all of them where there are no others."""
    return " ".join([x for x in lines if x not in TITLES] or lines)


def known_digests(known: dict[str, str]) -> list[tuple[str, str, int]]:
    forms = {name: whole_form(canonical_lines(text)) for name, text in known.items()}
    return [(name, hashlib.sha256(f.encode()).hexdigest(), len(f)) for name, f in forms.items() if f]


def all_known() -> list[tuple[str, str, int]]:
    return known_digests(KNOWN) + [(name, digest, length) for name, (length, digest) in PUBLISHED.items()]


#: Canonical characters of the shortest known text that is looked for in runs of lines.
SHORTEST_RUN = 60
FOUND = pa.schema([("doc_id", pa.int64()), ("scope", pa.string()), ("unit", pa.int32()), ("digest", pa.string())])


def units_of(lines: pa.ListArray, lengths: np.ndarray) -> Iterator[tuple[int, str, int, str]]:
    """(text, scope, unit, body) of the units of some texts' canonical lines that are as long as some known text. Canonical
    lines are ASCII, so their bytes are their characters."""
    values, firsts = lines.flatten(), np.asarray(lines.offsets)
    firsts = firsts - firsts[0]
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size + 1)))  # where a line begins, and one more than where the one before it ends
    of = np.repeat(np.arange(len(lines)), np.diff(firsts))
    body = lambda i, j: " ".join(values.slice(i, j - i).to_pylist())
    title = pc.is_in(values, value_set=pa.array(TITLES)).to_numpy(zero_copy_only=False).astype(bool)
    untitled = np.concatenate((np.zeros(1, np.int64), np.cumsum((size + 1) * ~title)))
    whole = untitled[firsts[1:]] - untitled[firsts[:-1]]
    whole = np.where(whole == 0, cuts[firsts[1:]] - cuts[firsts[:-1]], whole) - 1
    for d in np.flatnonzero(np.isin(whole, lengths)).tolist():
        yield d, "document", 0, whole_form(values.slice(firsts[d], firsts[d + 1] - firsts[d]).to_pylist())
    for i in np.flatnonzero(np.isin(size, lengths)).tolist():
        yield int(of[i]), "line", i - int(firsts[of[i]]) + 1, values[i].as_py()
    for n in lengths[lengths >= SHORTEST_RUN].tolist():
        ends = np.searchsorted(cuts, cuts[:-1] + n + 1)
        starts = np.flatnonzero((ends < len(cuts)) & (cuts[np.minimum(ends, len(cuts) - 1)] == cuts[:-1] + n + 1))
        for i, j in zip(starts.tolist(), ends[starts].tolist(), strict=True):
            first, last = int(firsts[of[i]]), int(firsts[of[i] + 1])
            if j <= last and j - i > 1 and j - i < last - first:
                yield int(of[i]), "lines", i - first + 1, body(i, j)


def license_scan(documents: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """documents(doc_id, text). A row for each unit that is a known text: doc_id, scope ('document', 'line' or 'lines'), unit (0,
    or the number of the line, or of the run's first, among lines that count, from 1), license, digest."""
    table = all_known() if known is None else known_digests(known)
    if len(table) > 100_000:
        raise ValueError("known texts are meant to be broadcast; join more than 100,000 by digest instead")
    spark = documents.sparkSession
    small_batches(spark)
    lengths = np.array(sorted({n for _, _, n in table}), np.int64)
    small = spark.createDataFrame(table, "license string, digest string, length int").select("license", "digest")
    capitals = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = F.regexp_replace(capitals, SIGNS, " ")
    for a, b in SPELLINGS.items():
        flat = F.replace(flat, F.lit(a), F.lit(b))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.struct(F.trim(x).alias("t"), x.rlike(RIGHTS).alias("r"))), lambda x: (x["t"] != "") & ~x["r"])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(lines, lambda x: x["t"]).alias("lines"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [(ids[d].as_py(), scope, unit, hashlib.sha256(body.encode()).hexdigest()) for d, scope, unit, body in units_of(batch.column("lines"), lengths) if body]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, FOUND, strict=True)], schema=FOUND)

    found = docs.mapInArrow(scan, "doc_id long, scope string, unit int, digest string")
    return found.join(F.broadcast(small), "digest").select("doc_id", "scope", "unit", "license", "digest")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    flat = "regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g')"
    for a, b in SPELLINGS.items():
        flat = f"replace({flat}, '{a}', '{b}')"
    known = ", ".join(f"('{n}', '{d}')" for n, d, _ in all_known())
    titles = ", ".join(f"'{t}'" for t in TITLES)
    sizes = ", ".join(f"({n})" for n in sorted({n for _, _, n in all_known() if n >= SHORTEST_RUN}))
    return f"""WITH known(license, digest) AS (VALUES {known}),
    raw AS (SELECT row_number() OVER () AS r, doc_id, {flat} AS flat FROM documents),
    cut AS (SELECT r, doc_id, string_split(flat, chr(10)) AS parts FROM raw),
    pieces AS (SELECT r, doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM cut),
    kept AS (SELECT r, doc_id, i, trim(x, ' ') AS x FROM pieces WHERE trim(x, ' ') <> '' AND NOT regexp_matches(x, '{RIGHTS}')),
    units AS (SELECT doc_id, 'line' AS scope, CAST(row_number() OVER (PARTITION BY r ORDER BY i) AS INTEGER) AS unit, x AS body FROM kept
      UNION ALL SELECT doc_id, 'document', 0, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE x NOT IN ({titles})), string_agg(x, ' ' ORDER BY i)) FROM kept GROUP BY r, doc_id),
    lined AS (SELECT r, doc_id, x, row_number() OVER (PARTITION BY r ORDER BY i) AS n, coalesce(sum(length(x) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM kept),
    wholes AS (SELECT r, string_agg(x, ' ' ORDER BY n) AS joined FROM lined GROUP BY r),
    runs AS (SELECT a.doc_id, 'lines' AS scope, CAST(a.n AS INTEGER) AS unit, substr(w.joined, CAST(a.s AS BIGINT) + 1, size) AS body FROM (VALUES {sizes}) t(size), lined a JOIN wholes w USING (r)
      JOIN lined b ON b.r = a.r AND b.n > a.n AND b.s + length(b.x) = a.s + size WHERE length(w.joined) > size)
    SELECT doc_id, scope, unit, license, digest FROM (FROM units UNION ALL BY NAME FROM runs) JOIN known ON digest = sha256(body)"""
