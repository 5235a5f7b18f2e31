"""Licence scan by sentence rules, in DataFrame functions only.

A text is split into pieces at line ends and after ``. ! ? ;`` with white
space behind. A piece is normalised (lower case, everything but a-z and 0-9
one space, so that comment marks go). Known licence sentences are whole pieces
or runs of adjacent ones, the longest first, so that a sentence wrapped over
lines or cut after an abbreviation is found; a run ends at a line without
letters and digits. Pieces of semicolons alone are comment marks and dropped.
Two pieces that are known each stay two sentences. The identifiers of the known
sentences, in order, are the text's sequence; more than MAX_GAP unknown pieces
in between break it. Ordered rules then match runs of identifiers, leftmost
first and the longest rule first at each place, without overlap.

The tables hold notices and the telling sentences of full texts of the common
licences; SPDX tags and the forms of the GNU notices come from rules.

All of it is one projection: nothing is shuffled, so no key can be hot. The SQL
finds the same sentences another way, by adding up pieces until they are a known
sentence, and picks them in a fold.

Defined cases: null text is empty and has no sentences that match; a text with
no known sentence has an empty list; repeated rows are scanned each; very long
texts are scanned whole; columns named hits, sequence or licenses are replaced,
others kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

MAX_GAP = 3

# Sentences of public licences and their identifiers.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0": "apache-2-lic",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2-lic",
    "You may not use this file except in compliance with the License": "apache-2-comply",
    "you may not use this file except in compliance with the License": "apache-2-comply",
    "You may obtain a copy of the License at": "apache-2-copy",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2-url",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2-url",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2-asis",
    "See the License for the specific language governing permissions and limitations under the License": "apache-2-see",
    "Apache License": "apache-title",
    "Version 2.0, January 2004": "apache-2-date",
    "http://www.apache.org/licenses/": "apache-site",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache-2-terms",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form": "apache-2-copyright",
    "Released under the Apache License, Version 2.0": "apache-2-ref",
    "This project is licensed under the Apache License 2.0": "apache-2-ref",
    "Released under the MIT License": "mit-ref",
    "Licensed under the MIT License": "mit-ref",
    "This project is licensed under the MIT License": "mit-ref",
    "The MIT License (MIT)": "mit-title",
    "MIT License": "mit-title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit-notice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit-asis",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "mit-liability",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so": "mit-0-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-advertising",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "bsd-asis",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "bsd-liability",
    "BSD 2-Clause License": "bsd-2-title",
    "BSD 3-Clause License": "bsd-3-title",
    "Released under the BSD 3-Clause License": "bsd-3-ref",
    "Licensed under the BSD 3-Clause License": "bsd-3-ref",
    "Licensed under the BSD 2-Clause License": "bsd-2-ref",
    "ISC License": "isc-title",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS": "isc-asis",
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE": "isc-liability",
    "This software is provided 'as-is', without any express or implied warranty": "zlib-asis",
    "In no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib-grant",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software": "zlib-origin",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "zlib-altered",
    "This notice may not be removed or altered from any source distribution": "zlib-notice",
    "Distributed under the Boost Software License, Version 1.0": "bsl-1-ref",
    "Boost Software License - Version 1.0 - August 17th, 2003": "bsl-1-title",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:": "bsl-1-grant",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl-2-ref",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl-2-ref",
    "Eclipse Public License - v 2.0": "epl-2-title",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3-ref",
    "This work is licensed under the GNU General Public License, version 2": "gpl-2-ref",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gpl-hope",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gpl-hope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl-implied",
    "See the GNU General Public License for more details": "gpl-see",
    "See the GNU Lesser General Public License for more details": "gpl-see",
    "See the GNU Affero General Public License for more details": "gpl-see",
    "You should have received a copy of the GNU General Public License along with this program": "gpl-received",
    "You should have received a copy of the GNU Lesser General Public License along with this library": "gpl-received",
    "You should have received a copy of the GNU Affero General Public License along with this program": "gpl-received",
    "GNU GENERAL PUBLIC LICENSE": "gpl-title",
    "GNU LESSER GENERAL PUBLIC LICENSE": "lgpl-title",
    "GNU AFFERO GENERAL PUBLIC LICENSE": "agpl-title",
    "Version 2, June 1991": "gpl-2-date",
    "Version 2.1, February 1999": "lgpl-21-date",
    "Version 3, 29 June 2007": "gpl-3-date",
    "Version 3, 19 November 2007": "agpl-3-date",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "gnu-verbatim",
    "The licenses for most software are designed to take away your freedom to share and change it": "gpl-2-preamble",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works": "gpl-3-preamble",
    "This work is licensed under the GNU Affero General Public License, version 3": "agpl-3-ref",
    "Released under the GNU General Public License, version 3": "gpl-3-ref",
    "Released under the GNU General Public License, version 2": "gpl-2-ref",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2-subject",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "mpl-2-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/": "mpl-2-copy",
    "Mozilla Public License Version 2.0": "mpl-2-title",
    "Licensed under CC BY 4.0": "cc-by-4",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4",
    "Licensed under CC BY-ND 4.0": "cc-by-nd-4",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "cc-by-nd-4",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa-4",
    "This work is licensed under the Creative Commons Attribution 4.0 International License": "cc-by-4",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "This software is distributed without any warranty": "cc0-asis",
    "CC0 1.0 Universal": "cc0-title",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense-grant",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1": "ofl-11-ref",
    "The contents of this file are subject to the terms of the Common Development and Distribution License": "cddl-1-ref",
    "Licensed under the EUPL, Version 1.2": "eupl-12-ref",
    "All rights reserved": "all-rights",
}

# The GNU notices. "<work> is free software", then one clause of a licence and version.
WORKS = ("program", "library", "file", "package", "software")
MAY = "you can redistribute it and/or modify it under the terms of the GNU"
FSF = "as published by the Free Software Foundation"
GNU = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
VERSIONS = (("gpl", "2", "GPL-2.0"), ("gpl", "3", "GPL-3.0"), ("lgpl", "2.1", "LGPL-2.1"), ("lgpl", "3", "LGPL-3.0"), ("agpl", "3", "AGPL-3.0"))


def _gnu_sentences() -> dict[str, str]:
    """Each clause alone (the work stands before a semicolon), and in one sentence with the work (a colon or comma)."""
    clauses = {}
    for name, version, _ in VERSIONS:
        clauses[f"{MAY} {GNU[name]} {FSF}, either version {version} of the License, or (at your option) any later version"] = f"{name}-{version}-later"
        for only in (f"{GNU[name]} version {version} {FSF}", f"{GNU[name]} version {version} only, {FSF}", f"{GNU[name]} {FSF}, version {version}", f"{GNU[name]} {FSF}, version {version} of the License"):
            clauses[f"{MAY} {only}"] = f"{name}-{version}-only"
    free = {f"This {w} is free software": "gnu-free" for w in WORKS}
    whole = {f"{f}: {c}": f"{i}-notice" for f in free for c, i in clauses.items() if "-later" in i or f.startswith("This program")}
    return free | clauses | whole


SENTENCES |= _gnu_sentences()

# Ordered sequences of identifiers and the licence that each states.
RULES = [
    (("apache-2-lic", "apache-2-comply", "apache-2-copy", "apache-2-url", "apache-2-asis", "apache-2-see"), "Apache-2.0"),
    (("apache-2-lic", "apache-2-comply", "apache-2-url", "apache-2-asis", "apache-2-see"), "Apache-2.0"),
    (("apache-2-lic", "apache-2-comply"), "Apache-2.0"),
    (("apache-2-lic",), "Apache-2.0"),
    (("apache-2-ref",), "Apache-2.0"),
    (("apache-title", "apache-2-date", "apache-site", "apache-2-terms"), "Apache-2.0"),
    (("apache-title", "apache-2-date"), "Apache-2.0"),
    (("apache-2-copyright",), "Apache-2.0"),
    (("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liability"), "MIT"),
    (("mit-title", "mit-grant", "mit-notice", "mit-asis"), "MIT"),
    (("mit-grant", "mit-notice", "mit-asis", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-asis"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-title",), "MIT"),
    (("mit-ref",), "MIT"),
    (("mit-0-grant", "mit-asis", "mit-liability"), "MIT-0"),
    (("mit-0-grant", "mit-asis"), "MIT-0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-3-title", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-3-title",), "BSD-3-Clause"),
    (("bsd-3-ref",), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-2-title", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-2-title",), "BSD-2-Clause"),
    (("bsd-2-ref",), "BSD-2-Clause"),
    (("isc-title", "isc-grant", "isc-asis", "isc-liability"), "ISC"),
    (("isc-grant", "isc-asis", "isc-liability"), "ISC"),
    (("isc-grant",), "ISC"),
    (("isc-title",), "ISC"),
    (("0bsd-grant", "isc-asis", "isc-liability"), "0BSD"),
    (("zlib-asis", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("bsl-1-title", "bsl-1-grant"), "BSL-1.0"),
    (("bsl-1-grant",), "BSL-1.0"),
    (("bsl-1-ref",), "BSL-1.0"),
    (("epl-2-ref",), "EPL-2.0"),
    (("epl-2-title",), "EPL-2.0"),
    (("gpl-3-ref",), "GPL-3.0-only"),
    (("gpl-2-ref",), "GPL-2.0-only"),
    (("agpl-3-ref",), "AGPL-3.0-only"),
    (("gpl-title", "gpl-2-date"), "GPL-2.0"),
    (("gpl-title", "gpl-3-date"), "GPL-3.0"),
    (("lgpl-title", "lgpl-21-date"), "LGPL-2.1"),
    (("lgpl-title", "gpl-3-date"), "LGPL-3.0"),
    (("agpl-title", "agpl-3-date"), "AGPL-3.0"),
    (("gpl-2-preamble",), "GPL-2.0"),
    (("gpl-3-preamble",), "GPL-3.0"),
    (("mpl-2-subject", "mpl-2-copy"), "MPL-2.0"),
    (("mpl-2-subject",), "MPL-2.0"),
    (("mpl-2-copy",), "MPL-2.0"),
    (("mpl-2-title",), "MPL-2.0"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-nd-4",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-4",), "CC-BY-NC-SA-4.0"),
    (("cc0-dedicated", "cc0-asis"), "CC0-1.0"),
    (("cc0-dedicated",), "CC0-1.0"),
    (("cc0-title",), "CC0-1.0"),
    (("unlicense", "unlicense-grant"), "Unlicense"),
    (("unlicense",), "Unlicense"),
    (("ofl-11-ref",), "OFL-1.1"),
    (("cddl-1-ref",), "CDDL-1.0"),
    (("eupl-12-ref",), "EUPL-1.2"),
]
WARRANTY = ("gpl-hope", "gpl-implied", "gpl-see")
for _name, _version, _licence in VERSIONS:
    for _kind, _suffix in (("later", "-or-later"), ("only", "-only")):
        _clause = f"{_name}-{_version}-{_kind}"
        for _start in (("gnu-free", _clause), (_clause,), (f"{_clause}-notice",)):
            RULES += [(_start + _end, _licence + _suffix) for _end in ((), WARRANTY, (*WARRANTY, "gpl-received"))]

# SPDX tags name a licence themselves.
for _licence in sorted({licence for _, licence in RULES}):
    SENTENCES[f"SPDX-License-Identifier: {_licence}"] = f"spdx-{_licence}"
    RULES.append(((f"spdx-{_licence}",), _licence))


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normalised(s): i for s, i in SENTENCES.items()}
SEQUENCES = {"".join(f"<{i}>" for i in ids): licence for ids, licence in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))}
PATTERN = "|".join(re.sub(r"([.])", r"\\\1", s) for s in SEQUENCES)

#: Between two words of a sentence: a space or the number of the next piece.
WRAP = r"(?: |\n#\d+ )"


def run_of(key: str) -> str:
    """The regular expression of a normalised sentence over one or more pieces."""
    words = key.split(" ")
    both = [" ".join(words[:i]) in KNOWN and " ".join(words[i:]) in KNOWN for i in range(1, len(words))]
    return words[0] + "".join((" " if b else WRAP) + w for b, w in zip(both, words[1:], strict=True))


def _runs() -> str:
    """All sentences, the longest first; those that begin with the same word stand under it, so that most pieces are passed at once."""
    by_word: dict[str, list[str]] = {}
    for key in sorted(KNOWN, key=lambda k: (-len(k), k)):
        by_word.setdefault(key.split(" ")[0], []).append(run_of(key))
    return r"(?m)^#\d+ (?:" + "|".join(f"{word}(?:{'|'.join(x[len(word):] for x in runs)})" for word, runs in sorted(by_word.items())) + ")$"


RUNS = _runs()


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` and ``hits`` (first and last piece and identifier), ``sequence`` and ``licenses`` in order of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = df.withColumn("__tm_text", text).drop("hits", "sequence", "licenses")
    known, rules = _map(KNOWN), _map(SEQUENCES)
    pieces = F.split(F.regexp_replace("__tm_text", r"([.!?;])[ \t\n\r]+", "$1\n"), "\n")
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    pieces = F.filter(pieces, lambda s: ~s.rlike(r"^[ \t]*;+[ \t\r]*$"))
    marked = F.array_join(F.transform(pieces, lambda s, i: F.concat(F.lit("#"), i.cast("string"), F.lit(" "), norm(s))), "\n")
    number = lambda m, at: F.regexp_extract(m, at, 1).cast("int")
    key = lambda m: F.trim(F.regexp_replace(m, r"\n?#\d+ ", " "))
    hit = lambda m: F.struct(number(m, r"^#(\d+)").alias("sentence"), number(m, r"#(\d+)[^#]*$").alias("last"), F.element_at(known, key(m)).alias("id"))
    out = keep.withColumn("hits", F.transform(F.regexp_extract_all(marked, F.lit(RUNS), F.lit(0)), hit)).drop("__tm_text")
    far = lambda h, j: (j > 0) & (h["sentence"] - F.get("hits", j - 1)["last"] > MAX_GAP + 1)
    marks = F.transform("hits", lambda h, j: F.concat(F.when(far(h, j), "|").otherwise(""), F.lit("<"), h["id"], F.lit(">")))
    out = out.withColumn("sequence", F.array_join(marks, ""))
    return out.withColumn("licenses", F.transform(F.regexp_extract_all("sequence", F.lit(PATTERN), F.lit(0)), lambda m: F.element_at(rules, m)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_known"), "sequence", F.array_join("licenses", ",").alias("licenses"))


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


def _literal(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


#: Pieces are added up from each piece that begins a known sentence; ``cut`` holds where two known sentences meet.
SQL = rf"""
WITH RECURSIVE known(key, id) AS (VALUES {_values(KNOWN)}), opening AS (SELECT key, id, string_split(key, ' ')[1] AS word FROM known),
cut AS (SELECT a.key || ' ' || b.key AS key, a.key AS head FROM known a JOIN known b ON TRUE JOIN known c ON c.key = a.key || ' ' || b.key),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\n\r]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
pieces AS (SELECT r, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM (SELECT r, list_transform(list_filter(p, lambda x: NOT regexp_matches(x, '^[ \t]*;+[ \t\r]*$')), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS q FROM docs)),
grown AS (SELECT r, i, i AS j, o.key, o.id, s AS words FROM pieces JOIN opening o ON o.word = string_split(s, ' ')[1] AND starts_with(o.key || ' ', s || ' ')
  UNION ALL SELECT g.r, g.i, p.i, g.key, g.id, g.words || ' ' || p.s FROM grown g JOIN pieces p ON p.r = g.r AND p.i = g.j + 1 AND p.s <> '' AND starts_with(g.key || ' ', g.words || ' ' || p.s || ' ')
    WHERE g.words <> g.key AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.key = g.key AND cut.head = g.words)),
whole AS (SELECT r, list({{'i': i, 'j': j, 'id': id}} ORDER BY i, length(key) DESC) AS found FROM grown WHERE words = key GROUP BY r),
chosen AS (SELECT r, list_reduce(list_transform(found, lambda x: [x]), lambda a, x: CASE WHEN x[1].i > a[-1].j THEN a || x ELSE a END) AS hits FROM whole),
marked AS (SELECT d.doc_id, coalesce(len(hits), 0) AS n_known, coalesce(array_to_string(list_transform(hits, lambda h, n: CASE WHEN n > 1 AND h.i - hits[greatest(n - 1, 1)].j > {MAX_GAP + 1} THEN '|' ELSE '' END || '<' || h.id || '>'), ''), '') AS sequence FROM docs d LEFT JOIN chosen c ON d.r = c.r)
SELECT doc_id, n_known, sequence, coalesce(array_to_string(list_transform(regexp_extract_all(sequence, '{PATTERN}'), lambda m: {_literal(SEQUENCES)}[m]), ','), '') AS licenses FROM marked
"""
