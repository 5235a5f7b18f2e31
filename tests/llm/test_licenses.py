import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""


def brute(text):
    """Every run of pieces that is a known sentence, then the leftmost and longest without overlap."""
    pieces = [licenses.normalised(p) for p in re.sub(r"([.!?;])[ \t\n\r]+", r"\1\n", text or "").split("\n") if not re.fullmatch(r"[ \t]*;+[ \t\r]*", p)]
    runs = []
    for i in range(len(pieces)):
        for j in range(i, min(i + 130, len(pieces))):
            if not pieces[j]:
                break
            words = " ".join(pieces[i : j + 1])
            cut = any(" ".join(pieces[i:m]) in licenses.KNOWN and " ".join(pieces[m : j + 1]) in licenses.KNOWN for m in range(i + 1, j + 1))
            if words in licenses.KNOWN and not cut:
                runs.append((i, -len(words), j, licenses.KNOWN[words]))
    hits = []
    for i, _, j, name in sorted(runs):
        if not hits or i > hits[-1][1]:
            hits.append((i, j, name))
    sequence = "".join(("|" if n and i - hits[n - 1][1] > licenses.MAX_GAP + 1 else "") + f"<{name}>" for n, (i, _, name) in enumerate(hits))
    found, at = [], 0
    while at < len(sequence):
        fit = max((x for x in licenses.SEQUENCES if sequence.startswith(x, at)), key=lambda x: x.count("<"), default=None)
        found += [licenses.SEQUENCES[fit]] if fit else []
        at += len(fit) if fit else 1
    return len(hits), sequence, found


TEXTS = [
    APACHE,
    "Words.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "filler\n" * 9 + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "you may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0.",
    "",
    None,
    "No licence here! Nor there.",
    "Released under the MIT License. " * 3000,
]


def test_matches_brute_force(docs):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS + TEXTS[:2])]
    got = licenses.scan(docs(*rows).withColumn("sequence", F.lit("mine"))).collect()
    for (doc_id, text), row in zip(rows, got, strict=True):
        assert (len(row.hits), row.sequence, row.licenses) == brute(text) and row.doc_id == doc_id


def test_longest_rule_wins_and_order_counts():
    assert brute(APACHE)[2] == ["Apache-2.0"] and brute(APACHE)[0] == 6
    assert brute(TEXTS[4])[2] == [] and "|" in brute(TEXTS[4])[1]
    assert brute(TEXTS[5])[2] == ["Apache-2.0"]


def test_native_plan_without_shuffle_and_empty_table(docs):
    out = licenses.scan(docs((1, "a")).where("doc_id < 0"))
    plan = out._jdf.queryExecution().toString()
    assert out.count() == 0 and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def text_of(*ids):
    first = {i: x for x, i in reversed(licenses.SENTENCES.items())}
    return [first[i] for i in ids]


GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
MIT = [f"{x}." for x in text_of("mit-grant", "mit-notice", "mit-asis", "mit-liability")]
BSD = text_of("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liability")
ZLIB = text_of("zlib-asis", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")
NOTICES = [
    ("Apache-2.0", 6, APACHE.split("\n\n")),
    ("Apache-2.0", 4, ["Apache License", "Version 2.0, January 2004", "http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"]),
    ("MIT", 5, ["MIT License", "Copyright (c) 2020 Person", MIT[0][:-1], MIT[1], f"{MIT[2]} {MIT[3]}"]),
    ("BSD-3-Clause", 6, [BSD[0], f"1. {BSD[1]}.", f"2. {BSD[2]}.", f"3. {BSD[3]}.", f"{BSD[4]}. {BSD[5]}."]),
    ("BSD-2-Clause", 5, [BSD[0], f"1. {BSD[1]}.", f"2. {BSD[2]}.", f"{BSD[4]}. {BSD[5]}."]),
    ("ISC", 3, ["Copyright (c) Person", *[f"{x}." for x in text_of("isc-grant", "isc-asis", "isc-liability")]]),
    ("Zlib", 6, [f"{ZLIB[0]}. {ZLIB[1]}.", ZLIB[2], f"1. {ZLIB[3]}.", f"2. {ZLIB[4]}.", f"3. {ZLIB[5]}."]),
    ("GPL-2.0-or-later", 2, [GPL_2]),
    ("GPL-2.0-only", 2, ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."]),
    ("GPL-3.0-or-later", 4, [GPL_3.format("General Public License"), HOPE]),
    ("LGPL-2.1-or-later", 2, [GPL_2.replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 2.1")]),
    ("LGPL-3.0-or-later", 1, [GPL_3.format("Lesser General Public License")]),
    ("AGPL-3.0-or-later", 1, [GPL_3.format("Affero General Public License")]),
    ("MPL-2.0", 2, [MPL]),
    ("BSL-1.0", 1, ["Distributed under the Boost Software License, Version 1.0. (See accompanying file)"]),
    ("EPL-2.0", 1, ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    ("MIT", 1, ["The MIT License (MIT)"]),
    ("Apache-2.0", 1, ["SPDX-License-Identifier: Apache-2.0"]),
    ("GPL-2.0-or-later", 1, ["SPDX-License-Identifier: GPL-2.0-or-later"]),
]


def commented(paragraphs, mark, width):
    lines = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in paragraphs).split("\n")
    return "import os\n" + "\n".join(f"{mark} {x}".rstrip() for x in lines) + "\ncode()\n"


def test_wrapped_and_commented_notices(docs):
    forms = [(mark, width) for mark in ("", "#", " *", "//", ";;") for width in (40, 72, 80, 5000)]
    rows = [(name, n, commented(paragraphs, *form)) for name, n, paragraphs in NOTICES for form in forms]
    got = licenses.scan(docs(*[(i, text) for i, (_, _, text) in enumerate(rows)])).collect()
    for (name, n, text), row in zip(rows, got, strict=True):
        assert (row.licenses, len(row.hits), "|" in row.sequence) == ([name], n, False), text


def test_runs_keep_to_their_paragraph_and_whole_pieces(docs):
    texts = ["Released under the\n\nMIT Licence terms", "not Released under the\nMIT License of old", "Released\nunder the MIT\nLicense", "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0"]
    got = licenses.scan(docs(*enumerate(texts))).collect()
    assert [r.sequence for r in got] == ["", "", "<mit-ref>", "<apache-2-copy><apache-2-url>"]
    assert [tuple(h) for h in got[2].hits] == [(0, 2, "mit-ref")]


def test_every_rule_fires_on_the_sentences_it_names(docs):
    forms = (("", 5000), ("//", 60))
    texts = [commented([". ".join(text_of(*ids)) + "."], mark, width) for ids, _ in licenses.RULES for mark, width in forms]
    got = licenses.scan(docs(*enumerate(texts))).collect()
    for (ids, licence), row in zip([r for r in licenses.RULES for _ in forms], got, strict=True):
        assert (row.sequence, row.licenses) == ("".join(f"<{i}>" for i in ids), [licence])


def test_prose_about_licences_is_clean(docs):
    texts = ["We chose the MIT License because it is short.", "The Apache License\nis discussed in chapter 2.", "See the terms of the GNU General Public License in your country.", "This program is free software and so is that one."]
    assert [r.licenses for r in licenses.scan(docs(*enumerate(texts))).collect()] == [[]] * 4


@pytest.fixture(scope="module")
def all_texts():
    return [t for t in TEXTS if t is None or len(t) < 20_000] + [commented(p, mark, width) for _, _, p in NOTICES for mark, width in (("", 72), ("#", 40), (" *", 5000), (";;", 60))]


def test_sql_and_brute_force_agree_with_the_scan(docs, all_texts, tmp_path):
    df = docs(*enumerate(all_texts))
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = [(i, *brute(t)) for i, t in enumerate(all_texts)]
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [(i, len(got[i].hits), got[i].sequence, got[i].licenses) for i in range(len(all_texts))] == expected
    assert sorted(con.execute(licenses.SQL).fetchall()) == [(i, n, sequence, ",".join(names)) for i, n, sequence, names in expected]
