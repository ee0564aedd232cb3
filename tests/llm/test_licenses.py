"""License scan against exact containment at every place."""

from __future__ import annotations

import random
import re

from tallymart.llm import licenses
from tallymart.llm.licenses import CONTAINMENT, TEMPLATES, find_licenses, template_table

SCHEMA = "doc_id long, text string, license string, spans int"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text):
    words, found = words_of(text), set()
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    for name, texts in TEMPLATES.items():
        for template in texts:
            t = words_of(template)
            want = [tuple(t[i:i + 5]) for i in range(len(t) - 4)]
            slack = max(8, -(-len(want) // 4))
            places = {g: [k for k, w in enumerate(want) if w == g] for g in want}
            for at, g in enumerate(grams):
                for place in places.get(g, ()):
                    around = set(grams[max(0, at - place - slack):at - place + len(want) + slack])
                    if len(set(want) & around) >= CONTAINMENT * len(set(want)):
                        found.add(name)
    return sorted(found)


def rows():
    rng = random.Random(11)
    every = [t for texts in TEMPLATES.values() for t in texts]
    filler = lambda n: " ".join(rng.choices(["under", "the", "license", "copy", "of", "é", "x1", "software"], k=n))
    out = [None, "", "under the", "x " * 30_000 + every[0]]
    for t in every:
        out += [t, t.upper() + "!", f"{filler(9)} {t}\n{filler(40)}", filler(3) + " " + t + " " + filler(1) + " " + t]
        words = t.split()
        if len(words) > 14:
            out.append(" ".join(words[:-1]))
            out.append(" ".join(words[: len(words) // 2]) + " " + filler(5))
    out += [filler(300) for _ in range(30)]
    return [(None if i % 13 == 0 else i, t, "l", 3) for i, t in enumerate(out)]


def test_equals_containment(spark):
    data = rows() + rows()[:5]
    got = find_licenses(spark.createDataFrame(data, SCHEMA), template_table(spark, TEMPLATES)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [(d, plain(t)) for d, t, *_ in data]
    assert sorted(((r["doc_id"], r["licenses"]) for r in got), key=key) == sorted(want, key=key)
    assert len({n for _, names in want for n in names}) == len(TEMPLATES)


GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
    "License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for "
    "more details. You should have received a copy of the GNU {0}General Public License along with this program."
)
GNU_ONLY = GNU.replace("either version {1} of the License, or (at your option) any later version", "version {1} of the License")
GNU_LINE = "This work is licensed under the GNU {0}General Public License, version {1}"
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."
)
NOTICES = [
    *[(name, form.format(*of)) for form in (GNU, GNU_ONLY, GNU_LINE) for name, of in {
        "GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "AGPL-3.0": ("Affero ", "3"), "LGPL-3.0": ("Lesser ", "3"),
        "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-2.0": ("Library ", "2")}.items()],
    ("BSD-2-Clause", BSD.format("")),
    ("BSD-3-Clause", BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. ")),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
     "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
     "related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
     "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the "
     "Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
     "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
     "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented"),
    *[(name, t) for name, texts in TEMPLATES.items() for t in texts],
]


def test_each_notice_has_exactly_one_name(spark):
    data = [(i, f"Some file of ours, see below. {t} And so on in a text of words.", "l", 3) for i, (_, t) in enumerate(NOTICES)]
    got = find_licenses(spark.createDataFrame(data, SCHEMA), template_table(spark, TEMPLATES)).collect()
    by = {r["doc_id"]: r["licenses"] for r in got}
    assert [(t, by[i]) for i, (_, t) in enumerate(NOTICES)] == [(t, [n]) for n, t in NOTICES]


def test_empty_tables(spark):
    docs = spark.createDataFrame(rows()[:8], SCHEMA)
    assert find_licenses(docs.limit(0), template_table(spark, TEMPLATES)).count() == 0
    none = find_licenses(docs, spark.createDataFrame([], "license string, text string")).collect()
    assert len(none) == 8 and not any(r["licenses"] for r in none)


def test_windows_without_a_list_of_shingles(spark, monkeypatch):
    texts = ["x " * 9 + "released under the mit license " + "y " * 9, "mit license", "licensed under cc by 4.0", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = licenses.template_table(spark, licenses.TEMPLATES)
    found = lambda: sorted((r["doc_id"], r["licenses"]) for r in licenses.find_licenses(docs, templates).collect())
    listed = found()
    monkeypatch.setattr(licenses, "MAX_LISTED_SHINGLES", 0)
    assert found() == listed == [(0, ["MIT"]), (1, []), (2, ["CC-BY-4.0"]), (3, [])]
