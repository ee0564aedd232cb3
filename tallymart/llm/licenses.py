"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Documents and templates become hashes of five-word shingles. A window is a few consecutive shingles; its signature is
the least hash under each of several permutations, one per band. Template windows start at every word and form a
broadcast table; document windows overlap, so a template's words lie whole in several of them. A window that holds all
of even a one-shingle template shares a quarter of its shingles, so with 16 bands in two windows the chance that none
collides is 0.75 ** 32 = 0.0001; one that lies inside an exact copy always collides. A band's least hash can only meet
that of a template if it comes from a template's shingle, so windows without one are not signed. Each hit is verified by the share
of the template's distinct shingles in the words around. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm.common import alnum_words, identity

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of a window, words from one window to the next, and bands of one permutation each.
WINDOW, STRIDE, BANDS = 4, 2, 16
#: A template table takes at most this many distinct windows, 40 bytes each, for its broadcast; more are shuffled.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Up to so many distinct shingles of all templates are looked up before any window is signed.
MAX_LISTED_SHINGLES = 10_000


def _gnu(adjective: str, number: str) -> tuple[str, ...]:
    """Notice, notice without "or later", and short forms of a GNU licence."""
    name = f"GNU {adjective}General Public License"
    return (
        f"terms of the {name} as published by the Free Software Foundation, either version {number} of the License",
        f"terms of the {name} as published by the Free Software Foundation, version {number} of the License",
        f"terms of the {name} version {number} as published by the Free Software Foundation",
        f"the {name}, version {number}",
    )


# Statements and notices of public licences, by SPDX name. Each is the part of a notice that tells it from
# its relatives: no other licence's notice may contain CONTAINMENT of it, so what differs by one word is cut to fewer
# than 20 shingles around that word.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software",
    ),
    "GPL-3.0": _gnu("", "3"),
    "GPL-2.0": _gnu("", "2"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-2.0": _gnu("Library ", "2"),
    # the three-clause text is the two-clause one with a clause between these two sentences
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License",
        "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
    ),
    "CC0-1.0": (
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "has waived all copyright and related or neighboring rights to",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    "EPL-1.0": (
        "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "EPL-2.0": (
        "made available under the terms of the Eclipse Public License 2.0 which is available at",
        "made available under the terms of the Eclipse Public License v. 2.0 which is available at",
        "made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
}


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, text) for name, texts in templates.items() for text in texts]
    return spark.createDataFrame(rows, "license string, text string")


def shingles(words: Column) -> Column:
    """Hashes of the runs of five words; none where there are fewer. `words` is a column: it is read at each word."""
    n = F.size(words) - SHINGLE + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", alnum_words(F.col(text))).withColumn("_hashes", shingles(F.col("_words"))).drop("_words")


def signature(window: Column) -> Column:
    """Per band the least hash, under the band's permutation, of the window's shingles."""
    bands = []
    for band in range(BANDS):
        # windows at the end have fewer shingles: null, which least() passes over
        moved = [F.when(F.size(window) > k, F.xxhash64(F.get(window, F.lit(k)), F.lit(band))) for k in range(WINDOW)]
        bands.append(F.least(*moved))
    return F.array(*bands)


def windows_of(hashes: Column, stride: int) -> Column:
    """The windows that start at every `stride`-th shingle."""
    n = F.size(hashes)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(hashes, i, WINDOW))


def template_shingles(templates: DataFrame) -> list[int] | None:
    """The distinct shingles of all templates, or None where they are too many for a list."""
    rows = with_shingles(templates, "text").select(F.explode("_hashes").alias("h")).distinct().limit(MAX_LISTED_SHINGLES + 1)
    found = sorted(r["h"] for r in rows.collect())
    return found if len(found) <= MAX_LISTED_SHINGLES else None


def window_places(hashes: Column, listed: list[int] | None) -> Column:
    """Starts of the windows, every STRIDE shingles; with `listed`, of those that hold one of these shingles."""
    n = F.size(hashes)
    none = F.array().cast("array<int>")
    if listed is None:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(STRIDE))).otherwise(none)
    found = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(listed), i)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(F.ceil((i - WINDOW + 1) / STRIDE), F.lit(0)).cast("int") * STRIDE
    around = F.flatten(F.transform(found, lambda i: F.sequence(first(i), F.floor(i / STRIDE).cast("int") * STRIDE, F.lit(STRIDE))))
    return F.array_distinct(around)


def slack(n_shingles: Column) -> Column:
    """Words around the aligned place in which a template's shingles are looked for."""
    return F.greatest(F.lit(8), F.ceil(n_shingles / 4).cast("int"))


def template_windows(templates: DataFrame) -> DataFrame:
    """`sig` -> `license`, the template's distinct shingles, its length and the window's place in it."""
    cut = with_shingles(templates, "text").select("license", F.col("_hashes").alias("all"))
    placed = cut.select("license", "all", F.posexplode_outer(windows_of(F.col("all"), 1)).alias("place", "window"))
    placed = placed.where(F.col("place").isNotNull())
    return placed.select(
        "license", F.array_distinct("all").alias("template"), F.size("all").alias("length"), "place",
        F.explode(signature(F.col("window"))).alias("sig"),
    ).distinct()


def find_licenses(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `licenses` (sorted names) and `spans` (license, start, end in words, share).

    A template of fewer than five words cannot be found. Null, empty and short texts have no licence. Repeated rows
    each keep a result row; null ids stay. Other columns are ignored. Without templates nothing is found.

    Windows travel without their document; what they hit is gathered per document, a template once per place, and
    meets the document in a join for the exact check.
    """
    index = template_windows(templates)
    if index.count() <= MAX_BROADCAST_WINDOWS:
        index = F.broadcast(index)
    known, who = identity(docs, doc_id, text), ["_no_id", "_of", "_hash"]
    hashed = with_shingles(known, "_text").select(*who, "_hashes")
    listed = template_shingles(templates)
    windows = F.transform(
        window_places(F.col("_hashes"), listed),
        lambda at: F.struct(at.alias("at"), F.slice(F.col("_hashes"), at + 1, WINDOW).alias("window")),
    )
    # the outer form keeps Spark from computing the windows once more to see whether there are any
    cut = hashed.select(*who, F.explode_outer(windows).alias("_w")).where(F.col("_w").isNotNull())
    probes = cut.select(*who, F.col("_w.at").alias("_at"), F.col("_w.window").alias("_window")).select(
        *who, "_at", F.explode(signature(F.col("_window"))).alias("sig")
    )
    place = F.struct((F.col("_at") - F.col("place")).alias("begin"), "license", "length", "template")
    hits = probes.join(index, "sig").groupBy(*who).agg(F.collect_set(place).alias("_hits"))

    def check(hashes: Column, hit: Column) -> Column:
        start = F.greatest(hit["begin"] - slack(hit["length"]), F.lit(0))
        end = F.least(hit["begin"] + hit["length"] + slack(hit["length"]), F.size(hashes))
        around = F.slice(hashes, start + 1, F.greatest(end - start, F.lit(0)))
        share = F.size(F.array_intersect(hit["template"], around)) / F.size(hit["template"])
        return F.struct(
            hit["license"].alias("license"), start.alias("start"), (end + SHINGLE - 1).alias("end"), share.alias("share")
        )

    # without a hit no words are needed
    met = known.join(hits, who, "left").withColumn("_met", F.when(F.col("_hits").isNotNull(), F.col("_text")))
    met = with_shingles(met, "_met")
    spans = F.filter(
        F.transform("_hits", lambda hit: check(F.col("_hashes"), hit)), lambda s: s["share"] >= CONTAINMENT
    )
    none = F.array().cast("array<struct<license:string,start:int,end:int,share:double>>")
    found = met.select(F.col("_id").alias(doc_id), F.coalesce(F.array_sort(F.array_distinct(spans)), none).alias("spans"))
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"])))
    return found.select(doc_id, names.alias("licenses"), "spans")
