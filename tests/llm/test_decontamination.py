"""Decontamination against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from tallymart.llm.decontamination import MAX_BROADCAST_BYTES, drop_contaminated, find_contamination

SCHEMA = "doc_id long, text string, items int, contaminated string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain(text, items, n):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            window = w[i:i + n]
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    runs = []
    for p in sorted(hit):
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    found.discard(None)
    return len(words), len(hit), sorted(found), [tuple(r) for r in runs], bool(hit) and 20 * len(hit) >= len(words)


def case(rng, short):
    vocabulary = ["Élan", "über", "the", "of", "x1", "7", "ñ"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, make(rng.randint(13, 40))) for i in range(8)] + [(None, make(20)), (3, make(15)), (50, None), (51, "!?")]
    if short:
        items += [(60 + i, make(rng.randint(4, 12))) for i in range(4)]
    texts = [make(rng.randint(0, 60)) for _ in range(20)] + [None, "", "?!", "the " * 20_000]
    for _, body in items[:10]:
        texts += [make(9) + ", " + (body or "").upper().replace("É", "é") + "!" + make(30), body, make(700) + " " + (body or "")]
        texts.append((body or "") + " " + (body or "") + make(3))
    rows = [(None if i % 10 == 9 else i % 30, t, 1, "c") for i, t in enumerate(texts)]
    return rows + rows[:3] + rows[25:28], items


@pytest.mark.parametrize("max_broadcast", [MAX_BROADCAST_BYTES, 0])  # 0: everything is joined by shuffles
@pytest.mark.parametrize("short", [False, True])
def test_equals_plain_search(spark, short, max_broadcast):
    rows, items = case(random.Random(5 + short), short)
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs, bench, max_broadcast=max_broadcast).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    have = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["contaminated"]) for r in got]
    want = [(r[0], *plain(r[1], items, 13)) for r in rows]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {w[-1] for w in want} == {True, False}
    kept = drop_contaminated(docs, bench, max_broadcast=max_broadcast)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    rows, items = case(random.Random(1), False)
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(docs.limit(0), bench).count() == 0
    clean = find_contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in clean)

