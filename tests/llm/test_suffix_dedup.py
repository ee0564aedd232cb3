"""Suffix arrays and the removal of repeated strings against direct search."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tallymart.llm import suffix_arrays as sa
from tallymart.llm.suffix_dedup import GRAM, cut_segments, remove_repeats


def strings(rng, n, alphabet=b"ab\0", most=60):
    base = [bytes(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n)]
    return base + [rng.choice(base) for _ in range(3)] + [b"a" * 50, b"", b"ab" * 30]


@pytest.mark.parametrize("seed", range(6))
def test_order_and_prefixes(seed):
    rng = random.Random(seed)
    texts, cap = strings(rng, 12), rng.choice([8, 9, 12, 20])
    shard = sa.lay_out(texts)
    order = sa.suffix_array(shard)
    at = {p: t[p - s:] for s, t in zip(shard.starts.tolist(), texts, strict=True) for p in range(s, s + len(t) + 1)}
    assert sorted(at, key=lambda p: (at[p], p)) == order.tolist()
    shared = sa.common_prefixes(shard, order, cap)
    for i, p in enumerate(order.tolist()):
        other = at[order[i - 1]] if i else b""
        n = next((k for k, (x, y) in enumerate(zip(at[p], other, strict=False)) if x != y), min(len(at[p]), len(other)))
        assert shared[p] == (min(n, cap) if len(at[p]) >= cap else 0)
    weights = np.array([rng.randint(1, 2) for _ in texts])
    counts = Counter()
    for w, t in zip(weights.tolist(), texts, strict=True):
        for k in range(len(t) - cap + 1):
            counts[t[k:k + cap]] += w
    hit = sa.repeated_within(shard, order, weights, cap)
    assert [bool(hit[p]) for p in at] == [len(at[p]) >= cap and counts[at[p][:cap]] > 1 for p in at]
    other = sa.lay_out(strings(rng, 7))
    places = np.flatnonzero(sa.window_places(shard, cap))
    got = sa.found_in(shard, places, other, sa.suffix_array(other), cap)
    there = {bytes(other.data[p:p + cap]) for p in np.flatnonzero(sa.window_places(other, cap))}
    assert got.tolist() == [at[p][:cap] in there for p in places.tolist()]


def test_equal_windows_have_equal_anchors():
    rng, seen = random.Random(1), {}
    text = rng.randbytes(3000)
    for data in (text, rng.randbytes(77) + text[300:2000] + rng.randbytes(90) + text[:900], b"ab" * 900, b"z" * 1000):
        for block in (1 << 22, 500):
            windows = []
            for anchor, first, many in cut_segments(data, 100, block):
                windows += [(k, anchor) for k in range(first, first + many)]
            assert [k for k, _ in windows] == list(range(len(data) - 99))
            for k, anchor in windows:
                assert seen.setdefault(data[k:k + 100], anchor) == anchor
    assert GRAM < 100


def plain(texts, span):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[k:k + span] for d in data for k in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if counts[d[k:k + span]] > 1:
                gone[k:k + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((len(d), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)),
                    bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def corpus(rng):
    words = [rng.choice(["é", "the", "of", "x" * 7, "ñandú", "\0", "🙂"]) + str(i) for i in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, long = make(60), make(300)
    texts = [make(rng.randint(0, 200)) for _ in range(25)]
    texts += [make(rng.randint(0, 40)) + passage + make(rng.randint(0, 40)) for _ in range(12)]
    texts += [long, long, long[:900], long[50:], long.replace("the", "teh", 1), "a" * 3000, "ab" * 700, passage + passage]
    for _ in range(8):
        words_ = long.split()
        for _ in range(3):
            words_[rng.randrange(len(words_))] = "edit"
        texts.append(" ".join(words_))
    return [*texts, None, "", "short", "x" * 400, "y" * 399, "z" * 401]


@pytest.mark.parametrize(("span", "shard_bytes"), [(400, 3 << 20), (400, 5000), (100, 1500)])
def test_removal(spark, span, shard_bytes):
    rng = random.Random(span + shard_bytes)
    texts = corpus(rng)
    rows = [(None if i % 11 == 5 else i % 40, t, "first", 2) for i, t in enumerate(texts)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, anchor string, digest int").repartition(4)
    got = remove_repeats(df, span=span, shard_bytes=shard_bytes).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows], span), strict=True)]
    have = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
