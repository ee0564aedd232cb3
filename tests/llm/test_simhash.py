"""SimHash components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tallymart.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                comp[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def near_copies(rng, n):
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=rng.randint(3, 200))) for _ in range(12)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(["x", "Y", "é", "Ü"])
        out.append(rng.choice([" ", "\n", "\x0b"]).join(words))
    return [*out, None, "", " \n", "one", "One", "one two", "İ X", "a\x85b", "\x1cab", "long " * 30_000]


def test_fingerprint_of_whole_texts():
    for text in near_copies(random.Random(1), 60):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("unit_rows", [3, 4096])
def test_links_equal_all_pairs(spark, unit_rows):
    rng, fps = random.Random(7), {0, -1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(30):
            flips = rng.choice([0, 1, 2, 3, 4, 5])
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), flips)))
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "_fp long")
    roots = {r["_fp"]: r["_root"] for r in simhash.components(simhash.links(df, unit_rows)).collect()}
    want = plain_components(fps, [f & (1 << 64) - 1 for f in fps])
    assert [roots.get(f, f) for f in fps] == want


def test_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(centres[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    unit = np.sort(rng.integers(0, 5, len(values)))
    both = np.ones(len(values), bool)
    a, b = simhash.search(values, unit, both, both)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(len(values)) for i in range(j)
            if unit[i] == unit[j] and bin(int(values[i]) ^ int(values[j])).count("1") <= 3}
    assert got == want and len(got) == len(a)
    order = np.lexsort((simhash.gray_rank(values), unit))
    levels = simhash.build_index(values[order], unit[order])
    assert len(levels[-1]["unit"]) == 5
    for level in levels[1:]:
        start = 0
        for mask, value, end in zip(level["mask"], level["value"], level["end"], strict=True):
            assert ((values[order][start:end] & mask) == value).all()
            start = end


def test_near_duplicates_and_representatives(spark):
    rng = random.Random(9)
    texts = near_copies(rng, 150)
    ids = [None if i % 17 == 0 else rng.randint(0, 90) for i in range(len(texts))]
    rows = [(i, t, "s", 5) for i, t in zip(ids, texts, strict=True)]
    rows += rows[:6]
    schema = "doc_id long, text string, component string, root int"
    df = spark.createDataFrame(rows, schema)
    got = simhash.near_duplicates(df).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is not None, x[2] or 0)
    assert sorted(((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component"]) for r in got), key=key) == sorted(
        zip([r[0] for r in rows], fps, want, strict=True), key=key)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = len({r["root"] for r in got})
    assert kept.count() == groups
    assert {r["doc_id"] for r in kept.collect()} >= {c for c in want if c is not None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0
