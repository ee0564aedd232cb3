from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallymart.llm import collocations


def plain_phrases(rows, longest, least, top, covered) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            for j in range(1, longest + 1):
                own.update(tuple(words[i:i + j]) for i in range(len(words) - j + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = [(p, a) for p, a in f.items() if len(p) > 1 and a >= least]
        kept = []
        for p, a in found:
            longer = [q for q, c in found if len(q) > len(p) and 100 * c >= covered * a
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if longer:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        kept.sort()
        out += [(lang, i + 1, p.decode(), a, left, right, n, score) for i, (_, _, p, a, left, right, score) in enumerate(kept[:top])]
    return sorted(out)


def mined(docs, **settings) -> list[tuple]:
    return sorted(map(tuple, collocations.mine_phrases(docs, **settings).collect()))


def some_rows(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "the", "cat", "dog", "Été", "été", "a'b", "x-y", "new", "york", "times", "\x1f"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]
    rows = [
        ("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]))
        for _ in range(n)
    ]
    return [*rows, ("", "en"), (None, "fr"), ("...,;", "de"), ("new york times " * 500, "en"), ("a" * 5000, "en"), ("one", None)]


@pytest.mark.parametrize(("longest", "least", "shards", "covered"), [(2, 2, 1, 50), (3, 5, 4, 50), (4, 3, 3, 80), (3, 10, 2, 101)])
def test_equals_plain_count(spark, longest, least, shards, covered):
    rows = some_rows(longest)
    docs = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, k0 int, shard string, _number int")
    got = mined(docs.repartition(3), longest=longest, least=least, shards=shards, covered=covered, top=40)
    assert got == plain_phrases(rows, longest, least, 40, covered) and len(got) > 5


def test_cells_shared_by_phrases(spark):
    # with few cells most phrases share one: more is counted, the result is the same
    rows = some_rows(9)
    got = mined(spark.createDataFrame(rows, "text string, lang string"), least=4, cell_bits=9)
    assert got == plain_phrases(rows, 3, 4, 2000, 50)


def test_rare_words_of_one_shard(spark):
    # the phrase occurs only in the last rows, so it becomes active late and its cycle wraps around
    rows = [("filler word here", "en")] * 50 + [("alpha beta gamma", "en")] * 10
    got = mined(spark.createDataFrame(rows, "text string, lang string").coalesce(1), shards=4)
    assert got == plain_phrases(rows, 3, 10, 2000, 50) and got[0][2] in ("alpha beta gamma", "filler word here")


def test_repeated_rows_and_empty_tables(spark):
    rows = [("big apple", "en")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert mined(docs) == [("en", 1, "big apple", 12, 12, 12, 24, 1_000_000)]
    assert mined(docs.limit(0)) == []
    assert mined(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")) == []


def test_words_with_one_id_count_again(spark, monkeypatch):
    class Same(collocations.Words):
        def __init__(self, data, bounds, langs, seed):
            super().__init__(data, bounds, langs, seed)
            if seed == 0:
                self.own = np.full(len(self.own), 7, np.uint64)
                self.ids = self.own[self.index]

    same = Same(np.frombuffer(b"a b", np.uint8), np.array([0, 3]), ["en"], 0)
    assert same.ids.tolist() == [7, 7]
    shared = spark.createDataFrame(
        [(1, 7, "en", "a", 10), (1, 7, "en", "b", 10)], "size int, k0 long, lang string, word string, n long"
    )
    seeds = []

    def count(texts, levels, seed):
        seeds.append(seed)
        return shared if len(seeds) == 1 else original(texts, levels, seed)

    original = collocations.count_words
    monkeypatch.setattr(collocations, "count_words", count)
    rows = [("a b", "en")] * 10
    assert mined(spark.createDataFrame(rows, "text string, lang string")) == plain_phrases(rows, 3, 10, 2000, 50)
    assert seeds == [0, 2]


def test_words_without_a_number(spark, monkeypatch):
    # only the most frequent words have numbers; here that is one
    monkeypatch.setattr(collocations, "NUMBER_BITS", 1)
    rows = some_rows(4)
    assert mined(spark.createDataFrame(rows, "text string, lang string"), least=4) == plain_phrases(rows, 3, 4, 2000, 50)


def test_jobs_do_not_grow_with_shuffle_partitions(spark):
    def jobs(partitions: int) -> int:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            first = max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)
            assert mined(docs, shards=1, longest=2) == expected
            return max(spark.sparkContext.statusTracker().getJobIdsForGroup()) - first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    rows = [("new york times", "en")] * 12
    docs, expected = spark.createDataFrame(rows, "text string, lang string"), plain_phrases(rows, 2, 10, 2000, 50)
    assert abs(jobs(40) - jobs(4)) < 10


def test_many_languages_in_one_slice(spark):
    rows = [(f"word{i} of{i} its own here", f"lang{i}") for i in range(300) for _ in range(2)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert mined(docs, least=2, shards=2) == plain_phrases(rows, 3, 2, 2000, 50)


def test_slices_keep_words_and_pieces():
    text = "New york, new Times.a".encode()
    data, bounds = np.frombuffer(text + b"b", np.uint8), np.array([0, len(text), len(text) + 1])
    words = collocations.Words(data, bounds, ["en", "de"], 0)
    row = dict(zip(collocations.CODED.names, words.coded(0), strict=True))
    cut = collocations.Slice(row["own"], row["numbers"], row["starts"])
    assert cut.ids.tolist() == words.ids.tolist() and cut.starts.tolist() == [True, False, True, False, True, True]
    assert row["words"].split(" ")[0] == "new" and sorted(row["words"].split(" ")) == ["a", "b", "new", "times", "york"]


def test_scores_beyond_64_bits(spark):
    words = spark.createDataFrame(
        [(1, 1, "en", "x", 4_000_000_000_007), (1, 2, "en", "y", 4_000_000_000_009)],
        "size int, k0 long, lang string, word string, n long",
    )
    counted = spark.createDataFrame([(2, 1, 2, 3_999_999_999_999)], "size int, k0 long, k1 long, n long")
    row = collocations.candidates(counted, words, 2, 50).first()
    a, left, right = 3_999_999_999_999, 4_000_000_000_007, 4_000_000_000_009
    assert (row["a"], row["l"], row["r"], row["score"]) == (a, left, right, 1_000_000 * a * a // (left * right))


@pytest.mark.parametrize("bits", [20, 4])
def test_partial_counts_travel_by_part(spark, bits, monkeypatch):
    # a row for each task and part of the keys, not for each task and phrase; the counts are all there
    monkeypatch.setattr(collocations, "NUMBER_BITS", bits)
    monkeypatch.setattr(collocations, "KEY_PARTS", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(" ".join(rng.choices(words, k=200)), "en") for _ in range(150)]
    texts = collocations.coded_slices(spark.createDataFrame(rows, "text string, lang string").repartition(3), 2, 0)
    levels = collocations.reached_cells(texts, 2, 3, 3)
    named = collocations.count_words(texts, levels, 0).cache()
    made, original = [], type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, f, schema, *a: made.append(original(self, f, schema, *a)) or made[-1])
    counted = collocations.count_phrases(texts, named, levels, 3, 3)
    word_of = {r["k0"]: r["word"] for r in named.where("size = 1").collect()}
    got = {tuple(word_of[r[f"k{i}"]] for i in range(r["size"])): r["n"] for r in counted.collect()}
    want = Counter()
    for text, _ in rows:
        own = text.split(" ")
        want.update(tuple(own[i:i + j]) for j in (2, 3) for i in range(len(own) - j + 1))
    assert got == {p: n for p, n in want.items() if n >= 3} and len(got) > 3000
    assert made[0].count() <= 2 * 4 * texts.rdd.getNumPartitions()


def test_partial_counts_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 3):
        keys = rng.integers(-(1 << 63), (1 << 63) - 1, (5000, width))[rng.integers(0, 5000, 9000)]
        if width == 1:
            keys = np.abs(keys >> 4)
        distinct, n = collocations._summed(keys, np.ones(len(keys), np.int64))
        batch = collocations._partial_rows(distinct, n, 10, 7)
        assert 7 <= min(batch.column(0).to_pylist()) and batch.num_rows == len(set(batch.column(0).to_pylist()))
        taken = [collocations._unpack_counts(p.as_py(), width) for p in batch.column(1)]
        back = Counter({tuple(k): m for ks, ms in taken for k, m in zip(ks.tolist(), ms.tolist(), strict=True)})
        assert back == Counter(map(tuple, keys.tolist()))
