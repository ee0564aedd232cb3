from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymart.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain_best_fit(lengths, capacity, most):
    """Bins as a list of [free, number], searched from end to end."""
    bins, made, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            space = min(b[0] for b in fitting)
            b = next(x for x in reversed(bins) if x[0] == space)
            bins.remove(b)
        else:
            if len(bins) == most:
                space = min(x[0] for x in bins)
                bins.remove(next(x for x in reversed(bins) if x[0] == space))
            b, made = [capacity, made], made + 1
        out.append((b[1], capacity - b[0]))
        if b[0] > n:
            bins.append([b[0] - n, b[1]])
    return out


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_best_fit_against_search(most):
    rng = random.Random(most)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        assert packing.best_fit(lengths, 20, most) == plain_best_fit(lengths, 20, most)


def packed_ids(packed) -> dict[int, bytes]:
    return {r["sequence_id"]: (r["ids"], r["n_tokens"], r["n_pieces"]) for r in packing.sequences(packed).collect()}


def test_documents_come_back_from_sequences(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ["", None, "a", "<|endoftext|> b", " ", "word " * 700, "\n\n x"] + [
        " ".join(rng.choice(["red", "blue", "été", "日本", "x,y"]) for _ in range(rng.randint(0, 90))) for _ in range(200)
    ]
    docs = spark.createDataFrame(
        [(i, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, piece int, sequence_id string"
    ).repartition(3)
    packed = packing.pack(packing.cut_pieces(docs, PATH, 0, 64), 64)
    rows, whole = packed.collect(), packed_ids(packed)
    back: dict[int, dict] = {}
    for r in rows:
        ids = whole[r["sequence_id"]][0][4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert ids == r["ids"]
        back.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(ids, "<u4").tolist()
        assert r["length"] == 64 or r["piece"] == 0
    for i, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for s in sorted(back[i]) for x in back[i][s]] == want
    total = sum(n for _, n, _ in whole.values())
    assert all(n <= 64 for _, n, _ in whole.values()) and sum(k for *_, k in whole.values()) == len(rows)
    assert len(whole) <= 1.1 * -(-total // 64)


def test_clashing_names_repeats_nulls_and_empty_tables(spark):
    pieces = spark.createDataFrame(
        [(None, 3, "a", 1, 2), (1, 3, "b", 1, 2), (1, 3, "b", 1, 2), (2, 5, "c", 1, 2)],
        "id long, length long, _key string, offset int, SEQUENCE_ID int",
    )
    packed = packing.pack(pieces, 5)
    assert packed.columns == ["id", "length", "_key", "sequence_id", "offset"]
    rows = packed.collect()
    assert sorted(r["_key"] for r in rows) == ["a", "b", "b", "c"]
    assert len({r["sequence_id"] for r in rows}) == 4 and {r["offset"] for r in rows} == {0}
    assert packing.pack(pieces.limit(0), 5).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.cut_pieces(empty, PATH, 0).count() == 0


@pytest.mark.parametrize("length", [None, 0, 6])
def test_lengths_outside_raise(spark, length):
    with pytest.raises(Exception, match="outside 1 to 5"):
        packing.pack(spark.createDataFrame([(length,), (2,)], "length long"), 5).collect()
