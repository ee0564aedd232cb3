"""Encoding, decoding and token files against the tokenizers library itself."""

from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymart.llm import bpe, token_files

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts() -> list[str | None]:
    rng = random.Random(3)
    bits = ["don't", "we're", "I'll", "'", "''s", "'r", "e", "re", " ", "\n\n", "\t", "é", "Ñ", "ß", "1234", "½", "!!", "...",
            "word", "the ", "Then ", "-", "“q”", "…", ".'ve"]
    rare = ["İ", "́", "日本", "🙂", "\x1c", "\xa0", "<|endoftext|>", "ǅ", "Σας", "\x85"]
    out = ["".join(rng.choices(bits, k=rng.randint(1, 900))) for _ in range(150)]
    out += ["".join(rng.choices(bits + rare, k=rng.randint(1, 60))) for _ in range(80)]
    return [*out, *out[:5], None, "", " \n", "a" * 5000, "'" * 3000, ("x" * 700 + "'") * 3, "no space" * 4000]


def test_every_safe_character(library):
    texts = [f"a{c}b {c} {c}{c}1'{c}s" for c in bpe.SAFE]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    made = bpe.Encoder(PATH)
    assert made.encode(texts) == want and made.counts["whole"] == 0


def test_joins_agree_at_any_cut(library):
    rng, made = random.Random(4), bpe.Encoder(PATH)
    for text in [t.lower() for t in hard_texts()[:120]]:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for _ in range(4):
            cuts = sorted({rng.randint(1, len(text)) for _ in range(rng.randint(0, 60))} | {len(text)})
            assert made._joined(text, cuts) == want
        assert made._joined(text, list(range(1, len(text) + 1))) == want


def test_chunks_are_reused():
    made, shared = bpe.Encoder(PATH), " ".join(f"word{i % 97} {i}" for i in range(4000))
    made.encode([f"first {shared}", f"another beginning {shared}"])
    assert made.counts["reused"] > 0.4 * made.counts["chunks"]


def test_encode_and_decode(spark, library):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want, t
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_bounded_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 3)
    made, texts = bpe.Encoder(PATH), [t for t in hard_texts() if t]
    assert made.encode(texts) == [
        np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts
    ]


def test_words_beyond_the_store_are_merged_once_a_slice(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    rng, made, merged = random.Random(6), bpe.Encoder(PATH), []
    words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(60)]
    text = " ".join(rng.choices(words, k=6000))
    sys.setprofile(lambda frame, event, arg: merged.append(1) if event == "c_call" and arg.__name__ == "tokenize" else None)
    try:
        made.encode([text])
    finally:
        sys.setprofile(None)
    assert 0 < len(merged) <= 3 * len(words)


def test_chunks_of_any_characters_are_reused(library):
    made, shared = bpe.Encoder(PATH), " ".join(f"слово{i % 97} {i} € 日本 e\u0301" for i in range(2000))
    texts = [f"first {shared}", f"another beginning {shared}"]
    assert made.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert made.counts["reused"] > 0.4 * made.counts["chunks"]


def test_token_files_round_trip(spark, library):
    texts = hard_texts()
    ids = [None, None, *range(len(texts) - 4, -1, -1), 3]
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, prefix string")
    manifest = token_files.write_tokens(df, PATH, 2, shards=5)
    got = token_files.read_tokens(manifest).collect()

    def of(t):
        return np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")

    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i is not None, i or 0, len(of(t)), zlib.crc32(of(t).tobytes())) for i, t in rows)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in in_order] == [0, *np.cumsum([r["n_tokens"] for r in in_order])[:-1]]
    shard = manifest.orderBy("part").first()
    assert token_files.mapped(shard["prefix"] + ".ids", shard["dtype"]).dtype == np.dtype("<u2")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(df, PATH, 2)).count() == 0
