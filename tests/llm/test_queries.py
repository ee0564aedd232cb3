"""The registered queries that SQL cannot express, with their digest columns, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_alignment import plain_alignment
from test_quality import plain_repeats
from test_simhash import plain_components, plain_fingerprint
from test_suffix_dedup import plain as plain_removal
from tokenizers import Tokenizer

from tallymart.llm.common import read_table
from tallymart.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in read_table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    encoded = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    return encoded, {i: library.decode(e, skip_special_tokens=False) for i, e in encoded.items()}


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(spark, sf_dir, name, columns):
    return {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, sf_dir).select("doc_id", *columns).collect()}


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert {"op1_decontamination", "op2_secrets", "op8_licenses", "op9_url_filter", "op10_warc", "op11_collocations"} == set(ORACLES)


def test_quality(spark, sf_dir, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rows_of(spark, sf_dir, "op3_quality", [*names, "kept"])
    for i, text in texts.items():
        words, seen, again = re.findall("[^\x20\x09-\x0d]+", text), set(), 0
        for line in text.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                again += line in seen
                seen.add(line)
        repeats = plain_repeats(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, repeats, failed)
        assert got[i][:-1] == want and not (failed and got[i][-1])


def test_token_files(spark, sf_dir, texts, ids):
    got, start = rows_of(spark, sf_dir, "op4_token_files", ["start", "n_tokens", "ids_crc32"]), 0
    for i in sorted(texts):
        data = np.array([*ids[0][i], 2], "<u4")
        assert got[i] == (start, len(data), zlib.crc32(data.tobytes()))
        start += len(data)


def test_simhash(spark, sf_dir, texts):
    got, order = rows_of(spark, sf_dir, "op5_simhash", ["fingerprint", "component_id"]), sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in order]
    assert [got[i] for i in order] == [(f"{f:016x}", c) for f, c in zip(fps, plain_components(order, fps), strict=True)]


def test_bpe(spark, sf_dir, texts, ids):
    got = rows_of(spark, sf_dir, "op6_bpe", ["n_tokens", "ids_sha256", "decoded_sha256"])
    assert got == {i: (len(e), sha(" ".join(map(str, e))), sha(ids[1][i])) for i, e in ids[0].items()}


def test_suffix_dedup(spark, sf_dir, texts):
    got, order = rows_of(spark, sf_dir, "op7_suffix_dedup", ["n_bytes", "n_removed", "n_spans", "kept_sha256"]), sorted(texts)
    for i, (n, runs, kept) in zip(order, plain_removal([texts[i] for i in order], 400), strict=True):
        assert got[i] == (n, n - len(kept), len(runs), sha(kept))


def test_packing(spark, sf_dir, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = QUERIES["op12_packing"](spark, sf_dir).collect()
    got, want = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}, {}
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert got == want and len(rows) == len(want)
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(filled) <= -(-sum(w[1] for w in want.values()) // 2048) * 1.02 + 1


def test_alignment(spark, sf_dir, texts):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(spark, sf_dir, "op13_alignment", names) == {
        i: (*row[:-1], sha(row[-1]) if row[-1] else "") for i, row in plain_alignment(texts).items()
    }
