from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallymart.llm import alignment

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_alignment(texts: dict[int, str | None]) -> dict[int, tuple]:
    """Tokens, groups, links, best links, sum of counts and groups of each text, all pairs written out."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    # the printable letters of the vocabulary stand for themselves, the other bytes for letters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    linked, out = {}, {}
    for i, text in texts.items():
        linked[i], out[i] = Counter(), (0, 0, 0, "")
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()
            for x in ids_b
        ]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            done, places = 0, []
            for t in tokens:
                done += len(t)
                places.append(done)
            ends.append(places)
        both, groups = sorted(set(ends[0]) & set(ends[1])), []
        for lo, hi in zip([0, *both[:-1]], both, strict=True):
            left = [x for x, e in zip(ids_a, ends[0], strict=True) if lo < e <= hi]
            right = [x for x, e in zip(ids_b, ends[1], strict=True) if lo < e <= hi]
            groups.append((left, right))
            linked[i].update((x, y) for x in left for y in right)
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[i] = (len(ids_a), len(ids_b), len(groups), listed)
    counts = Counter(pair for pairs in linked.values() for pair in pairs)
    most = {x: max(n for (y, _), n in counts.items() if y == x) for x in {p[0] for p in counts}}
    return {
        i: (n_a, n_b, n_groups, sum(linked[i].values()),
            sum(m for p, m in linked[i].items() if counts[p] == most[p[0]]),
            sum(m * counts[p] for p, m in linked[i].items()), listed)
        for i, (n_a, n_b, n_groups, listed) in out.items()
    }


def aligned(docs) -> dict:
    rows = alignment.align(docs, A, B, with_groups=True).collect()
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in rows}


def odd_texts() -> dict[int, str | None]:
    rng = random.Random(5)
    letters = " \n\t\r\x0b 　\u0085abé́'st19,.日\U0001f600▁  "
    texts = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "the ▁ sign", "<s> <0x0A> <|endoftext|>", "a\n\nb\n", "x" * 3000,
             " " * 500, "\n" * 300, "one two three. " * 300, "  one\n two;\r three", "\x00", "日本" * 50]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return dict(enumerate(texts))


def test_equals_all_pairs(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, block long, pair string")
    assert aligned(docs.repartition(3)) == plain_alignment(texts)


def test_dense_and_sparse_bitmaps(spark):
    # every text has "the", so its bitmap is a bitset; multiplicities need several planes
    rng = random.Random(6)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = {i: " ".join(["the"] * (i % 9) + rng.choices(words, k=5)) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert aligned(docs.coalesce(1)) == aligned(docs.repartition(5)) == plain_alignment(texts)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the cat"), (3, "a cat")], "doc_id long, text string")
    indexed = alignment.index(docs, A, B)
    pairs = alignment.pair_counts(indexed, alignment.aligned_units(A, B).vocabulary_b).collect()
    found = {(r["n_docs"], r["n_links"]) for r in pairs}
    assert found == {(2, 4), (2, 2), (1, 1)} and all(r["best"] for r in pairs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (5, None)], "doc_id long, text string")
    rows = alignment.align(docs, A, B).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_links"], r["count_sum"]) for r in rows if r["doc_id"]) == [
        (False, 4, 2, 6), (False, 4, 2, 6), (False, 5, 0, 0)
    ]
    assert len(rows) == 4 and [r["digest"] for r in rows if r["doc_id"] == 5] == [""]
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_stores_age(spark, monkeypatch):
    from tallymart.llm import units

    monkeypatch.setattr(units.UnitStore, "max_units", 50)
    monkeypatch.setattr(alignment, "MAX_UNITS", 50)
    import numpy as np
    import pyarrow as pa

    texts = [t for t in odd_texts().values() if t]
    store, library = units.TokenStore(A), Tokenizer.from_file(A)
    for _ in range(3):
        for some in (texts[:150], texts[100:], texts[:30]):
            got = [ids[x:y].tolist() for ids, b in store.encode(pa.array(some)) for x, y in zip(b[:-1], b[1:], strict=True)]
            assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    pairs = alignment.AlignedUnits(A, B)
    for some in (texts[:150], texts[100:], texts[:150]):
        data = np.frombuffer((" " + " ".join(some)).encode(), np.uint8)
        slots, _ = pairs.look_up(data, np.array([0, len(data)]))
        assert len(pairs.numbers) == len(pairs.strings) == len(pairs.slots) > slots.max()


def test_bitmaps_round_trip():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 7, 64, 1000):
        runs = [np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False)) for _ in range(30)]
        packed, scores = [], []
        for which, maps in alignment.bitmaps(np.concatenate(runs), np.array([len(r) for r in runs]), n):
            packed += maps.to_pylist()
            scores += [[1, int(i) + 1] for i in which]
        want = np.zeros((n, 2), np.int64)
        for i, r in enumerate(runs):
            want[r] += [1, i + 1]
        assert (alignment.add_scores(packed, np.array(scores), n) == want).all()


def test_workers_keep_no_units_after_the_index(spark):
    # the workers live on beside the sorts of later stages, whose memory they would take
    import pyarrow as pa

    def held(batches):
        for _ in batches:
            stores = [s for u in alignment._ALIGNED.values() for s in (u, u.a)]
            yield pa.RecordBatch.from_pydict({"n": [sum(len(s.slots) + len(s.older.slots if s.older else ()) for s in stores)]})

    docs = spark.createDataFrame([(i, f"one two three w{i} v{i}") for i in range(64)], "doc_id long, text string")
    assert alignment.index(docs.repartition(8), A, B).where("kind = 'document' AND n_links > 0").count() == 64
    assert spark.range(0, 64, 1, 32).mapInArrow(held, "n long").where("n > 0").count() == 0


def test_forgotten_units_are_learnt_again():
    import numpy as np

    store, data = alignment.AlignedUnits(A, B), np.frombuffer(b" one two one", np.uint8)
    found = []
    for _ in range(2):
        slots, _ = store.look_up(data, np.array([0, len(data)]))
        found.append((slots.tolist(), store.numbers.tolist(), store.pairs.of(slots).tolist()))
        store.forget()
        assert not store.slots and not store.a.slots and len(store.numbers) == 0
    assert found[0] == found[1]
