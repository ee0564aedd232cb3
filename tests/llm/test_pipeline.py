"""The corpus pipeline stage by stage against plain versions on its own input."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
import public_tokenizers
from test_decontamination import plain as plain_contamination
from test_quality import plain_repeats
from test_secrets import plain as plain_secrets
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from tallymart.llm.common import read_table


def redacted(text, spans):
    hit = [False] * len(text or "")
    for start, _, end, _ in spans:
        hit[start:end] = [True] * (end - start)
    marks = re.sub("1+", "\0", "".join("01"[h] for h in hit))
    kept = iter(c for c, h in zip(text or "", hit, strict=True) if not h)
    return "".join("[SECRET]" if m == "\0" else next(kept) for m in marks)


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in read_table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert [n for n, _ in pipeline.STAGES] == [
        "quality rules", "near-duplicates", "decontamination", "secret scan", "BPE tokens"]
    for number, (_, step) in enumerate(pipeline.STAGES):
        docs = step(spark, docs, sf_dir)
        got = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(got)
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            for doc_id, text in rows.items():
                words = re.findall("[^\x20\x09-\x0d]+", text or "")
                failed = len(words) < 10 or 100 * plain_repeats(words) > 20 * len(words)
                assert not (failed and doc_id in got)
            assert 0.6 * len(rows) < len(got) < len(rows)
        if number == 1:
            ids = sorted(rows)
            of = plain_components(ids, [plain_fingerprint(rows[i]) for i in ids])
            assert set(got) == set(of)
        if number == 2:
            assert set(got) == {i for i, t in rows.items() if not plain_contamination(t, items, 13)[-1]}
        if number == 3:
            assert {i: r["text"] for i, r in got.items()} == {i: redacted(t, plain_secrets(t)) for i, t in rows.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        if number == 4:
            library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
            for i, t in rows.items():
                want = library.encode(t, add_special_tokens=False).ids
                assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
                assert got[i]["n_decoded_chars"] == len(library.decode(want, skip_special_tokens=False))
        else:
            rows = {i: r["text"] for i, r in got.items()}
    assert pipeline.run(spark, sf_dir).count() == len(got)
