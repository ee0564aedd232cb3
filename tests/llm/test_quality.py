"""Quality rules against a plain count, and the bands on texts of known kind."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter

from tallymart.llm.quality import WORD, judge, repeated_words

SCHEMA = "doc_id long, text string, kept string, n_words int"


def plain_repeats(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})


def test_repeated_words_equal_plain_count():
    rng = random.Random(1)
    for _ in range(400):
        words = rng.choices([f"w{i}" for i in range(rng.randint(1, 30))], k=rng.randint(0, 80))
        assert repeated_words(words) == plain_repeats(words)
    many = [f"w{i}" for i in range(9000)]
    words = many + many[100:130] + ["x"] * 7
    assert repeated_words(words) == plain_repeats(words)


def prose(rng, n):
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_measures_and_verdicts(spark):
    rng = random.Random(2)
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    spaced = " ".join(noise(9) for _ in range(2000))
    rows = {
        "prose": prose(rng, 400), "short": prose(rng, 12), "long": prose(rng, 20_000), "few": "one two", "null": None,
        "empty": "", "blank": " \n\t", "noise": spaced, "lines": "\n".join(["a line of words"] * 3 + [" ", "", " "]),
        "same": "word " * 3000, "letters": " ".join("ab" * rng.randint(3, 9) for _ in range(900)),
        "half": prose(rng, 900) + " " + " ".join("ha" + "ab" * (i % 37) for i in range(900)),
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows.values())] * 2, SCHEMA)
    got = judge(df).collect()
    assert len(got) == 2 * len(rows)
    by = {name: next(r["quality"] for r in got if r["doc_id"] == i) for i, name in enumerate(rows)}
    for name, text in rows.items():
        words, q = WORD.findall(text or ""), by[name]
        lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
        assert q["n_words"] == len(words) and q["word_chars"] == sum(map(len, words))
        assert q["n_repeat_words"] == plain_repeats(words) and q["n_dup_lines"] == len(lines) - len(set(lines))
        assert q["base_failed"] == (len(words) < 10 or 100 * q["n_repeat_words"] > 20 * len(words))
    assert [n for n in rows if by[n]["kept"]] == ["prose", "short", "long"]
    assert not by["noise"]["base_failed"] and not by["letters"]["kept"]


def test_noise_at_every_length_and_in_part(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n // 9 + 1))[:n]
    text = prose(rng, 20_000)
    short = [noise(n) for n in (128, 159, 191, 255, 383, 511, 512, 623, 767, 1023, 1169, 1884, 2047, 2048, 5000) for _ in range(20)]
    # a third of the chunks may be bad, no more
    part = {0: text[:40_000], 25: text[:30_000] + noise(10_000), 45: text[:40_000] + noise(33_000),
            62: text[:40_000] + noise(65_000), 60: text[:41_000] + noise(63_000)}
    rows = [*short, *part.values()]
    got = judge(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], SCHEMA)).collect()
    by = {r["doc_id"]: r["quality"] for r in got}
    assert not any(by[i]["base_failed"] or by[i]["kept"] for i in range(len(short)))
    for at, (percent, whole) in enumerate(part.items(), len(short)):
        q = by[at]
        assert abs(100 * q["n_bad_chunks"] / q["n_chunks"] - percent) < 6, (percent, q)
        assert q["kept"] == (percent < 30) and not q["base_failed"], (percent, len(whole), q)


def test_prose_of_every_length_is_kept(spark):
    rng = random.Random(4)
    text = prose(rng, 20_000)
    rows = [text[at:at + n] for n in (128, 160, 192, 256, 384, 512, 768, 1024, 1500, 2048, 3100, 9000, 40_000)
            for at in range(0, 50_000, 5_000)]
    got = judge(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], SCHEMA)).collect()
    assert all(r["quality"]["kept"] and not r["quality"]["n_bad_chunks"] for r in got)


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
