"""Secret scan against a plain Python scan."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from tallymart.llm.secrets import ALLOWED, ALLOWED_BEFORE, BASE_KINDS, BEFORE, ENTROPY_CLASSES, find_secrets, redact

SCHEMA = "doc_id long, text string, secrets int, kind string"


def plain(text: str) -> list[tuple[int, str, int]]:
    text, out = text or "", []
    assign = r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))"
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    added = []
    for k, c in enumerate(ENTROPY_CLASSES):
        for m in re.finditer("[" + re.escape(c.alphabet) + "]+", text):
            v = m[0]
            before = text[max(0, m.start() - BEFORE):m.start()]
            if len(v) < c.window or not all(re.search(n, v) for n in c.needs):
                continue
            if any(re.search(a, v) for a in ALLOWED) or re.search(ALLOWED_BEFORE, before):
                continue
            covered = [False] * len(v)
            for i in range(len(v) - c.window + 1):
                counts = Counter(v[i:i + c.window]).values()
                bits = math.log2(c.window) - sum(n * math.log2(n) for n in counts) / c.window
                if bits >= c.min_bits - 1e-9:
                    covered[i:i + c.window] = [True] * c.window
            added += [(m.start() + r.start(), 3 + k, m.start() + r.end(), c.kind)
                      for r in re.finditer("1+", "".join(str(int(x)) for x in covered))]
    out += [s for s in added if not any(b[0] <= s[0] and b[2] >= s[2] for b in out)]
    return sorted(out)


def texts(n: int) -> list[str | None]:
    rng, abc = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    make = [
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 60))),
        lambda: "".join(rng.choices("0123456789abcdefABCDEF", k=rng.randint(18, 40))),
        lambda: "".join(rng.choices(ENTROPY_CLASSES[2].alphabet, k=rng.randint(15, 120))),
        lambda: "AKIA" + "".join(rng.choices(ENTROPY_CLASSES[1].alphabet, k=rng.randint(8, 24))),
        lambda: "".join(rng.choices(ENTROPY_CLASSES[1].alphabet, k=rng.randint(18, 40))),
        lambda: rng.choice(["Token", "API_KEY", "apikey", "secret", "PASSWD"]) + rng.choice(["=", " : ", "\"='", ":  "])
        + "".join(rng.choices(abc + ".=", k=rng.randint(1, 12))),
        lambda: "".join(rng.choices(abc, k=rng.randint(1, 30))), lambda: "é𝒳ü", lambda: "secret=token: abcdefgh",
        lambda: "sha256:" + "".join(rng.choices("0123456789ABCDEF", k=40)), lambda: "ab/cd/ef/gh12345678901234/x",
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "a1" * 30 + "".join(rng.choices("0123456789abcdefAB", k=30)),
    ]
    rows = ["".join(rng.choice(make)() + rng.choice([" ", "\n", "", " é "]) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return [*rows, None, "", rows[0], "token=" + "k" * 30_000 + " " + "0123abcd" * 4000]


def test_equals_plain_scan(spark):
    rows = texts(300)
    df = spark.createDataFrame([(i // 2, t, 7, "x") for i, t in enumerate(rows)], SCHEMA)
    got = find_secrets(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "secrets", "kind"}
    kinds = Counter()
    for r in got:
        want = plain(r["text"])
        assert [tuple(s) for s in r["secrets"]] == want, r["text"][:500]
        kinds.update(s[3] for s in want)
    assert set(kinds) == {*BASE_KINDS, *(c.kind for c in ENTROPY_CLASSES)}


def test_redaction_removes_covered_characters(spark):
    rows = texts(60)
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(rows)], SCHEMA)
    for r in redact(find_secrets(df).withColumnRenamed("text", "text"), mark="\0").collect():
        text = rows[r["doc_id"]]
        hit = [False] * len(text or "")
        for s in r["secrets"]:
            hit[s["start"]:s["end"]] = [True] * (s["end"] - s["start"])
        marks = re.sub("1+", "\0", "".join("1" if h else "0" for h in hit))
        kept = iter(c for c, h in zip(text or "", hit, strict=True) if not h)
        want = "".join("\0" if m == "\0" else next(kept) for m in marks)
        assert (r["text"] or "") == want and (r["text"] is None) == (text is None)


def test_bare_keys_are_found(spark):
    rng, lower = random.Random(8), "0123456789abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower[10:].upper()
    make = {
        "lower": (0.95, lambda: "".join(rng.choices(lower, k=32))),
        "mixed": (0.7, lambda: "".join(rng.choices(mixed, k=rng.randint(20, 23)))),
        "base64": (0.6, lambda: "".join(rng.choices(mixed + "+/", k=rng.randint(20, 23)))),
        "joined": (0.9, lambda: "example/" + "".join(rng.choices(mixed, k=32)) + "-0123456789"),
    }
    rows = [(i, f"see {f()} there", 0, name) for name, (_, f) in make.items() for i in range(100)]
    found = Counter(r["kind"] for r in find_secrets(spark.createDataFrame(rows, SCHEMA)).collect() if r["secrets"])
    assert all(found[name] >= 100 * least for name, (least, _) in make.items()), found
    names = ["uncharacteristically", "src/main/java/com/acme/Foo2BarBaz/UserAccountController", "the_2nd_quick_brown_fox_jumps"]
    got = find_secrets(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(names)], SCHEMA)).collect()
    assert not any(r["secrets"] for r in got)


def test_empty_table(spark):
    assert find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
