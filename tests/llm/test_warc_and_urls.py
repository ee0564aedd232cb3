"""WARC round trips, and the URL filter against plain Python."""

from __future__ import annotations

import hashlib
import io
import random
from base64 import b32encode

import pytest

from tallymart.llm import warc
from tallymart.llm.reputation import RULES, judge_urls
from tallymart.llm.shared_files import file_system

PAGES = "page_id long, url string, html string, host string, record_type int"


def page_rows():
    rng = random.Random(2)
    bodies = ["", None, "<p>é</p>", "x" * 300_000, "a\r\n\r\nb", "🙂" * 50, *[f"page {i}" for i in range(20)]]
    rows = [(i, rng.choice([f"http://h{i % 5}.example.org/a?b", "http://x y/\r\nEvil: 1", None]), rng.choice(bodies), "h", 1)
            for i in range(120)]
    return [*rows, (None, None, "only null", "h", 1), (None, "u", "page 3", "h", 1), rows[0], rows[119]]


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    rows = page_rows()
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), least_revisit_bytes=least)
    got = warc.read_warc(manifest).collect()
    largest = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        largest[b] = max(filter(lambda x: x is not None, (largest.get(b), i)), default=None)
    want = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= least and largest[b] is not None and i != largest[b]
        want.append((i, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                     largest[b] if again else None, None if again else b))
    key = lambda r: tuple((v is not None, v or type(v)()) if v is not None else (False, 0) for v in r[:5])
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                        "payload")) for r in got], key=key) == sorted(want, key=key)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)


def test_reader_notices_damage(spark):
    manifest = warc.write_warc(spark.createDataFrame(page_rows()[:9], PAGES).coalesce(1)).collect()
    store, path = file_system(manifest[0]["path"])
    data = store.open_input_file(path).read()
    whole = list(warc.members(io.BytesIO(data), 7))
    assert len(whole) == 9
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))
    good = next(m for m in whole if b"response" in m and b"page" in m)
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"page ", b"pagE "))
    with pytest.raises(ValueError):
        warc.parse(good + b"x")


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_warc(warc.write_warc(pages)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge_urls(pages, labels).count() == 0


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best


def test_hosts_rules_and_bounds(spark):
    urls = [None, "", "no scheme", "HTTPS://WWW.Example.COM/en/a?q#f", "http://example.com/en/", "http://xexample.com/en/x",
            "http://a.net/fr/1", "http://a.net/en/1", "http://net/es/", "http://com", "http://com/", "http://ÀB.net:80?x=/",
            "x://y://z/p", "http://u@h.org#/a", "http:///only/path", "://h.net/es/é\n?x"]
    bad = [f"http://bad.spam.org/{i}" for i in range(200)]
    good = [f"http://fine.good.org/{i}" for i in range(200)]
    rows = [(i, u, "", "clash", 1) for i, u in enumerate(urls + bad + good)]
    rows += [(None, "http://fresh.spam.org/", "", "c", 1), rows[3]]
    n = len(urls)
    labels = [(n + i, 0, 0) for i in range(100)] + [(n + 200 + i, 1, 0) for i in range(100)] + [(n, None, None), (None, 1, 0)]
    got = judge_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    result = got.collect()
    assert len(result) == len(rows)
    by_id = {r["page_id"]: r for r in result}
    for i, u, *_ in rows:
        host, path, best = plain_rule(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None), u
        if best:
            assert r["verdict"] == best.verdict
    assert {by_id[n + i]["verdict"] for i in range(200)} == {"block"}
    assert {by_id[n + 200 + i]["verdict"] for i in range(200)} == {"allow"}
    # a host without outcomes has its domain's prior, but less weight behind it
    assert by_id[n]["upper"] < by_id[None]["upper"] < by_id[n + 200]["upper"] + 1
