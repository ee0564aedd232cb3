"""Removal of long byte strings that occur more than once, by suffix arrays per shard.

Which strings have to meet: every window of 400 bytes picks an anchor, its 64-byte gram of least hash, so equal windows
pick equal anchors. A document is cut into segments, each being the run of windows with one anchor. Equal segments are
counted before anything else moves; only segments of anchors that occur more than once go on, and of equal ones only
one copy. The segments of an anchor lie in one shard of bounded size. A shard gets a suffix array by Larsson-Sadakane
refinement and common prefixes by Kasai's rule; a window is repeated if 400 bytes are shared with a neighbour in the
order, or if its segment occurs more than once. An anchor with more segments than a shard takes is cut into several
shards; each pair of them is a unit of work, which looks up the windows of one in the array of the other by binary
search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import identity, stage
from tallymart.llm.suffix_arrays import (
    Shard, found_in, lay_out, repeated_within, suffix_array, window_places,
)

SPAN, GRAM = 400, 64
#: Bytes of one suffix array, and windows of a very long text that are anchored at a time (places take PLACE_BITS).
SHARD_BYTES, BLOCK, PLACE_BITS = 3 << 20, 1 << 22, 23
WHO = ["_no_id", "_of", "_hash"]


def packed(docs: DataFrame) -> DataFrame:
    """The identified rows with their text compressed, for joins that move all texts."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.array([squeeze(t.as_py().encode()) for t in column], pa.binary())

    return docs.select("_id", *WHO, pack("_text").alias("_packed"))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each place on."""
    h, span, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        h = h[:-span] * np.uint64(base) + h[span:]
        span, base = span * 2, base * base % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def cut_segments(text: bytes, span: int = SPAN, block: int = BLOCK) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, windows) of each run of windows with one anchor."""
    for begin in range(0, len(text) - span + 1, block):
        data = np.frombuffer(text[begin:begin + block + span - 1], np.uint8)
        hashes, width = gram_hashes(data), span - GRAM + 1
        low = np.uint64((1 << PLACE_BITS) - 1)
        # the least hash of each window and, of equal ones, the leftmost
        least, reach = hashes & ~low | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach:])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        many = np.diff(np.append(first, len(place)))
        anchors = hashes[place[first]].view(np.int64)
        yield from zip(anchors.tolist(), (first + begin).tolist(), many.tolist(), strict=True)


def segments(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per segment of the identified texts `_text`: who, anchor, digest, first window, number of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, found = [], []
            for i, text in enumerate(batch.column("_text")):
                data = text.as_py().encode()
                for anchor, first, many in cut_segments(data, span):
                    who.append(i)
                    found.append((anchor, xxhash.xxh3_64_intdigest(data[first:first + many + span - 1]), first, many))
            if found:
                anchor, digest, first, many = (np.array(c) for c in zip(*found, strict=True))
                same = batch.select(WHO).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([
                    *same.columns, pa.array(anchor), pa.array(digest.astype(np.uint64).view(np.int64)),
                    pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32)),
                ], [*WHO, "anchor", "digest", "first", "many"])

    schema = "_no_id boolean, _of long, _hash long, anchor long, digest long, first int, many int"
    return docs.select(*WHO, "_text").mapInArrow(cut, schema)


def repeated_starts(docs: DataFrame, cut: DataFrame, span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`anchor`, `digest` -> runs (`low`, `high`) of its windows that occur more than once."""
    distinct = cut.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in (*WHO, "first", "many")]
    )
    distinct = stage(distinct, "segments-distinct")
    anchors = distinct.groupBy("anchor").agg(
        F.sum("times").alias("all_times"), F.count(F.lit(1)).alias("kinds"),
        F.sum((F.col("many") + span).cast("long")).alias("bytes"),
    )
    shared = anchors.where("all_times > 1")
    alone = distinct.join(shared.where("kinds = 1").select("anchor"), "anchor").select(
        "anchor", "digest", F.lit(0).alias("low"), F.col("many").alias("high")
    )
    blocks = F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("_blocks")
    wanted = distinct.join(shared.where("kinds > 1").select("anchor", blocks), "anchor")

    @F.arrow_udf("binary")
    def cut_out(packs: pa.Array, first: pa.Array, many: pa.Array) -> pa.Array:
        out, last, data = [], None, b""
        for pack, a, n in zip(packs, first.to_pylist(), many.to_pylist(), strict=True):
            pack = pack.as_py()
            if pack != last:  # rows of one document follow each other
                last, data = pack, zstandard.decompress(pack)
            out.append(data[a:a + n + span - 1])
        return pa.array(out, pa.binary())

    with_text = packed(docs).join(wanted, WHO).select(
        "anchor", "digest", "times", "_blocks", cut_out("_packed", "first", "many").alias("segment")
    )
    own = F.pmod(F.col("digest"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    units = with_text.withColumn("_own", own).withColumn("_other", other).select(
        "anchor", "digest", "times", "segment", F.least("_own", "_other").alias("_a"),
        F.greatest("_own", "_other").alias("_b"), "_own",
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "anchor", "_a", "_b").sortWithinPartitions("anchor", "_a", "_b", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches, shard_bytes):
            yield from _emit(_work_unit(rows, span), rows)

    schema = "anchor long, digest long, low int, high int"
    return alone.unionAll(dealt.mapInArrow(work, schema))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one unit, without those that bring a segment again (from documents that are there twice)."""
    unit: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for row in batch.slice(at, 1000).to_pylist():
                if unit and any(row[c] != unit[0][c] for c in ("anchor", "_a", "_b")):
                    yield unit
                    unit = []
                if not unit or row["digest"] != unit[-1]["digest"]:
                    unit.append(row)
    if unit:
        yield unit


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[dict]]:
    """A unit of two shards, or as many units of one shard as stay within `limit` bytes together."""
    held, held_bytes = [], 0
    for unit in _units(batches):
        if unit[0]["_a"] != unit[0]["_b"]:
            yield unit
            continue
        more = sum(len(r["segment"]) for r in unit)
        if held and held_bytes + more > limit:
            yield held
            held, held_bytes = [], 0
        held.extend(unit)
        held_bytes += more
    if held:
        yield held


def _work_unit(rows: list[dict], span: int) -> list[np.ndarray]:
    """For each row, which of its windows are repeated."""
    if rows[0]["_a"] == rows[0]["_b"]:
        shard = lay_out([r["segment"] for r in rows])
        return _split(repeated_within(shard, suffix_array(shard), np.array([r["times"] for r in rows]), span), shard, span)
    sides = [[i for i, r in enumerate(rows) if r["_own"] == side] for side in (rows[0]["_a"], rows[0]["_b"])]
    shards = [lay_out([rows[i]["segment"] for i in side]) for side in sides]
    orders = [suffix_array(s) for s in shards]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(rows)
    for mine, theirs in ((0, 1), (1, 0)):
        places = np.flatnonzero(window_places(shards[mine], span))
        hit = np.zeros(len(shards[mine].end), bool)
        hit[places] = found_in(shards[mine], places, shards[theirs], orders[theirs], span)
        for i, windows in zip(sides[mine], _split(hit, shards[mine], span), strict=True):
            out[i] = windows
    return out


def _split(hit: np.ndarray, shard: Shard, span: int) -> list[np.ndarray]:
    return [hit[a:a + n - span + 1] for a, n in zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)]


def _emit(hits: list[np.ndarray], rows: list[dict]) -> Iterator[pa.RecordBatch]:
    out = []
    for windows, row in zip(hits, rows, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], windows, [False]]).astype(np.int8)))
        out += [(row["anchor"], row["digest"], a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    if out:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["anchor", "digest", "low", "high"]
        )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, `n_bytes`, `spans` (removed runs as start, end) and `kept` (the other bytes).

    Every byte covered by a `span`-byte string that also starts anywhere else in the table is removed, judged on the
    texts as they came. Null texts are empty; texts of fewer bytes than `span` stay whole. Repeated rows count as
    places of their own, so they lose what they share, which is all if they are long enough. Null ids are kept. Other
    columns are ignored. An empty table gives no rows.
    """
    known = identity(docs, doc_id, text)
    cut = stage(segments(known, span), "segments")
    runs = repeated_starts(known, cut, span, shard_bytes)
    hits = cut.join(runs, ["anchor", "digest"]).select(
        *WHO, F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + span - 1).alias("end")).alias("hit")
    )
    spans = hits.groupBy(*WHO).agg(F.array_sort(F.collect_set("hit")).alias("_hits"))

    @F.arrow_udf("struct<n_bytes:long,spans:array<struct<start:int,end:int>>,kept:binary>")
    def without(packs: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for value, runs_ in zip(packs, found, strict=True):
            data, merged = zstandard.decompress(value.as_py()), []
            for hit in runs_.as_py() or []:
                if merged and hit["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], hit["end"])
                else:
                    merged.append(dict(hit))
            stops = [0, *[x for m in merged for x in (m["start"], m["end"])], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True))
            rows.append({"n_bytes": len(data), "spans": merged, "kept": kept})
        item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("spans", item), ("kept", pa.binary())]))

    joined = packed(known).join(spans, WHO, "left").withColumn("_out", without("_packed", "_hits"))
    return joined.select(F.col("_id").alias(doc_id), "_out.n_bytes", "_out.spans", "_out.kept")
