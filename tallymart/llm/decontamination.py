"""Benchmark decontamination: spans of training text that also occur in test items.

Test items become normalised n-word windows; their 64-bit hashes form a broadcast hash set. Each training document is
scanned once: every word position looks up the hash of the window that starts there, hits are verified word by word,
and only hits (and one closing row per document) go on to the aggregation. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import alnum_words, stage, with_row_keys

WINDOW = 13
# 20 * n_hit >= n_words: at least a twentieth of the words.
MIN_SHARE = 20
# Bytes of windows and lists of items that are broadcast; more of them are joined by a shuffle.
MAX_BROADCAST_BYTES = 128 << 20


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows of the test items: `window` (words), `len`, `key` (hash) and the `items` that have it.

    An item of fewer than `n` words, but not none, is one window. Null ids mark no item, though their windows count.
    """
    words = items.select(F.col(item_id).alias("item"), alnum_words(F.col(text)).alias("words")).where("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))))
    windows = words.select("item", "words", starts.alias("at")).select(
        "item", F.slice("words", F.col("at"), n).alias("window")
    )
    return windows.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        "window", "items", F.size("window").alias("len"), F.xxhash64("window").alias("key")
    )


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = WINDOW, min_share: int = MIN_SHARE, max_broadcast: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, `text_hash`, `n_words`, `n_hit`, `items` (sorted), `spans`, `contaminated`.

    `spans` are the maximal runs of hit words as (start, end), 0-based word positions, end exclusive.
    Null or empty texts have no words and are clean. Repeated rows each keep their own result row; rows of one id with
    different texts are told apart by the text's hash. Null ids are kept. An empty item table leaves all clean.
    Other columns of either table are ignored. Above `max_broadcast` bytes the test items are joined by shuffles of
    hashes, and the verified hits are written to the shared scratch folder when this is called.
    """
    windows = item_windows(items, item_id, item_text, n).withColumnsRenamed(
        {"window": "_window", "items": "_items", "len": "_len", "key": "_key"}
    )
    size = windows.groupBy("_len").agg(F.sum(_row_bytes()).alias("bytes")).collect()  # at most n rows
    lengths = sorted(r["_len"] for r in size)

    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_text"), alnum_words(F.col(text)).alias("_words")
    )
    # one position more than there are words: the closing row that every document keeps
    at = words.select(
        "_id", "_text", "_words", F.explode(F.sequence(F.lit(0), F.size("_words"))).alias("_at")
    ).withColumn("_closing", F.col("_at") == F.size("_words"))
    if lengths == [n] or not lengths:
        probes = at.withColumn("_probe", _probe(n))
    else:  # short items: one look-up for each window length
        each = F.explode(F.array(*[F.lit(k) for k in lengths]))
        probes = at.withColumn("_n", each).withColumn("_probe", _probe(F.col("_n")))
        probes = probes.where(F.col("_probe").isNotNull() | (F.col("_closing") & (F.col("_n") == lengths[0])))
    hit = F.col("_window").isNotNull() & (
        F.slice("_words", F.col("_at") + 1, F.greatest(F.col("_len"), F.lit(1))) == F.col("_window")
    )
    if sum(r["bytes"] for r in size) <= max_broadcast:
        met = probes.join(F.broadcast(windows), F.col("_probe") == F.col("_key"), "left")
        found = met.where(hit | F.col("_closing")).select(
            "_id", "_text", "_closing", "_at", (F.col("_at") + F.col("_len")).alias("_end"), "_items"
        )
    else:
        found = _found_by_shuffle(words, probes, windows, hit)
    inside = ~F.col("_closing") & F.col("_at").isNotNull()
    per_doc = found.groupBy("_id", "_text").agg(
        F.max(F.when(F.col("_closing"), F.col("_at"))).alias("_n_words"),
        F.count_if("_closing").alias("_copies"),
        F.collect_set(F.when(inside, F.struct("_at", "_end"))).alias("_hits"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("_closing"), F.col("_items"))))).alias("_items"),
    )
    out = per_doc.select(
        F.col("_id").alias(doc_id), F.col("_text").alias("text_hash"), F.col("_n_words").cast("long").alias("n_words"),
        F.array_sort("_items").alias("items"), _merged("_hits").alias("spans"), "_copies",
    ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        doc_id, "text_hash", "n_words", "n_hit", "items", "spans", "contaminated"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns, whatever their names.

    Options are those of the search.
    """
    keyed, who = with_row_keys(docs, doc_id, text)
    found = find_contamination(docs, items, doc_id, text, **options).where("contaminated")
    bad = found.select(
        F.col(doc_id).isNull().alias(who[0]), F.coalesce(F.col(doc_id), F.lit(0)).alias(who[1]),
        F.col("text_hash").alias(who[2]),
    ).distinct()
    return keyed.join(bad, who, "left_anti").select(*docs.columns)


def _probe(n) -> Column:
    """Hash of the `n` words from here on; null where fewer are left, so that it never matches."""
    fits = F.col("_at") + n <= F.size("_words")
    return F.when(fits, F.xxhash64(F.slice("_words", F.col("_at") + 1, n)))


def _row_bytes() -> Column:
    """About what a window takes in a broadcast: its words and items, and 16 bytes for each of them."""
    words = F.octet_length(F.concat_ws(" ", "_window")) + 16 * F.size("_window")
    items = F.octet_length(F.concat_ws(" ", F.col("_items").cast("array<string>"))) + 16 * F.size("_items")
    return (words + items + 64).cast("long")


def _found_by_shuffle(words: DataFrame, probes: DataFrame, windows: DataFrame, hit: Column) -> DataFrame:
    """The rows that the broadcast join finds, from plain joins whose hot keys adaptive execution splits.

    Word positions travel as (id, text hash, position, hash); only documents with a known hash meet their words and
    the windows again, once each. A row without a position carries one item of its document.
    """
    closing = probes.where("_closing").select("_id", "_text", "_closing", "_at")
    slim = probes.where(~F.col("_closing") & F.col("_probe").isNotNull()).select("_id", "_text", "_at", "_probe")
    met = slim.join(windows.select("_key", "_len", "_window"), F.col("_probe") == F.col("_key")).drop("_probe").distinct()
    # one row per document: copies have the same words
    told = words.groupBy("_id", "_text").agg(F.first("_words").alias("_words")).alias("w")
    same = F.col("m._id").eqNullSafe(F.col("w._id")) & (F.col("m._text") == F.col("w._text"))
    verified = stage(
        met.alias("m").join(told, same).where(hit).select(
            "m._id", "m._text", "_at", (F.col("_at") + F.col("_len")).alias("_end"), "_window"
        ), "window_hits",
    )
    listed = windows.select("_window", F.explode("_items").alias("_item"))
    items = verified.select("_id", "_text", "_window").distinct().join(listed, "_window").select(
        "_id", "_text", F.array("_item").alias("_items")
    ).distinct()
    inner = [f.withColumn("_closing", F.lit(False)) for f in (verified.drop("_window"), items)]
    return closing.unionByName(inner[0], allowMissingColumns=True).unionByName(inner[1], allowMissingColumns=True)


def _merged(hits: str) -> Column:
    """(start, end) pairs as maximal disjoint runs, in time that grows with the number of pairs.

    With starts and ends each in order, a run ends at an end that the next start lies beyond.
    """
    starts = F.array_sort(F.transform(hits, lambda h: h["_at"]))
    ends = F.array_sort(F.transform(hits, lambda h: h["_end"]))
    others = F.greatest(F.size(hits) - 1, F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(ends, 1, others))
    opens = F.filter(
        F.zip_with(starts, before, lambda s, e: F.struct(s.alias("at"), e.alias("other"))),
        lambda x: x["at"].isNotNull() & (x["other"].isNull() | (x["at"] > x["other"])),
    )
    closes = F.filter(
        F.zip_with(ends, F.slice(starts, 2, others), lambda e, s: F.struct(e.alias("at"), s.alias("other"))),
        lambda x: x["other"].isNull() | (x["other"] > x["at"]),
    )
    return F.zip_with(opens, closes, lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("end")))
