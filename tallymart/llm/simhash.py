"""Near-duplicates by SimHash fingerprints, linked through Gray-order hierarchical indexes.

Two fingerprints that differ in at most three bits agree in one of four 16-bit blocks, and of the other 48 bits in one
of four 12-bit blocks. So every distinct fingerprint goes to its sixteen buckets of 28 agreeing bits, where all its
partners are. A bucket's fingerprints are sorted by Gray rank, which puts similar bit patterns side by side, and built
into a tree: an upper node holds the bits that all below it share. A search adds up, level by level, the differences in
the bits that a node fixes beyond its parent, and leaves a whole group once the sum passes three. Buckets of any size
are cut into blocks of bounded size, and each pair of blocks is a unit of work of its own.

A unit emits a spanning forest instead of pairs. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallymart.llm.common import stage, with_row_keys

SEED, SHINGLE, DISTANCE = 42, 3, 3
BLOCK, SUB_BLOCK = 16, 12
#: Fingerprints of a bucket that one unit of work takes from each side.
UNIT_ROWS = 4096
FANOUT = 8
BATCH_ROWS, FRONTIER = 100_000, 400_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of 3-word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE]), SEED) for i in range(n)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.array(hashes[at:at + (1 << 14)], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


@F.arrow_udf(LongType())
def fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in column], pa.int64())


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (long), `component` (smallest reachable id), `root`, `text_hash`.

    Null, empty and blank texts have fingerprint 0, which links like any other. Null ids take part in linking but are
    never the smallest, so a component of null ids only has a null `component`. Repeated rows stay. Other columns are
    ignored; `root` is the component's least fingerprint and `text_hash` tells rows with one id apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(
        F.col(doc_id).alias("_id"), fingerprints(body).alias("_fp"), F.xxhash64(body).alias("_text_hash")
    )
    marked = stage(marked, "fingerprints")
    firsts = marked.groupBy("_fp").agg(F.min("_id").alias("_first"))
    roots = components(links(firsts.select("_fp")))
    rooted = firsts.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("_root").agg(F.min("_first").alias("_component"))
    of_fp = rooted.join(least, "_root").select("_fp", "_root", "_component")
    return marked.join(of_fp, "_fp").select(
        F.col("_id").alias(doc_id), F.col("_fp").alias("fingerprint"), F.col("_component").alias("component"),
        F.col("_root").alias("root"), F.col("_text_hash").alias("text_hash"),
    )


def bucket_keys(fp: Column) -> Column:
    """The sixteen buckets of a fingerprint: which blocks agree, and their 28 bits."""
    keys = []
    for b in range(4):
        block = F.shiftrightunsigned(fp, b * BLOCK).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << (b * BLOCK)) - 1)
        high = F.shiftrightunsigned(fp, (b + 1) * BLOCK) if b < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, b * BLOCK).bitwiseOR(low)
        for c in range(4):
            sub = F.shiftrightunsigned(rest, c * SUB_BLOCK).bitwiseAND(0xFFF)
            name = F.lit(b * 4 + c).cast("long")
            keys.append(F.shiftleft(name, 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return F.array(*keys)


def links(fps: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Spanning links (`src` > `dst`) of the distinct fingerprints `_fp` that differ in at most three bits."""
    keyed = fps.select("_fp", F.explode(bucket_keys(F.col("_fp"))).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = keyed.join(sizes, "_key").withColumn("_blocks", F.ceil(F.col("_n") / unit_rows).cast("int"))
    own = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    units = sized.select("_fp", "_key", own.alias("_own"), other.alias("_other")).select(
        "_fp", "_key", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"),
        # bit 1: searches, bit 2: is searched
        F.when(F.col("_own") == F.col("_other"), 3).when(F.col("_own") < F.col("_other"), 1).otherwise(2).alias("_role"),
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "_key", "_a", "_b").sortWithinPartitions("_key", "_a", "_b")
    return dealt.mapInArrow(_search_units, "src long, dst long").distinct()


def _search_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        held = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in rows}
        n = len(held["_fp"])
        if n >= BATCH_ROWS:
            unit = _unit_starts(held)
            if (cut := int(unit[-1])) > 0:  # the last unit may go on
                yield from _forest({c: v[:cut] for c, v in held.items()})
                held = {c: v[cut:] for c, v in held.items()}
    if held is not None:
        yield from _forest(held)


def _unit_starts(rows: dict[str, np.ndarray]) -> np.ndarray:
    new = np.zeros(len(rows["_fp"]), bool)
    new[0] = True
    for c in ("_key", "_a", "_b"):
        new[1:] |= rows[c][1:] != rows[c][:-1]
    return np.flatnonzero(new)


def _forest(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    starts = _unit_starts(rows)
    unit = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows["_fp"])]))
    values = rows["_fp"].view(np.uint64)
    src, dst = search(values, unit, (rows["_role"] & 2) > 0, (rows["_role"] & 1) > 0)
    if not len(src):
        return
    names, ends = np.unique(np.concatenate([rows["_fp"][src], rows["_fp"][dst]]), return_inverse=True)
    root = _roots(len(names), ends[: len(src)], ends[len(src):])
    moved = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["src", "dst"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_index(values: np.ndarray, unit: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of a forest with one tree per unit, leaves first; `values` are sorted by unit and Gray rank.

    A node has the bits that all its leaves share (`mask`, `value`), its children (`first`, `count`) one level below,
    and the end of its range of leaves.
    """
    every = np.full(len(values), ~np.uint64(0))
    level = {"mask": every, "value": values, "unit": unit, "end": np.arange(1, len(values) + 1)}
    levels, roots = [level], len(np.unique(unit))
    while len(level["unit"]) > roots:
        u = level["unit"]
        new = np.concatenate([[True], u[1:] != u[:-1]])
        place = np.arange(len(u)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero(place % FANOUT == 0)
        # a bit is shared below if all children fix it alike
        fixed = np.bitwise_and.reduceat(level["mask"], first)
        ones, zeros = np.bitwise_or.reduceat(level["value"], first), np.bitwise_and.reduceat(level["value"], first)
        mask = fixed & ~(ones ^ zeros)
        last = np.append(first[1:], len(u)) - 1
        level = {
            "mask": mask, "value": zeros & mask, "unit": u[first], "first": first,
            "count": last - first + 1, "end": level["end"][last],
        }
        levels.append(level)
    return levels


def search(values: np.ndarray, unit: np.ndarray, searched: np.ndarray, searching: np.ndarray,
           distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers of one unit whose values differ in at most `distance` bits.

    Rows that are both `searched` and `searching` meet each other once.
    """
    tree = np.flatnonzero(searched)
    tree = tree[np.lexsort((gray_rank(values[tree]), unit[tree]))]
    queries = np.flatnonzero(searching)
    if not len(tree) or not len(queries):
        return np.empty(0, int), np.empty(0, int)
    levels = build_index(values[tree], unit[tree])
    leaf_of = np.full(len(values), -1)
    leaf_of[tree] = np.arange(len(tree))
    top = levels[-1]
    root = np.searchsorted(top["unit"], unit[queries])
    here = (root < len(top["unit"])) & (top["unit"][np.minimum(root, len(top["unit"]) - 1)] == unit[queries])
    queries, root = queries[here], root[here]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    no_bits = np.zeros(len(queries), np.int64)
    stack = [(len(levels) - 1, queries, root, np.zeros(len(queries), np.uint64), no_bits)]
    while stack:
        depth, q, node, seen, sum_ = stack.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            stack += [(depth, q[s], node[s], seen[s], sum_[s]) for s in (slice(half, None), slice(0, half))]
            continue
        level = levels[depth]
        fresh = level["mask"][node] & ~seen  # bits fixed here and not above
        sum_ = sum_ + np.bitwise_count((values[q] ^ level["value"][node]) & fresh)
        keep = (sum_ <= distance) & (level["end"][node] - 1 > leaf_of[q])
        q, node, sum_ = q[keep], node[keep], sum_[keep]
        if depth == 0:
            found.append((q, tree[node]))
        elif len(q):
            count, first = level["count"][node], level["first"][node]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            stack.append((
                depth - 1, np.repeat(q, count), np.repeat(first, count) + offset,
                np.repeat(level["mask"][node], count), np.repeat(sum_, count),
            ))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2


def components(edges: DataFrame) -> DataFrame:
    """`_fp` -> `_root`, the least member of its component, for every node with an edge to a lesser one.

    Large-star hangs a node's greater neighbours on the least neighbour, small-star the lesser ones; the edges end as
    stars. Each round is written to the shared folder. Minima combine before the shuffle and the joins' many side can
    be split, so a hub with most of the edges is no bottleneck.
    """
    edges, before = stage(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == before:
            return edges.select(F.col("src").alias("_fp"), F.col("dst").alias("_root"))
        before = state
        both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = stage(large.distinct(), "large-star")
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        hung = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        edges = stage(hung.unionAll(least.select("src", F.col("m").alias("dst"))).distinct(), "small-star")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, then the smallest text hash; null ids come last.

    The row keeps all its columns, whatever their names.
    """
    keyed, who = with_row_keys(docs, doc_id, text)
    found = near_duplicates(docs, doc_id, text)
    rank = F.struct(*[
        c.alias(name) for c, name in zip((F.col(doc_id).isNull(), F.col(doc_id), F.col("text_hash")), who, strict=True)
    ])
    kept = found.groupBy("root").agg(F.min(rank).alias("r")).select("r.*")
    kept = kept.withColumn(who[1], F.coalesce(who[1], F.lit(0)))
    # rows that repeat id and text: any one, they differ at most in columns beside
    return keyed.join(kept, who, "left_semi").dropDuplicates(who).select(*docs.columns)
