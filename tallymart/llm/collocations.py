"""Phrase collocations per language, mined by dynamic itemset counting.

The corpus lies in shards that are scanned in a cycle, one per step. Words are counted from the first step on. A longer
phrase becomes active in the step after both its subphrases (without its last and without its first word) have reached
the threshold, wherever the cycle then stands, and is counted for one full cycle; so lengths are counted side by side
instead of one scan of the corpus per length. The last scan ends when every active phrase has completed its cycle.
Texts are cut into words once: a shard holds slices, each with its distinct words and the number of each occurrence.

The counters are cells of a sketch of fixed size: a phrase's cell is a hash of its words and counts at least what the
phrase does. Tasks add up in arrays and send saturated counts of the cells they touched; the driver keeps one byte of
count and one of the step at which the threshold was reached for each cell, never phrases. Cells only grow, so when a
phrase becomes active is the same in every task, and every phrase that occurs often enough ends in a cell that has
reached the threshold. Those phrases, and the few others that share their cells, are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.common import stage
from tallymart.llm.units import text_slices

LONGEST, LEAST, TOP, SHARDS, COVERED = 3, 10, 2000, 4, 50
#: The sketch has 2 ** CELL_BITS cells, half of them for the longest phrases; its 2 ** PARTS parts travel as one row each.
CELL_BITS, PARTS = 26, 6
#: Partial counts of phrases travel in 2 ** KEY_PARTS parts by a hash of their keys.
KEY_PARTS = 10
#: At most 2 ** NUMBER_BITS of the most frequent words are broadcast, 8 bytes each.
NUMBER_BITS = 20
NEVER = 255
#: Bytes of text in a slice, and keys that a task collects before it counts equal ones.
SLICE, HELD = 2 << 20, 1 << 21
#: Partitions in which the driver takes the sums of a step, one after the other.
TURNS = 4
CODED = pa.schema([
    ("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("lang", pa.binary()), ("own", pa.binary()),
    ("times", pa.binary()), ("words", pa.string()), ("numbers", pa.binary()), ("starts", pa.binary()),
])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: `ids` of each occurrence, whether a piece starts there, and the distinct words behind the ids."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, langs: list[str], seed: int):
        inside = ~(_BREAK | _GAP)[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][np.diff(bounds) > 0]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        offsets = np.append((np.cumsum(inside) - inside)[at], inside.sum()).astype(np.int64)
        letters = _LOWER[data[inside]]
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        ).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(bounds, at, "right") - 1
        names, lang_of = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else ([], word)
        # distinct (language, word)
        width = len(coded.dictionary) + 1
        key = lang_of[doc] * width + word
        if len(names) * width <= 8 * len(key):
            distinct = np.flatnonzero(np.bincount(key))
            place = np.zeros(len(names) * width, np.int64)
            place[distinct] = np.arange(len(distinct))
            self.index = place[key]
        else:
            distinct, self.index = np.unique(key, return_inverse=True)
        self.lang, self.word = np.divmod(distinct, width)
        self.langs, self.strings = [str(n) for n in names], coded.dictionary
        hashed = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
        salted = np.array([xxhash.xxh3_64_intdigest(n.encode(), seed + 1) for n in self.langs], np.uint64)
        own = _mix(hashed[self.word] + salted[self.lang] * np.uint64(0x9E3779B97F4A7C15)) if len(distinct) else np.zeros(0, np.uint64)
        self.own = np.where(own == 0, np.uint64(1), own)  # 0 stands for no word
        self.ids = self.own[self.index]
        gaps = np.cumsum(_BREAK[data])[at] if len(at) else at
        self.starts = np.ones(len(at), bool)
        self.starts[1:] = (gaps[1:] != gaps[:-1]) | (doc[1:] != doc[:-1])

    def coded(self, shard: int) -> list:
        """A row of CODED; frequent words have low numbers, which take less space."""
        times = np.bincount(self.index, minlength=len(self.own))
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        strings = self.strings.take(pa.array(self.word[order])).to_pylist()
        return [
            shard, self.langs, _squeeze(self.lang[order]), self.own[order].tobytes(), _squeeze(times[order]),
            b" ".join(strings).decode(), _squeeze(number[self.index]), np.packbits(self.starts).tobytes(),
        ]


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte of their width."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _expand(squeezed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(squeezed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def coded_slices(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """The texts of `docs` (columns text and lang) as rows of CODED, dealt over the shards."""
    schema = "shard int, langs array<string>, lang binary, own binary, times binary, words string, numbers binary, starts binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for batch in batches:
            langs, done = batch.column(1).to_pylist(), 0
            for data, bounds in text_slices(batch.column(0), SLICE):
                n = len(bounds) - 1
                row = Words(data, bounds, langs[done:done + n], seed).coded(shard % shards)
                yield pa.RecordBatch.from_pylist([dict(zip(CODED.names, row, strict=True))], CODED)
                done, shard = done + n, shard + 1

    return stage(docs.select("text", "lang").mapInArrow(code, schema), "shards", by="shard")


def _cells(hashed: np.ndarray, cell_bits: int) -> np.ndarray:
    return (_mix(hashed) >> np.uint64(64 - cell_bits + 1)).astype(np.int32)


class Slice:
    """A coded slice: `own` ids of its distinct words, `ids` of all occurrences, `starts` of pieces."""

    def __init__(self, own: bytes, numbers: bytes, starts: bytes):
        self.own, self.index = np.frombuffer(own, np.uint64), _expand(numbers)
        self.ids = self.own[self.index]
        self.starts = np.unpackbits(np.frombuffer(starts, np.uint8), count=len(self.ids)).astype(bool)

    def phrases(self, levels: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places, cells, step at which the last part was reached) of phrases whose shorter parts all were.

        Two words come first. The longest phrases have cells of their own.
        """
        cell_bits = levels.size.bit_length() - 1
        reached = levels[_cells(self.own, cell_bits)][self.index]
        at, hashed = np.flatnonzero(reached != NEVER), self.ids
        reached, hashed = reached[at], hashed[at]
        for length in range(2, longest + 1):
            both = at[1:] == at[:-1] + 1
            if length == 2:
                both &= ~self.starts[at[1:]]
            left = np.flatnonzero(both)
            since = np.maximum(reached[left], reached[left + 1])
            at = at[left]
            hashed = _mix(hashed[left] * np.uint64(0xD6E8FEB86659FD93) + self.ids[at + length - 1])
            cell = _cells(hashed, cell_bits)
            if length == longest:
                cell |= np.int32(1 << (cell_bits - 1))
            yield length, at, cell, since
            if length < longest:
                reached = np.maximum(levels[cell], since)
                known = np.flatnonzero(reached != NEVER)
                at, hashed, reached = at[known], hashed[known], reached[known]


def _slices(batch: pa.RecordBatch) -> Iterator[Slice]:
    """Slices of a batch with columns own, numbers and starts."""
    for own, numbers, starts in zip(*batch.columns, strict=True):
        yield Slice(own.as_py(), numbers.as_py(), starts.as_py())


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.concatenate([steps.ravel(), counts.astype(np.uint8)]).tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(raw[:4].T).view("<u4").ravel().astype(np.int64)), raw[4]


_LEVELS: dict[int, tuple[int, np.ndarray]] = {}


def _levels(shared) -> np.ndarray:
    """The broadcast levels, unpacked once per worker and step."""
    if _LEVELS.get(0, (None,))[0] != shared.id:
        levels = np.full(shared.size, NEVER, np.uint8)
        cells, steps = _unpack(shared.packed.value)
        levels[cells] = steps
        _LEVELS[0] = (shared.id, levels)
    return _LEVELS[0][1]


class _Shared:
    """A broadcast array with a name that workers can tell apart from the one before."""

    def __init__(self, spark, levels: np.ndarray, step: int):
        reached = np.flatnonzero(levels != NEVER)
        self.packed = spark.sparkContext.broadcast(_pack(reached, levels[reached]))
        self.size = len(levels)
        self.id = (spark.sparkContext.applicationId, self.packed._jbroadcast.id(), step)

    def __getstate__(self):
        return {"packed": self.packed, "size": self.size, "id": self.id}


def _scan(shard: DataFrame, shared: _Shared, step: int, shards: int, longest: int, least: int) -> DataFrame:
    """Saturated counts of the cells of phrases that are active in this step, by part of the sketch."""
    cell_bits = shared.size.bit_length() - 1
    part_bits = cell_bits - PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, counts = _levels(shared), np.zeros(shared.size, np.uint8)

        def more(cells: np.ndarray) -> None:
            cells, n = np.unique(cells, return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, least)

        for batch in batches:
            for words in _slices(batch):
                if step < shards:
                    more(np.repeat(_cells(words.own, cell_bits), np.minimum(np.bincount(words.index, minlength=len(words.own)), least)))
                for _, _, cell, since in words.phrases(levels, longest):
                    # from the step after all parts were reached, for one cycle
                    more(cell[(since < step) & (since.astype(np.int16) + shards >= step)])
        cells = np.flatnonzero(counts)
        for part in np.unique(cells >> part_bits).tolist():
            lo, hi = np.searchsorted(cells, (part << part_bits, (part + 1) << part_bits))
            packed = _pack(cells[lo:hi] - (part << part_bits), counts[cells[lo:hi]])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "packed"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << part_bits, np.uint8)
        for packed in rows.column("packed"):
            cells, n = _unpack(packed.as_py())
            total[cells] = np.minimum(total[cells].astype(np.int64) + n, least)
        cells = np.flatnonzero(total)
        return pa.table({"part": rows.column("part").slice(0, 1), "packed": pa.array([_pack(cells, total[cells])], pa.binary())})

    schema = "part int, packed binary"
    return shard.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).coalesce(1 << PARTS)


def reached_cells(texts: DataFrame, shards: int, longest: int, least: int, cell_bits: int = CELL_BITS) -> np.ndarray:
    """For each cell the step at which its count reached `least`, or NEVER. `texts` are coded slices."""
    spark = texts.sparkSession
    counts, levels = np.zeros(1 << cell_bits, np.uint8), np.full(1 << cell_bits, NEVER, np.uint8)
    step, last = 0, 0  # the last step at which a phrase that is part of longer ones reached the threshold
    while step < shards or (step <= last + shards and step < shards * longest):
        shared = _Shared(spark, levels, step)
        shard = texts.where(F.col("shard") == step % shards).select("own", "numbers", "starts")
        # an iterator runs a job for each partition, and does work above it again: sums are stored and come in few
        sums = stage(_scan(shard, shared, step, shards, longest, least), "cells")
        for row in sums.coalesce(TURNS).toLocalIterator():
            cells, n = _unpack(bytes(row["packed"]))
            cells += row["part"] << (cell_bits - PARTS)
            counts[cells] = total = np.minimum(counts[cells].astype(np.int64) + n, least)
            new = cells[(total >= least) & (levels[cells] == NEVER)]
            levels[new] = step
            if (new < 1 << (cell_bits - 1)).any():
                last = step
        shared.packed.unpersist()
        step += 1
    return levels


def count_words(texts: DataFrame, levels: np.ndarray, seed: int) -> DataFrame:
    """`size` 0: words of each `lang`; `size` 1: `k0`, `lang`, `word` and its count, for words whose cell was reached."""
    shared = _Shared(texts.sparkSession, levels, -1)
    types, names = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()), ["size", "k0", "lang", "word", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, n_held = _levels(shared), [], 0
        for batch in batches:
            for langs, lang, own, times, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, lang, times = np.frombuffer(own, np.int64), _expand(lang), _expand(times)
                totals = np.bincount(lang, weights=times, minlength=len(langs)).astype(np.int64)
                often = np.flatnonzero(levels[_cells(own.view(np.uint64), shared.size.bit_length() - 1)] != NEVER)
                strings = pa.array(words.split(" ") if words else [], pa.string()).take(pa.array(often))
                named = pa.array(langs, pa.string())
                for columns in (
                    [np.zeros(len(totals)), np.zeros(len(totals)), named, pa.nulls(len(totals)), totals],
                    [np.ones(len(often)), own[often], named.take(pa.array(lang[often])), strings, times[often]],
                ):
                    held.append(pa.table([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names))
                n_held += len(often)
                if n_held >= HELD:
                    yield from merged(held)
                    held, n_held = [], 0
        yield from merged(held)

    def merged(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            together = pa.concat_tables(held).group_by(names[:-1], use_threads=False).aggregate([("n", "sum")])
            yield from together.rename_columns(names).to_batches()

    counted = texts.select("langs", "lang", "own", "times", "words").mapInArrow(count, "size int, k0 long, lang string, word string, n long")
    return stage(counted.groupBy("size", "k0", "lang", "word").agg(F.sum("n").alias("n")), "words")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of `keys`, in order, and the sums of `n` over equal ones."""
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))[:len(keys)])
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _partial_rows(keys: np.ndarray, n: np.ndarray, part_bits: int, first_part: int = 0) -> pa.RecordBatch:
    """Counts of distinct, ordered keys (rows of 64-bit numbers) as one packed row for each of 2 ** part_bits parts."""
    hashed = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        hashed = _mix(hashed * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    part = (hashed >> np.uint64(64 - part_bits)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    keys, n = keys[order], n[order]
    sizes = np.bincount(part, minlength=1 << part_bits)
    ends, parts = np.cumsum(sizes), np.flatnonzero(sizes)
    packed = [_pack_counts(keys[b - m:b], n[b - m:b]) for b, m in zip(ends[parts].tolist(), sizes[parts].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array((parts + first_part).astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])


def _pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Keys, single ones as the steps between them, and counts below 2 ** 32, byte by byte of their width."""
    steps = np.diff(keys, axis=0, prepend=0) if keys.shape[1] == 1 else keys
    return b"".join(
        np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (steps.astype("<i8"), n.astype("<u4"))
    )


def _unpack_counts(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(packed, np.uint8).reshape(8 * width + 4, -1)
    keys = np.ascontiguousarray(raw[:8 * width].T).view("<i8")
    n = np.ascontiguousarray(raw[8 * width:].T).view("<u4").ravel().astype(np.int64)
    return (np.cumsum(keys, axis=0) if width == 1 else keys), n


def count_phrases(texts: DataFrame, words: DataFrame, levels: np.ndarray, longest: int, least: int) -> DataFrame:
    """Exact counts of `least` or more of phrases of two words or more: `size`, `k0`... (0 beyond `size`) and `n`.

    The most frequent words, at most 2 ** NUMBER_BITS, get numbers; that list has a fixed bound and is broadcast. A
    phrase of numbered words travels as one 64-bit key, any other as the ids of its words. Partial counts travel packed,
    a row for each task and part of the keys.
    """
    spark, keys = texts.sparkSession, [f"k{i}" for i in range(longest)]
    shared = _Shared(spark, levels, -2)
    bits, part_bits = min(NUMBER_BITS, 60 // longest), KEY_PARTS
    top = words.where((F.col("size") == 1) & (F.col("n") >= least)).groupBy("k0").agg(F.sum("n").alias("n"))
    top = top.orderBy(F.desc("n"), "k0").limit((1 << bits) - 1)
    numbered = np.sort(np.array([r["k0"] for r in top.select("k0").toLocalIterator()], np.int64))
    known = spark.sparkContext.broadcast(numbered)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, numbered = _levels(shared), known.value
        held, wide, n_held = [], [], 0
        for batch in batches:
            for words in _slices(batch):
                own = words.own.view(np.int64)
                place = np.searchsorted(numbered, own)
                place[place == len(numbered)] = 0
                number = np.where(numbered[place] == own, place + 1, 0) if len(numbered) else np.zeros(len(own), np.int64)
                number, ids = number[words.index], words.ids.view(np.int64)
                for length, at, cell, _ in words.phrases(levels, longest):
                    at = at[levels[cell] != NEVER]
                    parts = [number[at + i] for i in range(length)]
                    plain = np.logical_and.reduce([p > 0 for p in parts])
                    key = np.zeros(int(plain.sum()), np.int64)
                    for i in range(longest):
                        key = (key << bits) | (parts[i][plain] if i < length else 0)
                    held.append(key)
                    rare = at[~plain]
                    if len(rare):
                        ids_of = np.zeros((len(rare), longest), np.int64)
                        for i in range(length):
                            ids_of[:, i] = ids[rare + i]
                        wide.append(ids_of)
                    n_held += len(at)
                if n_held >= HELD:
                    yield from partial(held, wide)
                    held, wide, n_held = [], [], 0
        yield from partial(held, wide)

    def partial(held: list[np.ndarray], wide: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            yield _partial_rows(key.reshape(-1, 1), n, part_bits)
        if wide:
            key = np.concatenate(wide)
            yield _partial_rows(*_summed(key, np.ones(len(key), np.int64)), part_bits, 1 << part_bits)

    def add(rows: pa.Table) -> pa.Table:
        plain = rows.column("part")[0].as_py() < 1 << part_bits
        taken = [_unpack_counts(p.as_py(), 1 if plain else longest) for p in rows.column("packed")]
        key, n = _summed(np.concatenate([k for k, _ in taken]), np.concatenate([m for _, m in taken]))
        key, n = key[n >= least], n[n >= least]
        if plain:
            numbered = np.concatenate([[0], known.value])
            key = np.stack([numbered[key[:, 0] >> (bits * (longest - 1 - i)) & ((1 << bits) - 1)] for i in range(longest)], 1)
        size = (key != 0).sum(axis=1).astype(np.int32)
        return pa.table([pa.array(size), *[pa.array(key[:, i]) for i in range(longest)], pa.array(n)], ["size", *keys, "n"])

    counted = texts.select("own", "numbers", "starts").mapInArrow(count, "part int, packed binary")
    schema = ", ".join(["size int", *[f"{k} long" for k in keys], "n long"])
    return stage(counted.groupBy("part").applyInArrow(add, schema), "phrases", by="size")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(left) * wide(right))


def candidates(counted: DataFrame, words: DataFrame, longest: int, covered: int) -> DataFrame:
    """Phrases of two words or more with their weakest cut, those that a longer one covers left out."""
    keys = [f"k{i}" for i in range(longest)]
    of_size = {j: counted.where(F.col("size") == j).select(*keys[:j], F.col("n").alias("f")) for j in range(2, longest + 1)}
    words = words.where("size = 1").select("k0", "lang", "word", F.col("n").alias("f"))
    out = None
    for j in range(2, longest + 1):
        found = of_size[j].withColumnRenamed("f", "a")
        for i in range(j):
            named = words.select(F.col("k0").alias(keys[i]), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}_1"), *(["lang"] if i == 0 else []))
            found = found.join(named, keys[i])
        for i, size in [(0, s) for s in range(2, j)] + [(j - s, s) for s in range(2, j)]:
            part = of_size[size].select(*[F.col(keys[k]).alias(keys[i + k]) for k in range(size)], F.col("f").alias(f"f{i}_{size}"))
            found = found.join(part, keys[i:i + size])
        cuts = [(k, F.col(f"f0_{k}"), F.col(f"f{k}_{j - k}")) for k in range(1, j)]
        cut = F.array_min(F.array(*[
            F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
            for k, left, right in cuts
        ]))
        inside = [
            of_size[m].select(*[F.col(keys[o + i]).alias(keys[i]) for i in range(j)], F.col("f").alias("_longer"))
            for m in range(j + 1, longest + 1) for o in range(m - j + 1)
        ]
        if inside:
            every = inside[0]
            for more in inside[1:]:
                every = every.unionAll(more)
            most = every.groupBy(*keys[:j]).agg(F.max("_longer").alias("_longer"))
            found = found.join(most, keys[:j], "left").where(F.coalesce(F.col("_longer") * 100 < F.col("a") * covered, F.lit(True)))
        done = found.withColumn("_cut", cut).select(
            "lang", F.concat_ws(" ", *[f"word{i}" for i in range(j)]).alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score"
        )
        out = done if out is None else out.unionAll(done)
    return out


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
    covered: int = COVERED, shards: int = SHARDS, seed: int = 0, cell_bits: int = CELL_BITS,
) -> DataFrame:
    """The best phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    `a` counts the phrase, `l` and `r` the parts of its weakest cut, `n` the words of the language; the score is
    floor(1000000 a a / (l r)), exact. A phrase is left out where a longer candidate that holds it occurs at least
    `covered` percent as often. The order is by score and a, both falling, then by the bytes of the phrase. Null texts
    are empty, null languages are `und`; repeated rows count each; other columns are ignored; an empty table gives no
    rows. Word ids are 64-bit hashes; were two words to share one, everything is counted again under another seed.
    """
    if not 2 <= longest or longest * shards >= NEVER:
        raise ValueError("longest is 2 or more, and longest * shards below 255")
    known = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    texts = coded_slices(known, shards, seed)
    levels = reached_cells(texts, shards, longest, least, cell_bits)
    words = count_words(texts, levels, seed)
    if not words.where("size = 1").groupBy("k0").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
        return mine_phrases(docs, text, lang, longest, least, top, covered, shards, seed + 2, cell_bits)
    counted = count_phrases(texts, words, levels, longest, least)
    totals = words.where("size = 0").select("lang", "n")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(counted, words, longest, covered).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
