"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

Both encodings of a text are cut into groups where tokens of both end; every pair of tokens of one group is a link.
White space is such a cut, so groups and links are worked out once per distinct unit of the texts (`units.UnitStore`).

A block of documents becomes postings: for each pair of ids the documents that hold it, in planes by the binary digits
of how often they do. A plane is a compressed bitmap, a sorted array of 16-bit numbers or a bitset, whichever is
shorter. The planes of a pair together are its documents: merged by OR and counted they give its document count, and
weighted by the planes' values its link count. Blocks hold different documents, so sums over blocks are exact. The
counts then travel back along the postings: each block gets the score of each of its pairs and adds it up by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import stage
from tallymart.llm.units import Rows, TokenStore, UnitStore, ragged, release_memory, text_slices, token_bytes

#: A block has at most so many documents (numbers take 16 bits) and bytes of text, a longer text alone.
BLOCK_DOCS, BLOCK_BYTES = 1 << 15, 4 << 20
#: Units that a store keeps in a generation; one takes about 500 bytes.
MAX_UNITS = 100_000

INDEX = (
    "kind string, block long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, "
    "groups string, pair long, plane int, n_docs long, n_here long, block_docs int, docs binary"
)


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model: U+2581 is a space, <0xHH> is a byte."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
        else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.vocab_size())
    ]


def _taken(table: pa.Array, places: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The byte strings of a table at `places`, back to back, and their bounds."""
    out = table.take(pa.array(places))
    _, bounds, data = out.buffers()
    bounds = np.frombuffer(bounds, np.int64)[out.offset:out.offset + len(out) + 1]
    return (memoryview(data).cast("B")[bounds[0]:bounds[-1]] if data is not None else memoryview(b"")), bounds - bounds[0]


class AlignedUnits(UnitStore):
    """What two tokenizers make of units: numbers of tokens and groups, the groups as a string, and the linked pairs."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = TokenStore(path_a, special_as_text=True)
        self.a.max_units = self.max_units = MAX_UNITS
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces, tokens = piece_bytes(self.b), token_bytes(self.a.merges.tokenizer)
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (tokens, pieces))
        self.vocabulary_a, self.vocabulary_b = len(tokens), len(pieces)
        # a token in a list of groups: its number with what follows it
        self.listed = pa.array([
            f"{i}{mark}".encode() for n, marks in ((len(tokens), ",|"), (len(pieces), ",;")) for mark in marks for i in range(n)
        ], pa.large_binary())
        # units may start where no piece has the character behind another one: merges then never span the place
        long = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.white = bytes(
            c for c in b" \n"
            if not any(c in (p.lstrip(b" ") if c == 0x20 else p) for p in long)
        )
        self.marks = b""
        self.blank = self.b.piece_to_id("▁")
        super().__init__()

    def clear(self) -> None:
        #: of each slot: whether the bytes agree, tokens of each kind, groups
        self.numbers = np.zeros((0, 4), np.int64)
        self.strings = pa.array([], pa.large_binary())
        self.pairs, self.times = Rows(np.int64), Rows(np.int64)

    def aged(self) -> UnitStore:
        old = UnitStore()
        old.slots, old.numbers, old.strings, old.pairs, old.times = (
            self.slots, self.numbers, self.strings, self.pairs, self.times
        )
        return old

    def carry(self, slots: np.ndarray) -> None:
        old = self.older
        self.numbers = np.concatenate([self.numbers, old.numbers[slots]])
        self.strings = pa.concat_arrays([self.strings, old.strings.take(pa.array(slots))])
        self.pairs.add(old.pairs.size[slots], old.pairs.of(slots))
        self.times.add(old.times.size[slots], old.times.of(slots))

    def _encode_b(self, units: list[str]) -> list[list[int]]:
        """Pieces of units; the model puts a space before each text, so a unit's own first space is left out."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [
            [self.blank] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)
        ]

    def forget(self) -> None:
        super().forget()
        self.a.forget()

    def learn(self, units: list[str]) -> None:
        found = list(self.a.encode(pa.array(units, pa.string())))
        ids_a = np.concatenate([i for i, _ in found])
        sizes_a = np.concatenate([np.diff(b) for _, b in found])
        lists_b = self._encode_b(units)
        sizes_b = np.array([len(i) for i in lists_b])
        ids_b = np.fromiter(chain.from_iterable(lists_b), np.int64, int(sizes_b.sum()))
        unit_a, unit_b = (np.repeat(np.arange(len(units)), s) for s in (sizes_a, sizes_b))
        good = self._agree(units, ids_a, sizes_a, ids_b, sizes_b)
        if not good.all():
            keep_a, keep_b = good[unit_a], good[unit_b]
            ids_a, unit_a, ids_b, unit_b = ids_a[keep_a], unit_a[keep_a], ids_b[keep_b], unit_b[keep_b]
        ids_a = ids_a.astype(np.int64)
        ends_a = np.cumsum(self._lengths(self.bytes_a, ids_a))
        ends_b = np.cumsum(self._lengths(self.bytes_b, ids_b))
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        unit_of = np.zeros(len(both), np.int64)
        unit_of[group_a] = unit_a
        n_groups = np.bincount(unit_of, minlength=len(units)) if len(both) else np.zeros(len(units), np.int64)
        counts_a = np.bincount(unit_a, minlength=len(units))
        counts_b = np.bincount(unit_b, minlength=len(units))
        self.numbers = np.concatenate([self.numbers, np.stack([good, counts_a, counts_b, n_groups], 1).astype(np.int64)])
        self.strings = pa.concat_arrays([
            self.strings, self._strings(ids_a, group_a, ids_b, group_b, np.cumsum(counts_a + counts_b))
        ])
        self._link(len(units), len(both), unit_of, ids_a, group_a, ids_b, group_b)

    @staticmethod
    def _lengths(table: pa.Array, ids: np.ndarray) -> np.ndarray:
        return pa.compute.binary_length(table).to_numpy(zero_copy_only=False)[ids]

    def _agree(self, units, ids_a, sizes_a, ids_b, sizes_b) -> np.ndarray:
        """Whether both encodings of each unit spell it."""
        encoded = [u.encode() for u in units]
        whole, bounds = b"".join(encoded), np.cumsum([0, *map(len, encoded)])
        good = np.ones(len(units), bool)
        for table, ids, sizes in ((self.bytes_a, ids_a, sizes_a), (self.bytes_b, ids_b, sizes_b)):
            spelled, ends = _taken(table, ids)
            ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
            if spelled == whole and (ends == bounds).all():
                continue
            good &= [spelled[x:y] == u for u, x, y in zip(encoded, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return good

    def _strings(self, ids_a, group_a, ids_b, group_b, unit_ends) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3;` of each unit, whose tokens of both kinds end at `unit_ends`."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (group_a, group_b))
        words = np.zeros(len(ids_a) + len(ids_b), np.int64)
        # a token's place: after those of its kind before it, and the other kind's of groups before (or up to) its own
        words[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + last_a * self.vocabulary_a
        words[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = (
            2 * self.vocabulary_a + ids_b + last_b * self.vocabulary_b
        )
        text, bounds = _taken(self.listed, words)
        bounds = bounds[np.concatenate([[0], unit_ends])]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(unit_ends), [None, pa.py_buffer(bounds), pa.py_buffer(bytes(text))]
        )

    def _link(self, n_units, n, unit_of, ids_a, group_a, ids_b, group_b) -> None:
        """Linked pairs of each unit and how often: within a group, times of the one id times those of the other."""
        sides = []
        for ids, group in ((ids_a, group_a), (ids_b, group_b)):
            key, times = np.unique(group * (1 << 32) + ids, return_counts=True)
            sides.append((key >> 32, key & 0xFFFFFFFF, times))
        (ga, a, ta), (gb, b, tb) = sides
        first, size = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right") - np.searchsorted(gb, ga)
        left, right = np.repeat(np.arange(len(a)), size), ragged(first, size)
        pair = a[left] * self.vocabulary_b + b[right]
        unit = unit_of[ga[left]]
        order = np.lexsort((pair, unit))
        unit, pair, times = unit[order], pair[order], (ta[left] * tb[right])[order]
        new = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])])) if len(unit) else order
        sizes = np.bincount(unit[new], minlength=n_units) if len(new) else np.zeros(n_units, np.int64)
        self.pairs.add(sizes, pair[new])
        self.times.add(sizes, np.add.reduceat(times, new) if len(new) else times)


_ALIGNED: dict[tuple[str, str], AlignedUnits] = {}


def aligned_units(path_a: str, path_b: str) -> AlignedUnits:
    """The worker's store for two vocabularies; loaded once."""
    if (path_a, path_b) not in _ALIGNED:
        _ALIGNED[path_a, path_b] = AlignedUnits(path_a, path_b)
    return _ALIGNED[path_a, path_b]


def bitmaps(numbers: np.ndarray, sizes: np.ndarray, block_docs: int) -> list[tuple[np.ndarray, pa.Array]]:
    """Compressed bitmaps of runs of sorted document numbers: (which runs, bitmaps), arrays first, then bitsets.

    A bitset of the block takes `ceil(block_docs / 8)` bytes; runs whose array would not be shorter become one.
    """
    width = -(-block_docs // 8)
    first, dense = np.cumsum(sizes) - sizes, 2 * sizes >= width
    out = []
    at = np.flatnonzero(~dense)
    if len(at):
        data = numbers[ragged(first[at], sizes[at])].astype("<u2")
        bounds = np.concatenate([[0], np.cumsum(2 * sizes[at])]).astype(np.int64)
        out.append((at, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])))
    at = np.flatnonzero(dense)
    for some in (at[i:i + 512] for i in range(0, len(at), 512)):
        bits = np.zeros((len(some), 8 * width), bool)
        bits[np.repeat(np.arange(len(some)), sizes[some]), numbers[ragged(first[some], sizes[some])]] = True
        bounds = np.arange(len(some) + 1, dtype=np.int64) * width
        packed = np.packbits(bits, axis=1, bitorder="little")
        out.append((some, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])))
    return out


def add_scores(docs: list[bytes], scores: np.ndarray, block_docs: int) -> np.ndarray:
    """For each document of the block the sum of the scores (a column each) of the bitmaps that hold it."""
    width = -(-block_docs // 8)
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros((block_docs, scores.shape[1]), np.int64)
    at = np.flatnonzero(sizes < width)
    numbers = np.frombuffer(b"".join([docs[i] for i in at]), "<u2")
    for k in range(scores.shape[1]):
        np.add.at(out[:, k], numbers, np.repeat(scores[at, k], sizes[at] // 2))
    at = np.flatnonzero(sizes >= width)
    for some in (at[i:i + 512] for i in range(0, len(at), 512)):
        packed = np.frombuffer(b"".join([docs[i] for i in some]), np.uint8).reshape(len(some), width)
        bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :block_docs]
        for k in range(scores.shape[1]):
            out[:, k] += scores[some, k] @ bits
    return out


def _block_rows(units: AlignedUnits, ids: pa.Array, data: np.ndarray, bounds: np.ndarray, block: int, with_groups: bool) -> Iterator[dict]:
    """Columns of the rows of one block: its documents, then its postings."""
    slots, first = units.look_up(data, bounds)
    n = len(bounds) - 1
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n), sizes)
    numbers = units.numbers[slots]
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(numbers, axis=0)])
    per_doc = sums[first[1:]] - sums[first[:-1]]
    good = per_doc[:, 0] == sizes  # no unit of which the bytes differ
    kept = good[doc]
    doc, slots = doc[kept], slots[kept]
    per_doc[~good] = 0
    listed, places = _taken(units.strings, slots)
    places = places[np.searchsorted(doc, np.arange(n + 1))].tolist()
    texts = [listed[x:y - 1] if y > x else b"" for x, y in zip(places[:-1], places[1:], strict=True)]
    # units of a document, then their pairs, then pairs of a document
    key, often = np.unique(doc * len(units.slots) + slots, return_counts=True)
    doc, slots = np.divmod(key, max(len(units.slots), 1))
    size = units.pairs.size[slots]
    pair, times = units.pairs.of(slots), units.times.of(slots) * np.repeat(often, size)
    key = pair * BLOCK_DOCS + np.repeat(doc, size)
    order = np.argsort(key)
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    times = np.add.reduceat(times, new) if len(new) else times
    pair, doc = np.divmod(key[new], BLOCK_DOCS)
    links = np.zeros(n, np.int64)
    np.add.at(links, doc, times)
    yield {
        "kind": np.repeat("document", n), "block": np.full(n, block), "doc": np.arange(n, dtype=np.int32), "doc_id": ids,
        "n_a": per_doc[:, 1], "n_b": per_doc[:, 2], "n_groups": per_doc[:, 3], "n_links": links,
        "digest": pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
        "groups": pa.array([bytes(t).decode() if with_groups else None for t in texts], pa.string()),
    }
    if not len(pair):
        return
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    union = np.diff(np.append(starts, len(pair)))  # documents in any plane of the pair
    number = np.repeat(np.arange(len(starts)), union)
    fresh = np.ones(len(starts), bool)  # whose document count no plane has brought yet
    for plane in range(int(times.max()).bit_length()):
        at = np.flatnonzero(times >> plane & 1)
        owner = number[at]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(at) else at
        here = np.diff(np.append(begins, len(at)))
        for which, packed in bitmaps(doc[at], here, n):
            runs = owner[begins[which]]
            yield {
                "kind": np.repeat("posting", len(runs)), "block": np.full(len(runs), block), "pair": pair[starts[runs]],
                "plane": np.full(len(runs), plane, np.int32), "n_docs": np.where(fresh[runs], union[runs], 0),
                "n_here": here[which], "block_docs": np.full(len(runs), n, np.int32), "docs": packed.cast(pa.binary()),
            }
            fresh[runs] = False


def index(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False,
) -> DataFrame:
    """The written index over `docs`: rows of kind `document` and `posting` (see `INDEX`).

    Null and empty texts, and texts that one of the tokenizers does not spell as a space and the text, have a document
    row without tokens. Repeated rows and null ids each have a document row. Other columns are ignored.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, block = aligned_units(path_a, path_b), TaskContext.get().partitionId() << 32
        schema = pa.schema([
            (f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]])
            for f in INDEX.split(", ")
        ])
        for batch in batches:
            done = 0
            for data, bounds in text_slices(batch.column(1), BLOCK_BYTES, BLOCK_DOCS):
                ids = batch.column(0).slice(done, len(bounds) - 1)
                for columns in _block_rows(units, ids, data, bounds, block, with_groups):
                    n = len(columns["kind"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                        schema=schema,
                    )
                block, done = block + 1, done + len(bounds) - 1
                release_memory()
        # the worker lives on beside the next stages' sorts
        units.forget()
        release_memory()

    # an empty text stays empty: it has no tokens
    spaced = F.when(F.octet_length(text) > 0, F.concat(F.lit(" "), F.col(text)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), spaced.alias("text"))
    return stage(rows.mapInArrow(build, INDEX), "alignment-index", by="kind")


def pair_counts(indexed: DataFrame, vocabulary_b: int) -> DataFrame:
    """One row per linked pair: `a`, `b`, `n_docs` (documents with a link), `n_links`, `best` (most documents of its a)."""
    counted = indexed.where("kind = 'posting'").groupBy("pair").agg(
        F.sum("n_docs").alias("n_docs"), F.sum(F.expr("n_here * CAST(power(2, plane) AS BIGINT)")).alias("n_links")
    )
    counted = stage(counted.select(F.expr(f"pair div {vocabulary_b}").alias("a"), F.expr(f"pair % {vocabulary_b}").alias("b"), "n_docs", "n_links"), "pair-counts")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counted.join(most, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("_most")).alias("best"))


def align(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `digest`, `groups`.

    A is a byte-level vocabulary of the tokenizers library and encodes a space and the text; B is a sentencepiece model
    and puts that space itself. `n_best` counts the links whose pair has the highest document count of its A id,
    `count_sum` adds up the links' document counts. `groups` lists the groups, if asked for; `digest` is its SHA-256,
    and '' for texts without tokens: null or empty ones, and those that the tokens of A or B do not spell exactly.
    An empty table gives no rows.
    """
    indexed = index(docs, path_a, path_b, doc_id, text, with_groups)
    vocabulary_b = aligned_units(path_a, path_b).vocabulary_b
    scores = pair_counts(indexed, vocabulary_b).select(
        (F.col("a") * vocabulary_b + F.col("b")).alias("pair"), F.col("n_docs").alias("score"), F.col("best").cast("long").alias("best")
    )
    postings = indexed.where("kind = 'posting'").select("block", "pair", "plane", "block_docs", "docs")
    # an own name for the block, since both sides of the last step come from one table
    scored = postings.join(scores, "pair").select(
        F.col("block").alias("of_block"), "block_docs", "docs", *[F.expr(f"{c} * CAST(power(2, plane) AS BIGINT)").alias(c) for c in ("best", "score")]
    )
    listed = indexed.where("kind = 'document'").select(
        "block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups"
    )

    def add_up(rows: pa.Table, marks: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc")
        sums = np.zeros((rows.num_rows, 2), np.int64)
        if marks.num_rows:
            weights = np.stack([marks.column(c).to_numpy() for c in ("best", "score")], 1)
            sums = add_scores(marks.column("docs").to_pylist(), weights, marks.column("block_docs")[0].as_py())
        return pa.table({
            **{c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1]),
            "digest": rows.column("digest"), "groups": rows.column("groups"),
        })

    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "digest string, groups string")
    done = listed.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(add_up, schema)
    return (done if with_groups else done.drop("groups")).withColumnRenamed("doc_id", doc_id)
