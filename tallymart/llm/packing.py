"""Packing of documents into sequences of bounded length by bounded-space best-fit.

Documents become pieces of at most `capacity` tokens: only longer ones are cut, into full pieces after a shorter first
one. Full pieces are sequences of their own. The others are dealt to packers of a bounded number of pieces, which take
them in the order of falling length. A packer holds a fixed number of open bins, found through a bitset over their free
space: a piece goes to the open bin with the least space that suffices. When one more bin than that would be open, the
fullest closes. So a packer's memory does not depend on how many pieces there are, and what it leaves unfilled is about
one sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallymart.llm.common import free_name, stage
from tallymart.llm.units import ragged, token_store

CAPACITY = 2048
#: Open bins of a packer, and pieces that it gets on average.
OPEN_BINS, PACKER_PIECES = 8192, 16_384


class Bins:
    """Open bins by their free space: a bitset of the spaces that occur, and the bins of each space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin that a piece goes to and its place there."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:  # the fullest has the least space
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space, self.made = self.made, self.capacity, self.made + 1
        left = space - length
        if left:
            self.by_space[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return bin_


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, place) of each piece in the order given."""
    bins = Bins(capacity, open_bins)
    return [bins.put(n) for n in lengths]


def cut_pieces(
    docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Token ids of `docs` as pieces of at most `capacity`: id, `piece`, `start`, `length` and `ids`.

    `ids` are little-endian unsigned 32-bit integers. Each document ends with `end_id`, also a null or empty one.
    Repeated rows and null ids each give pieces of their own. Other columns are ignored. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = token_store(path)
        for batch in batches:
            done = 0
            for ids, bounds in store.encode(batch.column(1)):
                n_docs = len(bounds) - 1
                sizes = np.diff(bounds) + 1
                tokens = np.insert(ids.astype("<u4"), bounds[1:], end_id)
                ends = np.cumsum(sizes)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(n_docs), pieces)
                piece = ragged(np.zeros(n_docs, np.int64), pieces)
                short = sizes - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                # pieces lie back to back in the order of their documents
                offsets = np.append((ends - sizes)[doc] + start, ends[-1]) * 4
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(tokens)]
                )
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc + done)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), body.cast(pa.binary()),
                ], ["doc_id", "piece", "start", "length", "ids"])
                done += n_docs

    who = F.col(doc_id).cast("long").alias("doc_id")
    cut_out = docs.select(who, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary"
    )
    return cut_out.withColumnRenamed("doc_id", doc_id)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", open_bins: int = OPEN_BINS,
    packer_pieces: int = PACKER_PIECES,
) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: which sequence each goes to and its place there, from 0 without gaps.

    All columns stay; columns named `sequence_id` or `offset` are replaced. Lengths lie between 1 and `capacity`, others
    raise an error in the task. Sequence ids are unique, not dense. An empty table gives no rows. Rows are numbered and
    written once, so equal rows are told apart and a task that runs again packs alike.
    """
    pieces = pieces.drop("sequence_id", "offset")
    key = free_name(pieces, "_key")
    kept = stage(pieces.withColumn(key, F.monotonically_increasing_id()), "pieces")
    full = kept.where(F.col(length) == capacity).select(
        *pieces.columns, (-1 - F.col(key)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = kept.where(F.coalesce(F.col(length), F.lit(0)) != capacity)
    packers = max(1, -(-rest.count() // packer_pieces))
    place = free_name(pieces, "_place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(length)).to_pylist()
            if any(n is None or not 0 < n <= capacity for n in lengths):
                raise ValueError(f"a piece has a length outside 1 to {capacity}")
            put = np.array([bins.put(n) for n in lengths], np.int64).reshape(-1, 2)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(put[:, 0] + base), pa.array(put[:, 1])], [*batch.schema.names, "sequence_id", place]
            )

    # one task is one packer; rows are dealt by a hash of their number, so no column can make one large
    dealt = rest.repartition(packers, F.xxhash64(key)).sortWithinPartitions(F.col(length).desc(), key)
    # an own name until the end: Spark compares names without case
    schema = StructType([*dealt.schema, StructField("sequence_id", LongType()), StructField(place, LongType())])
    packed = dealt.mapInArrow(work, schema).withColumnRenamed(place, "offset")
    return packed.select(*full.columns).unionAll(full)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """One row per sequence: `sequence_id`, `n_tokens`, `n_pieces` and `ids`, its pieces' ids back to back."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    whole = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), whole.alias("ids")
    ).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "n_pieces", "ids")
