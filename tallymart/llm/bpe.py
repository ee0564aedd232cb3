"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes meets a condition, so equal passages are cut alike in every
document. A worker encodes each chunk that it meets once and keeps the ids from the first place in it where a token
starts whatever stands before to the last place where one starts whatever follows; both are starts of units (see
`units`). Neighbouring chunks are then joined: the text from the last such place of the left chunk to the first of the
right one is encoded by itself, as are the ends of a text and chunks without such places.

Reuse is within a worker. Sharing chunks between workers needs an exchange of chunk texts and ids that is larger than
the texts themselves (figures in the README).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.units import Rows, TokenStore, UnitStore, ragged, text_slices

#: Mean bytes of a chunk (a power of two), the least, and the rolling hash's window.
MEAN_CHUNK, LEAST_CHUNK, ROLL = 512, 64, 16
#: A generation of a worker's stores ends at so many units or chunks; a chunk of more bytes is cut.
MAX_WORDS, MAX_CHUNKS, LONGEST_KEPT = 250_000, 4_000, 8_192
#: Texts are worked on in slices of about so many bytes, ids in slices of so many.
SLICE_BYTES, SLICE_IDS = 4 << 20, 1 << 20

#: Characters whose normal form, case and class all Unicode versions agree on; the tests go through them one by one.
SAFE_END, ALSO_SAFE = 0x250, "‐‑‒–—―‘’‚‛“”„†‡•…"
UNSURE = "İŉ"


def _safe_alphabet() -> str:
    plain = "\t\n\r" + "".join(map(chr, range(0x20, 0x7F))) + "".join(map(chr, range(0xA1, SAFE_END)))
    every = {c for c in plain + ALSO_SAFE if c not in UNSURE}
    return "".join(sorted(c for c in every if c.lower() in every))


SAFE = _safe_alphabet()


class ChunkStore(UnitStore):
    """Of each chunk the ids of its units but the first and last one, and how many bytes before and up to their end."""

    def __init__(self, units: TokenStore):
        self.units, self.learned = units, 0
        super().__init__()

    def clear(self) -> None:
        self.rows, self.inner = Rows(), np.zeros((0, 2), np.int64)

    def aged(self) -> UnitStore:
        old = UnitStore()
        old.slots, old.rows, old.inner = self.slots, self.rows, self.inner
        return old

    def carry(self, slots: np.ndarray) -> None:
        self.rows.add(self.older.rows.size[slots], self.older.rows.of(slots))
        self.inner = np.concatenate([self.inner, self.older.inner[slots]])

    def learn(self, units: list[str]) -> None:
        self.learned += len(units)
        chunks = [u.encode() for u in units]
        data = np.frombuffer(b"".join(chunks), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        starts = self.units.cut(data, bounds)
        first = np.searchsorted(starts, bounds)
        # the begin of a chunk may be no start in its text, and its last unit may go on behind it
        many = np.maximum(np.diff(first) - 2, 0)
        some = many > 0
        left, right = starts[first[:-1][some] + 1], starts[first[1:][some] - 1]
        shift = left - np.concatenate([[0], np.cumsum(right - left)])[:-1]
        inner = starts[ragged(first[:-1] + 1, many)] - np.repeat(shift, many[some])
        slots = self.units.find(runs_of(data, left, right), inner)
        ends = np.concatenate([[0], np.cumsum(self.units.rows.size[slots])])[np.concatenate([[0], np.cumsum(many)])]
        self.rows.add(np.diff(ends), self.units.rows.of(slots))
        places = np.zeros((len(chunks), 2), np.int64)
        places[some] = np.stack([left, right], 1) - bounds[:-1][some, None]
        self.inner = np.concatenate([self.inner, places])


class Encoder:
    """Encodes as the library does, without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        self.units = TokenStore(path)
        self.units.max_units = MAX_WORDS
        self.chunks = ChunkStore(self.units)
        self.chunks.max_units = MAX_CHUNKS
        self.tokenizer, self.vocabulary = self.units.merges.tokenizer, self.units.vocabulary
        self.counts = Counter()

    @cached_property
    def strings(self) -> pa.Array:
        """The string of each id."""
        return pa.array([self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary)], pa.string())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return [
            ids[a:b].astype("<i4").tobytes() for ids, ends in self.slices(pa.array(texts, pa.large_string()))
            for a, b in zip(ends[:-1], ends[1:], strict=True)
        ]

    def slices(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds of texts in them) of consecutive runs of the column's texts; null texts are empty."""
        for data, bounds in text_slices(column, SLICE_BYTES):
            yield self._slice(data, bounds, cut_points(data, bounds))

    def _joined(self, text: str, cuts: list[int]) -> bytes:
        """Ids of one text that is cut behind the given numbers of characters."""
        data = np.frombuffer(text.encode(), np.uint8)
        begins = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[[0, *cuts[:-1]]]
        return self._slice(data, np.array([0, len(data)]), begins)[0].astype("<i4").tobytes()

    def _slice(self, data: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between `bounds` and their bounds in these, from chunks that begin at `begins`."""
        slots = self.chunks.find(data, begins)
        self.counts["chunks"] += len(begins)
        self.counts["reused"] = self.counts["chunks"] - self.chunks.learned
        places = self.chunks.inner[slots]
        some = places[:, 1] > 0
        slots, places = slots[some], places[some] + begins[some, None]
        # each text is a join, then by turns a chunk and a join
        texts, n = np.searchsorted(bounds, places[:, 0], "right") - 1, len(bounds) - 1
        opening = np.arange(n) + np.searchsorted(texts, np.arange(n))
        behind = texts + np.arange(len(texts)) + 1
        left, right = np.empty(n + len(texts), np.int64), np.empty(n + len(texts), np.int64)
        left[opening], left[behind] = bounds[:-1], places[:, 1]
        right[np.append(opening[1:], n + len(texts)) - 1], right[behind - 1] = bounds[1:], places[:, 0]
        sizes = right - left
        units, first = self.units.look_up(runs_of(data, left, right), np.concatenate([[0], np.cumsum(sizes)]))
        joins = np.concatenate([[0], np.cumsum(self.units.rows.size[units])])[first]
        kept = np.concatenate([[0], np.cumsum(self.chunks.rows.size[slots])]) + joins[-1]
        turn = np.zeros(n + 2 * len(texts), bool)
        turn[texts + 2 * np.arange(len(texts)) + 1] = True
        begin, size = np.empty(len(turn), np.int64), np.empty(len(turn), np.int64)
        begin[turn], size[turn], begin[~turn], size[~turn] = kept[:-1], np.diff(kept), joins[:-1], np.diff(joins)
        ids = np.concatenate([self.units.rows.of(units), self.chunks.rows.of(slots)])[ragged(begin, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.append(opening + np.searchsorted(texts, np.arange(n)), len(turn))]


def cut_points(data: np.ndarray, bounds: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Where the chunks of the texts between `bounds` begin; always at the begin of a character."""
    # a polynomial over the last ROLL bytes, doubled from spans of 1, 2, 4, ...
    roll, span, base = data.astype(np.uint32) * np.uint32(2654435761), 1, 0x01000193
    while span < ROLL:
        longer = roll.copy()
        longer[span:] += roll[:-span] * np.uint32(base)
        roll, span, base = longer, span * 2, base * base % (1 << 32)
    hits = np.flatnonzero((roll >> np.uint32(7)) & np.uint32(mean - 1) == 0) + 1
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if begin == end:
            continue
        out.append(begin)
        lo, hi = np.searchsorted(hits, (begin + 1, end))
        for cut in [*hits[lo:hi].tolist(), end]:
            while cut - out[-1] > LONGEST_KEPT:
                out.append(_character(data, out[-1] + LONGEST_KEPT))
            # a cut depends on ROLL bytes of its own text
            if cut < end and cut - out[-1] >= LEAST_CHUNK and _character(data, cut) == cut:
                out.append(cut)
    return np.array(out, np.int64)


def runs_of(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bytes of runs that lie in order and do not overlap."""
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, left, 1)
    np.add.at(edges, right, -1)
    return data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]


def _character(data: np.ndarray, place: int) -> int:
    """The begin of the character that the byte at `place` belongs to."""
    while data[place] & 0xC0 == 0x80:
        place -= 1
    return place


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the token ids of `text` in `out` (array of int).

    Null and empty texts have no ids. Every row stays, with all its columns; a column named as `out` is replaced.
    """

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for ids, ends in encoder(path).slices(column):
            parts.append(ids)
            sizes.append(np.diff(ends))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(parts)))

    return docs.withColumn(out, ids_of(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of `ids`, special tokens included, as the library's decode gives it.

    Without a decoder in the vocabulary file that is the tokens' strings, joined by a space. Null ids give null.
    """

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        make = encoder(path)
        if make.tokenizer.decoder is not None:
            texts = make.tokenizer.decode_batch([x or [] for x in column.to_pylist()], skip_special_tokens=False)
        else:
            known = column.fill_null([])
            values, ends = known.values, known.offsets.to_numpy().astype(np.int64)
            texts, a = [pa.array([], pa.string())], 0
            while a < len(known):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_IDS, "right")) - 1)
                tokens = make.strings.take(values.slice(ends[a], ends[b] - ends[a]))
                lists = pa.ListArray.from_arrays(pa.array(ends[a:b + 1] - ends[a], pa.int32()), tokens)
                texts.append(pc.binary_join(lists, " "))
                a = b
            return pa.concat_arrays(texts)
        return pa.array(texts, pa.string())

    return docs.withColumn(out, F.when(F.col(ids).isNotNull(), text_of(F.col(ids))))
