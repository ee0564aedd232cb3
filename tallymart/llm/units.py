"""Encoding of whole texts by the distinct units that they consist of.

A unit starts at a white-space character whose predecessor is none, at punctuation after an ASCII letter or digit, or at
the begin of a text, and reaches to the next one. No token spans such a place and none looks beyond it, so the ids of a
text are those of its units in order; see `unit_starts`. Units repeat, in a text and between texts: a batch is cut with
array operations, its distinct units are looked up in the worker's store, and only unknown ones go to the tokenizers
library.
"""

from __future__ import annotations

import ctypes
import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes. A generation of a store ends at so many units or bytes of them.
SLICE_BYTES, MAX_UNITS, MAX_UNIT_BYTES = 8 << 20, 300_000, 16 << 20
WHITE, PUNCTUATION = b" \t\n\r", string.punctuation.encode()
#: Units that are one pre-token of letters whose case and normal form all libraries agree on.
PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _members(*bytes_: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(bytes_)] = True
    return table


#: ASCII characters that some library may take for white space; the last two bytes of longer white-space characters (and
#: of some others, which does no harm: a place is then no start).
_WHITE = _members(*range(0x09, 0x0E), *range(0x1C, 0x21))
_ALNUM = _members(*string.ascii_letters.encode(), *string.digits.encode())
_LAST, _BEFORE = _members(*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF), _members(0xC2, 0x80, 0x81, 0x9A)


def unit_starts(data: np.ndarray, text_starts: np.ndarray, white: bytes = WHITE, marks: bytes = b"") -> np.ndarray:
    """Places where units start: at `white` after no white space, at `marks` after [A-Za-z0-9], at begins of texts.

    A pre-token is a run of letters, of digits or of other characters, after at most one space, or white space; it looks
    ahead only behind white space. So one starts at each of these places in whatever text they stand, and the one before
    ends there.
    """
    begins = _members(*white)[data]
    blank = _WHITE[data]
    blank[1:] |= _LAST[data[1:]] & _BEFORE[data[:-1]]
    begins[1:] &= ~blank[:-1]
    if marks:
        begins[1:] |= _members(*marks)[data[1:]] & _ALNUM[data[:-1]]
    begins[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(begins)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text bounds in them) of runs of at most `most` texts and `limit` bytes, a longer text alone. Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset:column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1), a + most)
        yield bytes_[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        a = b


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of runs of the given sizes, one run after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(total)


def release_memory() -> None:
    """Give back what Arrow's pool and the C library keep of freed memory; a worker otherwise holds it to its end."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Rows:
    """Runs of integers back to back, with the place of each run; grows by whole lists."""

    def __init__(self, kind: type = np.int32):
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self._used = 0

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        sizes = np.asarray(sizes, np.int64)
        self.first = np.concatenate([self.first, self._used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        if self._used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self._used], np.zeros(self._used + 2 * len(values), self.flat.dtype)])
        self.flat[self._used:self._used + len(values)] = values
        self._used += len(values)

    def of(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.first[slots], self.size[slots])]


class UnitStore:
    """What a worker knows of the units that it has met, by slot, in two generations.

    When the younger one is full it becomes the older, from which units in use are carried over.
    """

    white, marks, max_units = WHITE, b"", MAX_UNITS

    def __init__(self):
        self.older: UnitStore | None = None
        self.slots: dict[str, int] = {}
        self.held_bytes = 0
        self.clear()

    def clear(self) -> None:
        """Empty what is kept for each slot."""

    def forget(self) -> None:
        """Drop all that is known of units."""
        self.older, self.slots, self.held_bytes = None, {}, 0
        self.clear()

    def aged(self) -> UnitStore:
        """A store with the present contents, to carry from."""
        raise NotImplementedError

    def carry(self, slots: np.ndarray) -> None:
        """Append what the older store has for `slots`."""
        raise NotImplementedError

    def learn(self, units: list[str]) -> None:
        """Append what is to be known of new units."""
        raise NotImplementedError

    def look_up(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the units of the texts between `bounds`, and for each text the place of its first unit (and an end).

        Slots hold until the next call.
        """
        starts = self.cut(data, bounds)
        return self.find(data, starts), np.searchsorted(starts, bounds)

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the units of the texts between `bounds` start."""
        return unit_starts(data, bounds[:-1][np.diff(bounds) > 0], self.white, self.marks)

    def find(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Slots of the units that start at `starts` and reach to the next one; they hold until the next call."""
        if len(self.slots) > self.max_units or self.held_bytes > MAX_UNIT_BYTES:
            self.older = self.aged()
            self.slots, self.held_bytes = {}, 0
            self.clear()
        offsets = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        unknown = [u for u in distinct if u not in self.slots]
        if unknown:
            known = self.older.slots if self.older else {}
            again = [u for u in unknown if u in known]
            if again:
                self.carry(np.array([known[u] for u in again], np.int64))
                self._number(again)
                unknown = [u for u in unknown if u not in known]
            if unknown:
                self.learn(unknown)
                self._number(unknown)
        slots = np.fromiter((self.slots[u] for u in distinct), np.int64, len(distinct))
        return slots[coded.indices.to_numpy()]

    def _number(self, units: list[str]) -> None:
        self.slots.update(zip(units, range(len(self.slots), len(self.slots) + len(units)), strict=True))
        self.held_bytes += sum(map(len, units))


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies: printable ones for themselves, the others in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(0x100)}


BYTE_LETTERS = _byte_letters()


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their own text."""
    byte_of = {letter: byte for byte, letter in BYTE_LETTERS.items()}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return [
        added[i] if i in added else bytes(byte_of[c] for c in tokenizer.id_to_token(i) or "")
        for i in range(tokenizer.get_vocab_size(with_added_tokens=True))
    ]


class Merges:
    """Token ids of units by the tokenizers library: plain ones by its merge model, the others by all its steps."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a vocabulary without a normaliser keeps case and the space before a word; the other kind drops both
        self.bare = self.tokenizer.normalizer is not None
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, units: list[str]) -> list[list[int]]:
        tokenize, out = self.tokenizer.model.tokenize, []
        for unit in units:
            if not PLAIN(unit):
                out.append(None)
                continue
            word = unit.strip(" ").lower() if self.bare else unit
            letters = word.replace(" ", BYTE_LETTERS[32]) if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            out.append([t.id for t in tokenize(letters)])
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class TokenStore(UnitStore):
    """Token ids of units; no special tokens are added."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.merges = Merges(path, special_as_text)
        self.vocabulary = self.merges.vocabulary
        # a special token's own string must stay in one unit
        within = "".join(self.merges.special).encode()
        self.white, self.marks = (bytes(c for c in kind if c not in within) for kind in (WHITE, PUNCTUATION))
        super().__init__()

    def clear(self) -> None:
        self.rows = Rows()

    def aged(self) -> UnitStore:
        old = UnitStore()
        old.slots, old.rows = self.slots, self.rows
        return old

    def carry(self, slots: np.ndarray) -> None:
        self.rows.add(self.older.rows.size[slots], self.older.rows.of(slots))

    def learn(self, units: list[str]) -> None:
        ids = self.merges.ids(units)
        sizes = np.array([len(i) for i in ids])
        self.rows.add(sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds of texts in them) of consecutive runs of the column's texts; null texts are empty."""
        for data, bounds in text_slices(column):
            slots, first = self.look_up(data, bounds)
            ends = np.concatenate([[0], np.cumsum(self.rows.size[slots])])
            yield self.rows.of(slots), ends[first]


_STORES: dict[str, TokenStore] = {}


def token_store(path: str) -> TokenStore:
    """The worker's store for a vocabulary file; loaded once."""
    if path not in _STORES:
        _STORES[path] = TokenStore(path)
    return _STORES[path]
