"""Quality rules: simple word statistics, and bands of zstandard compression ratios.

Repetitive text compresses too well and random text too little, by limits that depend on the length: a short text
cannot compress much. The whole document and its fixed-size chunks are both measured. Rows are judged one by one in
Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


class Band(NamedTuple):
    """Accepted ratios (bytes before over bytes after) for texts of fewer than `below` bytes."""

    below: float
    least: float
    most: float


#: Prose compresses by 0.9 at 64 bytes, 1.2 at 200, 1.6 at 700, 1.9 at 2 kB and 2.5 at 50 kB. Base64 noise in words of
#: eight characters reaches 1.06 at 191 bytes, 1.16 at 383, 1.33 at 2 kB and 1.36 at 60 kB, in words of four 1.11, 1.22,
#: 1.40 and 1.43. Each lower limit lies above the noise at the band's end: from 256 bytes above both kinds, from 128
#: above words of eight. Below 128 bytes the two cannot be told apart.
BANDS = (
    Band(128, 0.5, 2.0), Band(160, 1.04, 2.75), Band(192, 1.065, 2.75), Band(256, 1.125, 2.75), Band(384, 1.23, 2.75),
    Band(512, 1.28, 2.75), Band(768, 1.34, 3.2), Band(1024, 1.4, 3.2), Band(2048, 1.45, 3.2), Band(8192, 1.5, 4.0),
    Band(32768, 1.5, 4.6), Band(float("inf"), 1.5, 5.0),
)
CHUNK_BYTES, CHUNK_BANDS = 2048, (Band(2048, 1.45, 4.0), Band(float("inf"), 1.5, 4.0))
#: A last chunk of less than half the size is left out. More than this share of chunks outside their band rejects.
MAX_BAD_CHUNKS = 1 / 3
LEVEL = 3

MEASURES = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
    "ratio:double,n_chunks:long,n_bad_chunks:long,base_failed:boolean,kept:boolean>"
)


def repeated_words(words: Sequence[str], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    # each step turns (window number, next word) into a new number, so windows are told apart exactly
    keys, many = ids[:n], len(number)
    for k in range(1, window):
        if many >= (1 << 62) // len(number):
            keys = np.unique(keys, return_inverse=True)[1]
            many = int(keys.max()) + 1
        keys, many = keys * len(number) + ids[k:k + n], many * len(number)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measured(data: bytes, squeeze, bands: Sequence[Band]) -> tuple[float, bool]:
    """Ratio, and whether it is inside the band of its length."""
    ratio, band = len(data) / len(squeeze(data)), next(b for b in bands if len(data) < b.below)
    return ratio, band.least <= ratio <= band.most


def compression(data: bytes, squeeze, bands: Sequence[Band], chunk_bytes: int, chunk_bands: Sequence[Band]) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks, chunks outside their band, and whether all is inside the bands."""
    if not data:
        return 0.0, 0, 0, False
    ratio, whole = measured(data, squeeze, bands)
    n_chunks = bad = 0
    if len(data) > chunk_bytes:
        for at in range(0, len(data), chunk_bytes):
            piece = data[at:at + chunk_bytes]
            if 2 * len(piece) >= chunk_bytes:
                n_chunks += 1
                bad += not measured(piece, squeeze, chunk_bands)[1]
    return ratio, n_chunks, bad, whole and bad <= MAX_BAD_CHUNKS * n_chunks


def judge(docs: DataFrame, text: str = "text", out: str = "quality", bands: Sequence[Band] = BANDS,
          chunk_bytes: int = CHUNK_BYTES, chunk_bands: Sequence[Band] = CHUNK_BANDS, level: int = LEVEL) -> DataFrame:
    """`docs` with a struct `out` of the measures, `base_failed` and `kept`.

    Null and empty texts have no words, ratio 0, and fail. Every row stays, with all its columns; a column named as
    `out` is replaced.
    """

    @F.arrow_udf(MEASURES)
    def measure(column: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=level).compress
        rows = []
        for item in column:
            text = item.as_py() or ""
            words = WORD.findall(text)
            lines = [line for line in text.split("\n") if WORD.search(line)]
            n, repeats = len(words), repeated_words(words)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            ratio, n_chunks, bad, inside = compression(text.encode(), squeeze, bands, chunk_bytes, chunk_bands)
            rows.append((
                n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
                ratio, n_chunks, bad, failed, inside and not failed,
            ))
        columns = zip(*rows, strict=True) if rows else [[]] * 10
        types = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
        names = [f.split(":")[0] for f in MEASURES[len("struct<"):-1].split(",")]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.withColumn(out, measure(F.coalesce(F.col(text), F.lit(""))))
