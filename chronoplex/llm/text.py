"""Shared text rules: ASCII lower case, ASCII white space, and numpy hashes of whole batches of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters 0x09 to 0x0D.
WHITE = " \t\n\x0b\f\r"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text is processed in pieces of about so many bytes, whatever the size of an Arrow batch.
PIECE_BYTES = 1 << 20

_LOW = np.frombuffer(LOWER_BYTES, dtype=np.uint8)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; text without other letters takes the quicker built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_fold(key: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an identifier's decimal text."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in an odd base, then mixed with the length."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), out=total[1:])
    inverse = _powers(pow(base, -1, 1 << 64), len(data) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def string_hashes(strings: pa.Array, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each string, nulls left aside, computed for pieces of bounded size."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset: strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2], dtype=np.uint8) if len(strings) and strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    out, at = np.zeros(len(strings), dtype=np.uint64), 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        low = offsets[at]
        out[at:to] = _span_hashes(data[low: offsets[to]], offsets[at:to] - low, offsets[at + 1: to + 1] - low, base)
        at = to
    return out


class Words:
    """Words of a run of texts: byte buffer in lower case, word bounds and the texts' word counts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        raw = np.frombuffer(body, dtype=np.uint8)[offsets[0]: offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        # one blank after each text, so that no word goes over into the next
        bounds = offsets - offsets[0]
        self.bytes = np.insert(_LOW[raw], bounds[1:], 0x20) if len(texts) else np.zeros(0, np.uint8)
        self.text_end = bounds[1:] + np.arange(1, len(texts) + 1)
        white = _IS_WHITE[self.bytes]
        edge = np.diff(white.astype(np.int8), prepend=1, append=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.counts = np.diff(np.searchsorted(self.start, self.text_end), prepend=0)

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        return _span_hashes(self.bytes, self.start, self.end, base)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        return _span_hashes(self.bytes, start, end, base)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each; a longer text is a run of its own."""
    size = np.frombuffer(pc.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    total = np.cumsum(size)
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
