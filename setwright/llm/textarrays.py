"""Text columns as numpy arrays: bounded slices of Arrow batches, word bounds and word hashes.

Everything here works on the UTF-8 bytes of many texts at once. A slice holds whole
texts of about ``SLICE_BYTES`` in total (one text if that text alone is longer), so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch at most; Spark's default suits short rows, and texts are not.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LONG_WORD = 256
_K0 = np.uint64(0x9E3779B97F4A7C15)
_K1 = np.uint64(0xBF58476D1CE4E5B9)
_K2 = np.uint64(0x94D049BB133111EB)
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of the session that ``df`` belongs to small, and return ``df``."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words split at ASCII white space.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of digits, lower-case letters and all that is not ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts come to about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (null: empty)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of a run of texts: byte bounds, and the first word of each text.

    Text ``i`` has the words ``first[i]`` to ``first[i + 1] - 1``.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True):
        self.data = np.concatenate([LOWER[raw] if lower else raw, np.zeros(8, np.uint8)])
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = letters[self.data[: len(raw)]]
        starts = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]  # at the byte after a word
        # A text that begins with a word right after one that ends with a word.
        joint = offsets[(offsets > 0) & (offsets < len(raw))]
        joint = joint[inside[joint] & inside[joint + 1]]
        starts[joint] = True
        ends[joint] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)

    def text(self, i: int, j: int) -> list[bytes]:
        """Words ``i`` to ``j - 1`` as bytes."""
        return [self.data[self.start[k] : self.end[k]].tobytes() for k in range(i, j)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data`` (which has 8 spare bytes at its end)."""
    size = end - start
    out = mixed(size.astype(np.uint64) * _K0 + _K2)
    if not len(start):
        return out
    eight = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    live = np.flatnonzero(size <= _LONG_WORD)
    at = 0
    while len(live):
        rest = size[live] - at
        chunk = eight[start[live] + at] & _TAIL[np.clip(rest, 0, 8)]
        out[live] = mixed((out[live] ^ chunk) + _K0)
        at += 8
        live = live[rest > 8]
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` neighbours (over text bounds too; drop those)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, _K2, dtype=np.uint64)
    for k in range(length):
        out = mixed((out ^ hashes[k : k + n]) + _K0)
    return out
