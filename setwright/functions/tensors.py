"""Byte <-> number conversions that Spark has no built-in for.

Each works on whole Arrow batches by re-labelling the buffers, with no loop over
rows: a list of float32 and a binary value have the same value bytes and differ
only in how the offsets count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _offsets(array: pa.Array) -> np.ndarray:
    """The int32 offsets of a list, string or binary array, honouring slicing."""
    return np.frombuffer(array.buffers()[1], dtype="<i4")[array.offset : array.offset + len(array) + 1]


def _mask(array: pa.Array) -> pa.Array:
    return array.is_null()


def _as_binary(array: pa.Array) -> pa.Array:
    return array.cast(pa.binary()) if array.type != pa.binary() else array


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _decode_f32(content: pa.Array) -> pa.Array:
    content = _as_binary(content)
    offsets = _offsets(content)
    values = content.buffers()[2]
    raw = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    floats = pa.array(raw.view("<f4"))
    starts = pa.array((offsets - offsets[0]) // 4, type=pa.int32())
    return pa.ListArray.from_arrays(starts, floats, mask=_mask(content))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _decode_u8(content: pa.Array) -> pa.Array:
    content = _as_binary(content)
    offsets = _offsets(content)
    values = content.buffers()[2]
    raw = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    starts = pa.array(offsets - offsets[0], type=pa.int32())
    return pa.ListArray.from_arrays(starts, pa.array(raw.astype("<f4")), mask=_mask(content))


@F.arrow_udf(T.BinaryType())
def _encode_f32(tensor: pa.Array) -> pa.Array:
    offsets = _offsets(tensor)
    floats = tensor.values.cast(pa.float32()).fill_null(float("nan"))
    raw = floats.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype("<f4").tobytes()
    starts = ((offsets - offsets[0]) * 4).astype("<i4")
    valid = pa.array(~np.asarray(_mask(tensor)))
    packed = pa.Array.from_buffers(
        pa.binary(), len(tensor), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(raw)]
    )
    return pa.compute.if_else(valid, packed, pa.scalar(None, pa.binary()))


def decode_f32(content: Column | str) -> Column:
    """Little-endian float32 bytes to an array; NULL if the length is not a multiple of four."""
    content = F.col(content) if isinstance(content, str) else content
    return _decode_f32(F.when(F.length(content) % 4 == 0, content))


def decode_u8(content: Column | str) -> Column:
    """Unsigned bytes to an array of numbers."""
    return _decode_u8(content)


def encode_f32(tensor: Column | str) -> Column:
    """An array of numbers to little-endian float32 bytes."""
    return _encode_f32(tensor)
