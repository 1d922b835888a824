"""The few protobuf wire types an Example record needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return bytes([field << 3 | 2]) + _varint(len(body)) + body


def _feature(kind: str, values: list) -> bytes:
    if kind == "bytes":
        return _block(1, b"".join(_block(1, v) for v in values))
    if kind == "float":
        return _block(2, _block(1, struct.pack(f"<{len(values)}f", *values)))
    return _block(3, _block(1, b"".join(map(_varint, values))))


def encode_example(features: dict[str, tuple[str, list]]) -> bytes:
    """Features by name as ``(kind, values)``; names are sorted so that bytes repeat."""
    entries = (
        _block(1, _block(1, name.encode()) + _block(2, _feature(kind, values)))
        for name, (kind, values) in sorted(features.items())
    )
    return _block(1, b"".join(entries))


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _parts(data: memoryview) -> Iterator[tuple[int, int, memoryview | int]]:
    """``(field, wire type, value)`` of each part of a message."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _read_varint(data, at)
        elif wire == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield tag >> 3, wire, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _values(feature: memoryview) -> list:
    out: list = []
    for kind, _, body in _parts(feature):
        for _, wire, value in _parts(body):
            if kind == 1:
                out.append(bytes(value))
            elif kind == 2:
                out.extend(struct.unpack(f"<{len(value) // 4}f", value))
            elif wire == 0:
                out.append(_signed(value))
            else:
                at = 0
                while at < len(value):
                    n, at = _read_varint(value, at)
                    out.append(_signed(n))
    return out


def decode_example(record: bytes) -> dict[str, list]:
    """The features of one record by name."""
    features: dict[str, list] = {}
    for _, _, group in _parts(memoryview(record)):
        for _, _, entry in _parts(group):
            name, values = "", []
            for field, _, value in _parts(entry):
                if field == 1:
                    name = bytes(value).decode()
                else:
                    values = _values(value)
            features[name] = values
    return features
