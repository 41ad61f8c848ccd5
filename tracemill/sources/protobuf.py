"""Just enough of the protobuf wire format for profile files: reading and writing fields by number."""

from __future__ import annotations

import struct


def varint(data: bytes, at: int) -> tuple:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def signed(value: int) -> int:
    """A 64-bit varint as a signed number."""
    return value - (1 << 64) if value >> 63 else value


def fields(data: bytes):
    """(number, wire type, value) of each field of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} at byte {at}: not a protobuf message")
        yield number, kind, value


def numbers(kind: int, value) -> list:
    """Values of a repeated integer field, packed or not."""
    if kind == 0:
        return [value]
    if kind == 1:
        return [struct.unpack("<Q", value)[0]]
    out, at = [], 0
    while at < len(value):
        x, at = varint(value, at)
        out.append(x)
    return out


def message(data: bytes) -> dict:
    """Values of a message by field number, each a list of (wire type, value)."""
    out: dict = {}
    for number, kind, value in fields(data):
        out.setdefault(number, []).append((kind, value))
    return out


def one(m: dict, number: int, default=0):
    return m[number][-1][1] if number in m else default


def text(m: dict, number: int) -> str:
    return one(m, number, b"").decode("utf-8", "replace")


def put_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def put(number: int, value) -> bytes:
    """A field: integers as varints, bytes and strings by length, lists of integers packed. Zeros and empty values are left out."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, list):
        value = b"".join(map(put_varint, value))
    if isinstance(value, int):
        return put_varint(number << 3) + put_varint(value) if value else b""
    return put_varint(number << 3 | 2) + put_varint(len(value)) + value if value else b""
