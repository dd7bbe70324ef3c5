"""Metadata maps as VARIANT values: integers are 64-bit, floats double, bytes binary; read back as they were written."""

from __future__ import annotations

import decimal
import struct
from typing import Any

from pyspark.sql.types import VariantVal


def _u32(n: int) -> bytes:
    return struct.pack("<I", n)


def _keys(value: Any, found: set[str]) -> set[str]:
    if isinstance(value, dict):
        found |= set(value)
        for x in value.values():
            _keys(x, found)
    elif isinstance(value, list | tuple):
        for x in value:
            _keys(x, found)
    return found


def _encode(value: Any, ids: dict[str, int]) -> bytes:
    """One value of the open Variant binary encoding; sizes and offsets are always four bytes."""
    if value is None:
        return bytes([0 << 2])
    if isinstance(value, bool):
        return bytes([(1 if value else 2) << 2])
    if isinstance(value, int):
        return bytes([6 << 2]) + struct.pack("<q", value)
    if isinstance(value, float):
        return bytes([7 << 2]) + struct.pack("<d", value)
    if isinstance(value, bytes | bytearray):
        return bytes([15 << 2]) + _u32(len(value)) + bytes(value)
    if isinstance(value, str):
        own = value.encode()
        return bytes([16 << 2]) + _u32(len(own)) + own
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda x: x[0].encode())
        head, names = 0b1111110, b"".join(_u32(ids[k]) for k, _ in items)
        parts = [_encode(x, ids) for _, x in items]
    else:
        head, names = 0b11111, b""
        parts = [_encode(x, ids) for x in value]
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p))
    return bytes([head]) + _u32(len(parts)) + names + b"".join(map(_u32, offsets)) + b"".join(parts)


def to_variant(metadata: dict[str, Any] | None) -> VariantVal:
    value = metadata or {}
    keys = sorted(_keys(value, set()), key=str.encode)
    offsets, text = [0], b""
    for k in keys:
        text += k.encode()
        offsets.append(len(text))
    head = bytes([1 | 1 << 4 | 3 << 6])
    return VariantVal(_encode(value, {k: i for i, k in enumerate(keys)}), head + _u32(len(keys)) + b"".join(map(_u32, offsets)) + text)


def from_variant(value: VariantVal | None) -> dict[str, Any]:
    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        if isinstance(x, list):
            return [plain(y) for y in x]
        return float(x) if isinstance(x, decimal.Decimal) else bytes(x) if isinstance(x, bytearray) else x

    return {} if value is None else plain(value.toPython())
