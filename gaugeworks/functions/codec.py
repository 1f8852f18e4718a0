"""Zigzag, LEB128 and delta coding of timestamps, as Parquet's delta encoding applies it to a sorted column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def unzigzag(n: int) -> int:
    return -(n + 1) // 2 if n % 2 else n // 2


def leb128(n: int) -> bytes:
    if n < 0:
        raise ValueError("LEB128 holds whole numbers from 0 on")
    digits = [n & 0x7F]
    while n := n >> 7:
        digits[-1] |= 0x80
        digits.append(n & 0x7F)
    return bytes(digits)


def read_leb128(data: bytes) -> Iterator[int]:
    n = shift = 0
    for byte in data:
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            yield n
            n = shift = 0
    if shift:
        raise ValueError("data end within a number")


def encode_deltas(timestamps: Iterable[int]) -> bytes:
    out, before = bytearray(), 0
    for t in timestamps:
        out += leb128(zigzag(t - before))
        before = t
    return bytes(out)


def decode_deltas(data: bytes) -> list[int]:
    out, before = [], 0
    for n in read_leb128(data):
        before += unzigzag(n)
        out.append(before)
    return out
