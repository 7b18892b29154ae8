"""MetroHash128, the first variant, of whole byte strings."""

from __future__ import annotations

import struct

# Fixed values of the published algorithm.
K = (0xC83A91E1, 0x8648DBDB, 0x7BDEC03B, 0x2F5870A5)
_MASK = (1 << 64) - 1


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (64 - n)) & _MASK


def metro128(data: bytes, seed: int = 0) -> bytes:
    k0, k1, k2, k3 = K
    v = [(seed - k0) * k3 & _MASK, (seed + k1) * k2 & _MASK]
    at, n = 0, len(data)
    if n >= 32:
        v += [(seed + k0) * k2 & _MASK, (seed - k1) * k3 & _MASK]
        whole = n // 32 * 32
        a, b, c, d = v
        for w, x, y, z in struct.iter_unpack("<4Q", data[:whole]):
            a = (_turn((a + w * k0) & _MASK, 29) + c) & _MASK
            b = (_turn((b + x * k1) & _MASK, 29) + d) & _MASK
            c = (_turn((c + y * k2) & _MASK, 29) + a) & _MASK
            d = (_turn((d + z * k3) & _MASK, 29) + b) & _MASK
        at = whole
        c ^= _turn(((a + d) * k0 + b) & _MASK, 21) * k1 & _MASK
        d ^= _turn(((b + c) * k1 + a) & _MASK, 21) * k0 & _MASK
        a ^= _turn(((a + c) * k0 + d) & _MASK, 21) * k1 & _MASK
        b ^= _turn(((b + d) * k1 + c) & _MASK, 21) * k0 & _MASK
        v = [a, b]
    a, b = v

    def taken(size: int) -> int:
        nonlocal at
        at += size
        return int.from_bytes(data[at - size : at], "little")

    if n - at >= 16:
        a = _turn((a + taken(8) * k2) & _MASK, 33) * k3 & _MASK
        b = _turn((b + taken(8) * k2) & _MASK, 33) * k3 & _MASK
        a ^= _turn((a * k2 + b) & _MASK, 45) * k1 & _MASK
        b ^= _turn((b * k3 + a) & _MASK, 45) * k0 & _MASK
    if n - at >= 8:
        a = _turn((a + taken(8) * k2) & _MASK, 33) * k3 & _MASK
        a ^= _turn((a * k2 + b) & _MASK, 27) * k1 & _MASK
    if n - at >= 4:
        b = _turn((b + taken(4) * k2) & _MASK, 33) * k3 & _MASK
        b ^= _turn((b * k3 + a) & _MASK, 46) * k0 & _MASK
    if n - at >= 2:
        a = _turn((a + taken(2) * k2) & _MASK, 33) * k3 & _MASK
        a ^= _turn((a * k2 + b) & _MASK, 22) * k1 & _MASK
    if n - at >= 1:
        b = _turn((b + taken(1) * k2) & _MASK, 33) * k3 & _MASK
        b ^= _turn((b * k3 + a) & _MASK, 58) * k0 & _MASK
    a = (a + _turn((a * k0 + b) & _MASK, 13)) & _MASK
    b = (b + _turn((b * k1 + a) & _MASK, 37)) & _MASK
    a = (a + _turn((a * k2 + b) & _MASK, 13)) & _MASK
    b = (b + _turn((b * k3 + a) & _MASK, 37)) & _MASK
    return struct.pack("<2Q", a, b)
