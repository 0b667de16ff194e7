"""CRC-32 of a concatenation from the CRC-32s of its parts.

A CRC-32 is a remainder of polynomials over GF(2), so appending n bytes
multiplies the earlier remainder by x**(8n).
"""

from __future__ import annotations

from functools import lru_cache

#: Fixed value: the reflected CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320
_ONE = 1 << 31


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC polynomial."""
    out = 0
    while a:
        if a & _ONE:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=4096)
def _power(n_bytes: int) -> int:
    """x ** (8 * n_bytes), by squaring."""
    out, square, n = _ONE, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square = _times(square, square)
        n >>= 1
    return out


def combine(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two parts' concatenation."""
    return _times(_power(second_bytes), first) ^ second
