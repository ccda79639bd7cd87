"""Keyed permutations of number ranges: a balanced Feistel network with cycle walking."""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 6
#: Constants of the round function. Halves have at most 31 bits, so nothing exceeds 63 bits.
_A, _B, _LOW = 1_540_483_477, 1_103_515_245, (1 << 31) - 1


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    """One number below 2**61 for each round."""
    return [int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "big") >> 3 for i in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of each half of the least even-width domain that holds range(n)."""
    bits = max(2, (n - 1).bit_length())
    if bits > 62:
        raise ValueError("more than 2**62 values")
    return (bits + 1) // 2


def _mix(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    t = half * np.int64(_A) + np.int64(key)
    t ^= t >> 29
    t = (t & _LOW) * np.int64(_B) + (t >> 31)
    t ^= t >> 32
    return t & mask


def _pass(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for k in reversed(keys) if back else keys:
        left, right = (right ^ _mix(left, k, mask), left) if back else (right, left ^ _mix(right, k, mask))
    return left << half | right


def permute(x: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """Where each number of range(n) goes; ``back`` gives the number that went there.

    Values that leave the range are sent through the network until they are in it again. The
    domain is less than four times the range, so few walks take more than some steps.
    """
    x = np.asarray(x, np.int64)
    if n < 1 and len(x) or (len(x) and (x.min() < 0 or x.max() >= n)):
        raise ValueError("a value is outside of the range")
    half = half_bits(max(n, 1))
    out = _pass(x, half, keys, back)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = _pass(out[outside], half, keys, back)
    return out
