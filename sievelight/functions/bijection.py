"""Keyed bijections on 0 .. n-1, one for each key, computed place by place without any table.

A place is a number of two digits (left, right) in a grid of at least n cells. Every round adds a keyed
hash of one digit to the other, which can be undone, so the rounds map the grid onto itself. Results
beyond n - 1 go through the rounds again until one lies below: walking along a cycle of the grid's
bijection gives a bijection on the smaller range. The grid has at most sqrt(n) + 1 cells too many, so
few places take a second walk.
"""

from __future__ import annotations

import math

import numpy as np

# Odd 32-bit multipliers of the hash, and the step between the keys of two rounds.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
ROUND_STEP = 0x27D4EB2F
ROUNDS = 6
WORD = 1 << 32
LARGEST = 1 << 62


def scramble(word):
    """A 32-bit hash of 32-bit words, for numbers and arrays of unsigned 64-bit integers."""
    for m in MULTIPLIERS:
        word = word * m % WORD
        word = word ^ word >> 15
    return word


def key_of(*parts: int) -> int:
    """A 32-bit key made of several numbers."""
    key = 0
    for p in parts:
        key = scramble(key ^ (p + 1) % WORD)
    return key


def grid(n: int) -> tuple[int, int]:
    """Left and right base of the smallest near-square grid with n cells."""
    left = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return left, max(-(-n // left), 1)


def _rounds(x: np.ndarray, n: int, key: int) -> np.ndarray:
    left, right = (np.uint64(b) for b in grid(n))
    high, low = x // right, x % right
    for i in range(ROUNDS):
        k = np.uint64((key + i * ROUND_STEP) % WORD)
        if i % 2:
            low = (low + scramble(high ^ k)) % right
        else:
            high = (high + scramble(low ^ k)) % left
    return high * right + low


def permute(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of ``places`` (each in 0 .. n-1) under the bijection of ``key``."""
    if n > LARGEST:
        raise ValueError("more places than the 32-bit digits of the grid can hold")
    x = _rounds(places.astype(np.uint64), n, key)
    while len(beyond := np.flatnonzero(x >= n)):
        x[beyond] = _rounds(x[beyond], n, key)
    return x.astype(np.int64)


def permute_sql(place: str, n: str, key: str) -> str:
    """``permute`` as DuckDB SQL over non-negative integers, for checks."""
    left = f"(CAST(floor(sqrt(greatest({n} - 1, 0))) AS BIGINT) + 1)"
    right = f"greatest(({n} + {left} - 1) // {left}, 1)"
    word = "".join(f", {m}::UBIGINT" for m in MULTIPLIERS)

    def hashed(digit: str) -> str:
        mixed = "(h * c) % 4294967296"
        start = f"xor(({digit})::UBIGINT, (({key} + i * {ROUND_STEP}) % 4294967296)::UBIGINT)"
        return f"list_reduce([{start}{word}], lambda h, c: xor({mixed}, ({mixed}) >> 15))::BIGINT"

    high, low = f"(x // {right})", f"(x % {right})"
    one = (
        f"list_reduce([x{''.join(f', {i}' for i in range(ROUNDS))}], lambda x, i: CASE WHEN i % 2 = 1"
        f" THEN {high} * {right} + ({low} + {hashed(high)}) % {right}"
        f" ELSE ({high} + {hashed(low)}) % {left} * {right} + {low} END)"
    )
    # Walks beyond the eighth are too rare to meet in a check.
    return f"list_reduce([{place}::BIGINT, -1{', -2' * 7}], lambda x, w: CASE WHEN w = -1 OR x >= {n} THEN {one} ELSE x END)"
