"""The perfect binary Golay code of length 23: tables from its generator polynomial."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each octet at its place; the error that each remainder shows."""
    octets = np.array(
        [[_remainder((b << 8 * i) & ((1 << LENGTH) - 1)) for b in range(256)] for i in range(3)],
        dtype=np.uint32,
    )
    errors = np.zeros(1 << CHECKS, dtype=np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            errors[_remainder(error)] = error
    return octets, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    octets, errors = _tables()
    words = words.astype(np.uint32)
    shown = octets[0][words & 255] ^ octets[1][words >> 8 & 255] ^ octets[2][words >> 16]
    return (words ^ errors[shown]) >> CHECKS


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords nearest to each word and to its 23 one-bit neighbours.

    One row a word; the first column is the word's own. At most six differ.
    """
    flips = np.array([0, *(1 << i for i in range(LENGTH))], dtype=np.uint32)
    return nearest(words.astype(np.uint32)[:, None] ^ flips)
