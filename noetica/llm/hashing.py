"""Polynomial hashes modulo the prime 2^61 - 1, for words and for windows of words.

Two different values of n digits collide for at most n of all bases, so that seeded bases that the input doesn't know make the
chance of any collision provably small, whatever the input's structure.
"""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = (1 << 61) - 1
#: Two seeded bases; hashes by both are independent.
BASES = tuple(int(x) for x in np.random.default_rng(61).integers(1 << 32, PRIME, 2))
#: Bytes of a digit, and the longest word that is hashed digit by digit.
DIGIT, LONGEST = 7, 112
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61 = np.uint64(31), np.uint64(30), np.uint64(61)


#: Values that are hashed together: what stays in a processor's cache.
SLAB = 1 << 14


def nearly_reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or that and the prime, as at most the prime and seven."""
    high = x >> _61
    x &= _P
    x += high
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, from nearly reduced."""
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b, nearly reduced, for a nearly reduced and b below the prime, from products of half words."""
    b1, b0 = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    a1, a0 = a >> _31, a & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= np.uint64(2) * b1
    a0 *= b0
    a1 += a0
    a1 += middle >> _30
    middle &= _LOW30
    middle <<= _31
    a1 += middle
    return nearly_reduced(a1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span of bytes: its length, then its digits, as a polynomial; data goes on for 16 bytes behind the last span.

    Spans over LONGEST bytes take a keyed cryptographic digest instead, which needs no step for each digit.
    """
    sizes = ends - starts
    out = np.concatenate([_digits(data, starts[a : a + SLAB], sizes[a : a + SLAB], base) for a in range(0, len(starts), SLAB)] or [np.empty(0, np.uint64)])
    key = base.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little") % PRIME
    return out


def _digits(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(DIGIT + 1)], np.uint64)
    out = sizes.astype(np.uint64)
    # the first digit of all, then the next ones of those that have any
    out = nearly_reduced(times(out, base) + (eights[starts] & masks[np.minimum(sizes, DIGIT)]))
    going, at = np.flatnonzero((sizes > DIGIT) & (sizes <= LONGEST)), DIGIT
    while len(going):
        digit = eights[starts[going] + at] & masks[np.minimum(sizes[going] - at, DIGIT)]
        out[going] = nearly_reduced(times(out[going], base) + digit)
        at += DIGIT
        going = going[sizes[going] > at]
    return reduced(out)


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = max(0, len(words) - width + 1)
    return np.concatenate([_windows(words[a : min(n, a + SLAB) + width - 1], width, base) for a in range(0, n, SLAB)] or [np.empty(0, np.uint64)])


def _windows(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Runs of powers of two, put together by the bits of the width; there are `width` words or more."""
    out, done, power, span = None, 0, words, 1
    while True:
        if width & span:  # a run of `done` words, then one of `span`
            out = power if out is None else nearly_reduced(times(out[: len(out) - span], pow(base, span, PRIME)) + power[done : done + len(out) - span])
            done += span
        if 2 * span > width:
            return reduced(out)
        power = nearly_reduced(times(power[: len(power) - span], pow(base, span, PRIME)) + power[span:])
        span *= 2
