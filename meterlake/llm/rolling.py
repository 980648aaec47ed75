"""Polynomial prefix hashes, window hashes and minimisers over numpy arrays.

Hashes are polynomials modulo 2**64 with an odd base over 64-bit symbol values.
``prefix`` holds running sums, so the hash of any stretch takes two look-ups and
a multiplication with a power of the base's inverse.

A polynomial modulo 2**64 over one fixed value for each byte has collisions in
texts of two letters (the Thue-Morse word and its complement). So the symbols
are no bytes: at each byte, all eight bytes from it on are mixed into one value
(``byte_values``), and words are hashed by mixing eight bytes at a time.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Low bits of a minimiser's order that hold its place; fixed, so that all tasks order grams alike. Limits symbols at once.
PLACE_BITS = 22
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes in the symbol of one place, so ``n`` bytes are ``n - SPAN + 1`` symbols.
SPAN = 8
#: Words of more bytes are hashed one by one.
LONG = 64
_KEEP = np.array([(1 << 8 * min(i, 8)) - 1 for i in range(LONG + 1)], np.uint64)

_power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        for name, by in (("_power", BASE), ("_inverse", _INVERSE)):
            steps = np.full(size, by, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def loads(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end; big-endian ones order as the bytes do."""
    padded = np.zeros(len(data) + SPAN, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), ">u8" if big else "<u8", padded, 0, (1,))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of the eight bytes from each place on."""
    return mix(loads(data).astype(np.uint64) + np.uint64(BASE))


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: eight bytes at a time are mixed in, XXH64 for long words."""
    size = ends - starts
    at = loads(data)
    out = mix((at[starts] & _KEEP[np.minimum(size, LONG)]) + size.astype(np.uint64) * np.uint64(BASE)) if len(starts) else np.zeros(0, np.uint64)
    for step in range(SPAN, LONG, SPAN):
        more = np.flatnonzero(size > step)
        if not len(more):
            break
        out[more] = mix(out[more] + (at[starts[more] + step] & _KEEP[np.minimum(size[more] - step, LONG)]))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 (64 bits) of the stretches of an array."""
    raw, width = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)], np.uint64)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix hashes of 64-bit symbol values; one entry more than values."""
    power, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def stretch(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) under the prefix hashes ``h``; equal stretches have equal hashes wherever they stand."""
    return (h[end] - h[start]) * _powers(len(h))[1][start]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all stretches of ``n`` symbols, by their start."""
    count = len(h) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    return (h[n:] - h[:count]) * _powers(len(h))[1][:count]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones, from running minima of blocks in both directions."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, _TOP, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The minimiser of every window: (gram hash, position, first window, last window + 1) for each anchor.

    Every window of ``window`` symbols picks its least gram of ``gram`` symbols,
    the leftmost one of equals, so equal windows pick the same gram at the same
    distance. Windows that share a pick are consecutive.
    """
    bits = PLACE_BITS
    grams = mix(windows(h, gram))
    order = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    picks = (sliding_min(order, window - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    if not len(picks):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = np.flatnonzero(np.concatenate(([True], picks[1:] != picks[:-1])))
    last = np.concatenate((first[1:], [len(picks)]))
    return grams[picks[first]], picks[first], first, last
