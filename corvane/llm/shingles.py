"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SIZE = 5
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z as a-z
_STEP = _RNG.integers(1, 1 << 63, SIZE + 1, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, one after another, and the n + 1 offsets of its texts; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the n + 1 offsets of the texts' words.

    Eight bytes at a time are mixed with their place in the word before they are added up, and the word's length goes in, so what two words'
    hashes have in common isn't a sum over their letters.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1][at[1:-1] < len(raw)]
    first[edges] = inside[edges]  # words never cross texts
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    where = np.flatnonzero(inside)
    begins = np.searchsorted(where, starts)
    sizes = np.diff(np.append(begins, len(where)))
    parts = (sizes + 7) // 8
    ahead = np.cumsum(parts) - parts
    eights = np.zeros(8 * int(parts.sum()), np.uint8)
    eights[np.repeat(8 * ahead - begins, sizes) + np.arange(len(where))] = _LOWER[raw[where]]
    place = (np.arange(len(eights) // 8) - np.repeat(ahead, parts)).astype(np.uint64)
    mixed = mix(eights.view(np.uint64) ^ mix(place * _STEP[0] + _STEP[1]))
    return mix(np.add.reduceat(mixed, ahead) ^ (sizes.astype(np.uint64) * _STEP[2])), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words each, all words as one where there are fewer, none without words."""
    words, at = word_hashes(*text_bytes(texts))
    n = len(words)
    whole = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        whole += words[k : n - SIZE + 1 + k] * _STEP[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SIZE:
            s = np.sort(whole[a : b - SIZE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + _STEP[SIZE] * _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
